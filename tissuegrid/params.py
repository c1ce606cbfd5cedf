"""Parameters of cell-level inference: immutable, checked, and read from nested or flat JSON."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

# Names and defaults under which parameter files are exchanged.


@dataclass(frozen=True)
class GraphParams:
    n_neighbors: int = 5
    conn_key: str = "snn"
    obs_keys: tuple[str, ...] | None = None
    reduced_dimension_transcriptome_obsm_key: str = "X_pca"
    reduced_dimension_transcriptome_obsm_dims: int = 2
    geom_morph_ratio: float = 1
    geom_constraint: float = 0
    adjust_cell_network_by_transcriptome_scale: float = 0
    snn_threshold: float = 0.1
    smoothing_scale: float = 0.8
    conn_csr_matrix: str | None = None
    inflation_percentage: float | None = None
    node_features_obs_list: tuple[str, ...] = ("spot_heterogeneity",)
    preferential_flow: bool = True
    weigh_cells: bool = True
    balance_cell_quality: bool = False
    bcq_IQR: tuple[float, float] = (0.15, 0.85)


@dataclass(frozen=True)
class RunParams:
    initialize: bool = True
    burn_in_steps: int = 5
    layer: str | None = None
    is_rawCount: bool = False
    regulate_expression_mean: bool = False
    stochastic_expression_neighbors_level: str = "spot"
    n_iter: int = 20
    conn_key: str = "snn"
    write_freq: int = 10
    out_prefix: str = "y"
    sample_predicted_expression_fluctuation_scale: float = 1
    smooth_predicted_expression_steps: int = 0
    save_chain: bool = False
    n_jobs: int = 1


def _tuple(v):
    return tuple(v) if isinstance(v, list) else v


@dataclass(frozen=True)
class Params:
    graph: GraphParams = GraphParams()
    run: RunParams = RunParams()

    def changed(self, **values) -> Params:
        """Parameters with some values replaced; a name that both parts have is set in both, an unknown one is an error."""
        parts = {}
        known = set()
        for part in ("graph", "run"):
            names = {f.name for f in dataclasses.fields(getattr(self, part))}
            known |= names
            parts[part] = dataclasses.replace(getattr(self, part), **{k: _tuple(v) for k, v in values.items() if k in names})
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return Params(**parts)

    @classmethod
    def from_json(cls, text: str) -> Params:
        """From {"graph_params": {...}, "run_params": {...}} or from one flat object."""
        values = json.loads(text)
        nested = {k: values.pop(k) for k in ("graph_params", "run_params") if k in values}
        out = cls().changed(**values)
        for part in nested.values():
            out = out.changed(**part)
        return out

    def to_json(self) -> str:
        return json.dumps({"graph_params": dataclasses.asdict(self.graph), "run_params": dataclasses.asdict(self.run)}, indent=4)
