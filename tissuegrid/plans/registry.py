"""All queries outside the training-data package."""

from tissuegrid.plans import cells, faults, graphs, inference, more, profiles

_MODULES = (faults, cells, graphs, profiles, more, inference)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "diffuse_1step"
