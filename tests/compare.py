"""Compare a query with its SQL in DuckDB."""

import math

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings samples cells cell_features gene_sets marker_sets cna_predictions_raw eval_items".split()


def connection(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v) if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_value, r)) for r in frame.itertuples(index=False))


def same(query, sql, spark, folder, con):
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
