import math
import random

import numpy as np
import pytest

from tissuegrid.llm.quantiles import exact_percentiles, merge, percentiles, sketch

P = [0.0, 0.25, 0.5, 0.95, 1.0]
NAMES = ["p0", "p25", "p50", "p95", "p100"]


def sample(kind, n=700):
    r = random.Random(kind)
    return {"positive": [math.exp(r.gauss(0, 4)) for _ in range(n)], "mixed": [r.gauss(0, 5) for _ in range(n)], "ties": [float(r.randint(-2, 2)) for _ in range(n)], "one": [3.5], "zeros": [0.0, -0.0] * 30}[kind]


@pytest.mark.parametrize("alpha", [0.01, 0.001])
def test_order_statistics_within_the_error(spark, alpha):
    values = {k: sample(k) for k in ("positive", "mixed", "ties", "one", "zeros")}
    rows = [(g, v, 1) for g, vs in values.items() for v in vs] + [("mixed", None, 1), ("mixed", math.nan, 1), ("nothing", None, 1), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, bucket int")
    sk = sketch(df, ["g"], "v", alpha)
    got = {r.g: r for r in percentiles(sk, ["g"], P, alpha).collect()}
    exact = {r.g: r for r in exact_percentiles(df, sk, "g", "v", P, alpha).collect()}
    assert set(got) == set(values) | {None} and got[None].n == 1
    for g, vs in values.items():
        assert got[g].n == len(vs)
        for p, name in zip(P, NAMES):
            lo, hi = np.quantile(vs, p, method="lower"), np.quantile(vs, p, method="higher")
            slack = alpha * max(abs(lo), abs(hi)) * (1 + 1e-9)
            assert min(lo, hi) - slack <= got[g][name] <= max(lo, hi) + slack
            assert exact[g][name] == pytest.approx(np.quantile(vs, p), abs=1e-9, rel=1e-12)


def test_merging_parts_is_the_whole(spark):
    rows = [(f"g{k % 3}", k % 7, float(k * k % 1000)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    parts = [sketch(df.filter(f"day % 2 = {k}"), ["g", "day"], "v") for k in (0, 1)]
    as_rows = lambda d: sorted(map(tuple, d.select("g", "sign", "bucket", "n").collect()))
    assert as_rows(merge(parts, ["g"])) == as_rows(sketch(df, ["g"], "v"))


def test_infinite_and_empty(spark):
    df = spark.createDataFrame([("a", math.inf), ("a", 1.0), ("a", -math.inf)], "g string, v double")
    r = percentiles(sketch(df, ["g"], "v"), ["g"], [0.0, 0.5, 1.0]).first()
    assert (r.p0, r.p100) == (-math.inf, math.inf) and r.p50 == pytest.approx(1.0, rel=0.01)
    assert percentiles(sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0
    assert percentiles(sketch(df, [], "v"), [], [0.5]).first().n == 3
