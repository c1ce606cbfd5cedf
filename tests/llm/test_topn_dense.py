from pyspark.sql import functions as F

from tissuegrid.llm.topn import top_n


def test_tied_consecutive_large_identifiers(spark):
    base = 1 << 60
    df = spark.range(base, base + 3000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.lit(1.0).alias("s"))
    assert sorted(r.i for r in top_n(df, "g", "i", "s", 7, max_passes=6).collect()) == [base + k for k in range(7)]


def test_large_identifiers_of_both_signs(spark):
    for base in ((1 << 62), -(1 << 63), (1 << 63) - 101):
        df = spark.createDataFrame([("g", base + k, 2.5) for k in range(100)], "g string, i long, s double")
        assert sorted(r.i for r in top_n(df, "g", "i", "s", 3, max_passes=12).collect()) == [base, base + 1, base + 2]


def test_one_group_of_nine_tenths(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string"))).alias("g"), F.col("id").alias("i"), (F.col("id") % 977).cast("double").alias("s"))
    got = top_n(df.unionByName(df.limit(5000)), "g", "i", "s", 5).collect()
    rows = {}
    for k in range(60_000):
        rows.setdefault("hot" if k % 10 else f"g{k % 500}", []).append((-(k % 977), k))
    assert {(r.g, r.i) for r in got} == {(g, i) for g, v in rows.items() for _, i in sorted(v)[:5]} and len(got) == 5 * len(rows)
