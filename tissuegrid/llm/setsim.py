"""All pairs of similar sets: minwise signatures in bands, candidates from shared bands, exact verification.

Sets that are equal form a class; one of them stands for the class in the join, so copies cost nothing. A set whose members do not fit
one task is cut by a salt and its partial signatures are put together by their minimum. Work per set is linear in its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import discard, stage

#: Members of one set that one task takes.
PART = 200_000


@dataclass(frozen=True)
class Bands:
    """A pair of similarity s shares no band with probability (1 - s^rows)^bands: 2e-8 for 0.6 with the defaults."""

    rows: int = 4
    bands: int = 128

    def missed(self, similarity: float) -> float:
        return (1 - similarity**self.rows) ** self.bands


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions, the same in every process."""
    state = np.random.RandomState(20_011)
    draw = lambda: state.randint(0, 2**32, n, dtype=np.uint64) << np.uint64(32) | state.randint(0, 2**32, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def _signatures(n: int):
    """Minimum of n hashes of the items of each (id, salt); rows come sorted, so that only one open group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(n)
        key, low = None, None

        def out(keys, rows):
            flat = pa.array(np.asarray(rows, np.uint32).view(np.int32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * n + 1, n, dtype=np.int32)), flat)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), lists], ["id", "salt", "signature"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):  # 2,048 rows of n hashes are a few MB
                part = batch.slice(at, 2048)
                ids, salts = part.column(0).to_numpy(), part.column(1).to_numpy()
                items = part.column(2).to_numpy().astype(np.uint64)
                with np.errstate(over="ignore"):
                    hashed = ((items[:, None] * a + b) >> np.uint64(32)).astype(np.uint32)
                starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (salts[1:] != salts[:-1])])
                lows = np.minimum.reduceat(hashed, starts, axis=0)
                keys = [(int(ids[s]), int(salts[s])) for s in starts]
                if key == keys[0]:
                    lows[0] = np.minimum(lows[0], low)
                elif key is not None:
                    keys.insert(0, key)
                    lows = np.vstack([low[None], lows])
                key, low = keys[-1], lows[-1]
                if len(keys) > 1:
                    yield out(keys[:-1], lows[:-1])
        if key is not None:
            yield out([key], low[None])

    return run


def _band_rows(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(bands.rows * bands.bands)
        a, b = a.reshape(bands.bands, bands.rows), b.reshape(bands.bands, bands.rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sig = part.column(2).flatten().to_numpy().view(np.uint32).astype(np.uint64).reshape(-1, bands.bands, bands.rows)
                with np.errstate(over="ignore"):
                    bucket = ((sig + b) * a).sum(axis=2, dtype=np.uint64)
                    bucket ^= bucket >> np.uint64(29)
                    bucket = bucket * a[:, 0] + np.arange(bands.bands, dtype=np.uint64)
                take = lambda c: np.repeat(part.column(c).to_numpy(), bands.bands)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), pa.array(take(0)), pa.array(take(1))], ["bucket", "id", "size"])

    return run


@dataclass(frozen=True)
class SimilarSets:
    """sets: (name, id, class_id, size) with one row a set; pairs: (id_a, id_b, similarity) between different classes' ids, id_a < id_b."""

    sets: DataFrame
    pairs: DataFrame

    def expanded(self) -> DataFrame:
        """(set_a, set_b, similarity) for all names, set_a < set_b. Equal sets are paired too, so the result grows with the square of their number."""
        s = self.sets.select("name", "class_id")
        a, b = s.toDF("name_a", "id_a"), s.toDF("name_b", "id_b")
        other = self.pairs.join(a, "id_a").join(b, "id_b")
        same = a.join(b, F.col("id_a") == F.col("id_b")).filter("name_a < name_b").withColumn("similarity", F.lit(1.0))
        both = other.select("name_a", "name_b", "similarity").unionByName(same.select("name_a", "name_b", "similarity"))
        return both.select(F.least("name_a", "name_b").alias("set_a"), F.greatest("name_a", "name_b").alias("set_b"), "similarity")

    def links(self) -> DataFrame:
        """One row a set: (name, class_id, size, copies, links); links counts the other sets that are similar, copies the equal ones and itself."""
        copies = self.sets.groupBy("class_id").agg(F.count("*").alias("copies"))
        both = self.pairs.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other")).unionByName(self.pairs.select(F.col("id_b").alias("class_id"), F.col("id_a").alias("other")))
        near = both.join(copies.toDF("other", "n"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
        of = self.sets.join(copies, "class_id").join(near, "class_id", "left")
        return of.select("name", "class_id", "size", "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))


def similar_sets(members: DataFrame, name: str, item: str, threshold: float = 0.6, bands: Bands = Bands()) -> SimilarSets:
    """All pairs of sets with |A n B| / |A u B| >= threshold.

    members: one row a member; both columns are strings. Rows with a null name or item don't count, repeated ones count once; names and
    items are taken as they are (a blank one is a value). Sets without members don't occur. Other columns are ignored. The result is exact
    but for pairs that share no band (see Bands). Equal sets are recognised by their size and 128 bits of hash.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    given = members.select(F.col(name).alias("name"), F.col(item).alias("item")).dropna().distinct()
    for seed in range(8):  # two names of one number are very unlikely; then all get other numbers
        rows = stage(given.select("name", F.xxhash64("name", F.lit(seed)).alias("id"), "item", F.xxhash64("item").alias("h")))
        whole = rows.groupBy("name", "id").agg(F.count("*").alias("size"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "item")).alias("y"))
        whole = stage(whole)
        if whole.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            break
        discard(rows, whole)
    else:
        raise RuntimeError("no numbering without collisions")
    classes = whole.groupBy("size", "x", "y").agg(F.min("id").alias("class_id"))
    sets = stage(whole.join(classes, ["size", "x", "y"]).select("name", "id", "class_id", "size"))

    heads = sets.filter("id = class_id").select("id", "size")
    of_heads = rows.select("id", "item", "h").join(heads, "id")
    salt = F.when(F.col("size") > PART, F.pmod("h", F.ceil(F.col("size") / PART))).otherwise(F.lit(0)).cast("int")
    salted = of_heads.select("id", salt.alias("salt"), "h").repartition("id", "salt").sortWithinPartitions("id", "salt")
    n = bands.rows * bands.bands
    signed = stage(salted.mapInArrow(_signatures(n), "id long, salt int, signature array<int>").join(heads, "id"))
    # Signatures are compared as unsigned numbers, hence the shift to long.
    single = signed.filter(F.col("size") <= PART).select("id", "size", "signature")
    cut = signed.filter(F.col("size") > PART).select("id", "size", F.posexplode("signature").alias("at", "v"))
    cut = cut.groupBy("id", "size", "at").agg(F.min(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("v"))
    cut = cut.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))  # n entries each
    cut = cut.select("id", "size", F.transform("s", lambda x: F.when(x["v"] > 2147483647, x["v"] - 4294967296).otherwise(x["v"]).cast("int")).alias("signature"))
    buckets = single.unionByName(cut).select("id", "size", "signature").mapInArrow(_band_rows(bands), "bucket long, id long, size long")

    a, b = (buckets.select("bucket", F.col("id").alias(f"id_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    ratio = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (threshold - 1e-9)
    candidates = stage(a.join(b, "bucket").filter((F.col("id_a") < F.col("id_b")) & ratio).select("id_a", "id_b", "size_a", "size_b").distinct())
    # Exact overlap: look the members of the smaller set up in the other one.
    small_first = candidates.select("*", *(F.when(F.col("size_a") <= F.col("size_b"), F.col(f"id_{x}")).otherwise(F.col(f"id_{y}")).alias(k) for k, x, y in (("small", "a", "b"), ("large", "b", "a"))))
    plain = rows.select("id", "item")
    met = small_first.join(plain.toDF("small", "item"), "small").join(plain.toDF("large", "item"), ["large", "item"])
    common = F.count("*")
    exact = met.groupBy("id_a", "id_b", "size_a", "size_b").agg(common.alias("common"))
    exact = exact.withColumn("similarity", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))
    return SimilarSets(sets, stage(exact.filter(F.col("similarity") >= threshold).select("id_a", "id_b", "similarity")))
