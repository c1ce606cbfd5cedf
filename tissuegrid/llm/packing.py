"""Items of varying length in containers of fixed capacity: shortest pack first over the histogram of lengths.

The plan depends on the histogram only, which has at most `capacity` entries, so it is made on the driver whatever the number of items.
It consists of patterns (how many containers hold which lengths). Items get a rank among those of their length, by counts per salt and
ranks within the salt, and the rank tells the container: no length is ever sorted in one task, and no item leaves the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.common import stage

#: Items of one length that are ranked in one task.
RANKED = 100_000


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (containers, [(length, copies), ...]) that hold `histogram[length]` items of every length.

    Lengths come longest first; each goes to the open packs with most room (the shortest packs) first. New packs are opened where none has
    room, and as many as the tokens still to be placed need beyond the room that is open.
    """
    open_packs: list[tuple[int, int, int, tuple]] = []  # (-room, order, packs, contents)
    full, order = [], 0
    left = sum(length * n for length, n in histogram.items())
    room_open = 0

    def push(room: int, packs: int, contents: tuple) -> None:
        nonlocal order, room_open
        if packs == 0:
            return
        if room == 0:
            full.append((packs, contents))
            return
        heapq.heappush(open_packs, (-room, order, packs, contents))
        order += 1
        room_open += room * packs

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        while todo:
            short = left - room_open  # tokens beyond the room that is open
            if short <= 0 and open_packs and -open_packs[0][0] >= length:
                room, _, packs, contents = heapq.heappop(open_packs)
                room, room_open = -room, room_open + room * packs
            else:
                room, packs, contents = capacity, min(todo, max(1, -(-short // capacity))), ()
            copies, used = 1, min(packs, todo)
            if used == packs:
                next_room = -open_packs[0][0] if open_packs else 0
                copies = max(1, min(todo // packs, (room - max(next_room, 0)) // length))
            push(room, packs - used, contents)
            if contents and contents[-1][0] == length:
                contents = (*contents[:-1], (length, contents[-1][1] + copies))
            else:
                contents = (*contents, (length, copies))
            push(room - copies * length, used, contents)
            todo -= used * copies
            left -= used * copies * length
    return [(n, list(c)) for n, c in [*full, *((p, c) for _, _, p, c in sorted(open_packs))]]


class Slots:
    """Where the item of a given length and rank goes; arrays sorted by (length, first rank)."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rows, taken, base = [], {}, 0
        for packs, contents in patterns:
            at = 0
            for length, copies in contents:
                first = taken.get(length, 0)
                rows.append((length, first, base, packs, at))
                taken[length] = first + packs * copies
                at += length * copies
            base += packs
        self.containers = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.base, self.packs, self.at = table.T
        self.start = np.searchsorted(self.length, np.arange((self.length.max() if len(table) else 0) + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container, offset) of each item."""
        container, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            rows = np.flatnonzero(length == one)
            lo, hi = self.start[one], self.start[one + 1]
            slot = lo + np.searchsorted(self.first[lo:hi], rank[rows], "right") - 1
            within = rank[rows] - self.first[slot]
            container[rows] = self.base[slot] + within % self.packs[slot]
            offset[rows] = self.at[slot] + within // self.packs[slot] * one
        return container, offset


def pack(df: DataFrame, id: str, length: str, capacity: int) -> DataFrame:
    """(id, piece, length, container, offset): every item in a container, at its offset there.

    An item longer than the capacity is cut into pieces of the capacity and a rest, numbered from 0; no other is cut. Items of null, zero or negative
    length take no room: they come out with null container and offset. id must be unique; repeated rows count once. Rows with a
    null id don't count. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = df.sparkSession
    items = df.select(F.col(id).alias("id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("whole")).filter("id is not null").distinct()
    last = F.when(F.col("whole") > 0, F.floor((F.col("whole") - 1) / capacity)).otherwise(0)
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = stage(pieces.select("id", F.col("piece").cast("int").alias("piece"), F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("length")))
    placed = pieces.filter("length > 0")
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    empty = pieces.filter("length = 0").select("id", "piece", "length", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("offset"))
    if not histogram:
        return empty.withColumnRenamed("id", id)
    slots = Slots(plan(histogram, capacity))
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length int, salts long")
    salted = placed.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("within", within).join(counts, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))

    @F.pandas_udf("container long, offset long")
    def where(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        container, offset = slots.find(lengths.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"container": container, "offset": offset})

    found = ranked.withColumn("w", where("length", "rank")).select("id", "piece", "length", "w.container", "w.offset")
    return found.unionByName(empty).withColumnRenamed("id", id)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers by the tokens they hold: (used, unused, containers)."""
    each = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    return each.groupBy("used").agg(F.count("*").alias("containers")).select("used", (F.lit(capacity) - F.col("used")).alias("unused"), "containers")
