"""Test items that stand, in whole or in part, in documents: one Aho-Corasick automaton over the items' words.

Words are runs of letters and digits in lower case. Each word of the items becomes one character, other words a separator, so that a
passage of n words is a pattern of n characters and a match tells the position of its words in the text.

Documents are read once, whatever the number of items. Items of more words than one automaton should hold are written to the shared folder in parts, and a
task takes a stretch of documents through one part after the other, so that neither the driver nor a task ever holds all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import stage
from tissuegrid.llm.tokens import spread

WORD = re.compile(r"[^\W_]+")
#: Characters that stand for words, and one for all others.
FIRST, OTHER, ROOM = 0x10000, "\uffff", 1_000_000
#: Words of items in one automaton, about: half of what has room, as parts differ in size.
BLOCK = 500_000
#: Characters of documents that a task takes through all parts at a time.
STRETCH = 64_000_000


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


class Automaton:
    """Patterns of `n` consecutive words of any field of the items; a match leads to the (item, field) pairs that have it, and to its places there."""

    def __init__(self, items: list[tuple[int, str, str]], n: int):
        import ahocorasick

        self.n, self.codes, self.total, holders = n, {}, {}, {}
        for item, field, text in items:
            line = "".join(chr(FIRST + self.codes.setdefault(w, len(self.codes))) for w in words(text))
            if len(self.codes) > ROOM:
                raise ValueError("too many different words in one part of the items")
            self.total[item, field] = len(line)
            for k in range(len(line) - n + 1):
                holders.setdefault(line[k : k + n], {}).setdefault((item, field), []).append(k)
        self.codes = {w: chr(FIRST + c) for w, c in self.codes.items()}
        self.found = ahocorasick.Automaton()
        for pattern, who in holders.items():
            self.found.add_word(pattern, sorted(who.items()))
        if holders:
            self.found.make_automaton()
        self.empty = not holders

    def scan(self, text: str | None) -> list[tuple[int, str, int, int, int]]:
        """(item, field, start, end, words) of each longest passage; start and end are offsets in the text as given."""
        return [hit[:5] for hit in self.passages(text)]

    def passages(self, text: str | None) -> list[tuple[int, str, int, int, int, int, int]]:
        """The same with the words of the field that all passages in the text cover together, and the words of the field."""
        if self.empty or not text:
            return []
        low = text.lower()  # of a whole text the same as word by word, but for a letter that becomes two and for the sigma at a word's end
        found = WORD.findall(low) if len(low) == len(text) and "Σ" not in text else words(text)
        if len(found) < self.n:
            return []
        runs: dict[tuple[int, str], list[list[int]]] = {}
        places: dict[tuple[int, str], set[int]] = {}
        for last, who in self.found.iter("".join([self.codes.get(w, OTHER) for w in found])):
            for key, at in who:
                of = runs.setdefault(key, [])
                places.setdefault(key, set()).update(at)
                if of and of[-1][1] >= last - self.n:  # overlaps or touches the passage before
                    of[-1][1] = last
                else:
                    of.append([last - self.n + 1, last])
        if not runs:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        out = []
        for (item, field), of in runs.items():
            covered, upto = 0, -1
            for k in sorted(places[item, field]):
                covered += self.n - max(0, upto - k)
                upto = k + self.n
            out += [(item, field, spans[a][0], spans[b][1], b - a + 1, covered, self.total[item, field]) for a, b in of]
        return out


_BUILT: dict = {}


def _automaton(key, items, n: int) -> Automaton:
    """The automaton of a part, kept until another part is asked for; items: a list, or a function that reads them."""
    key = (key, n)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items() if callable(items) else items, n)
    return _BUILT[key]


def _read(path: str) -> list[tuple]:
    """The items of one part, from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
    return sorted(tuple(r.values()) for f in files for r in pq.read_table(f, filesystem=system).select(["item", "field", "text"]).to_pylist())


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(batch["id"], batch["text"], strict=True):
            held.append(row)
            size += len(row[1])
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def passages(documents: DataFrame, id: str, text: str, items: DataFrame, item: str, fields: list[str], n: int = 12) -> DataFrame:
    """(id, item, field, start, end, words, covered, total): every passage of at least `n` consecutive words that a document shares with a field of an item;
    of the field's `total` words, all passages in the document together hold `covered`.

    Fields with fewer than n words cannot be found. Null and empty texts hold nothing. Repeated rows of documents give repeated passages; a
    repeated item counts once. Other columns are ignored. Passages of one item that follow each other directly in the text come out as one.
    Of items up to BLOCK words the rows are broadcast; more of them are read from the shared folder part by part. One field of more than a million
    different words is an error.
    """
    spark = documents.sparkSession
    long = items.select(F.col(item).alias("item"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("f"))
    long = long.select("item", "f.field", "f.text").filter("item is not null and text is not null").distinct()
    size = long.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2 + 1  # a word and its separator take two characters at least
    parts = -(-size // BLOCK)
    docs = spread(documents.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("text is not null"), "id")
    columns = ["id", "item", "field", "start", "end", "words", "covered", "total"]
    schema = f"id {docs.schema['id'].dataType.simpleString()}, item {long.schema['item'].dataType.simpleString()}, field string, start int, end int, words int, covered int, total int"
    if parts == 1:
        rows = [tuple(r) for r in long.collect()]  # BLOCK words at most
        held, key = spark.sparkContext.broadcast(rows), hash(tuple(sorted(rows, key=repr)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(key, held.value, n)
            for batch in batches:
                yield pd.DataFrame([(doc, *hit) for doc, body in zip(batch["id"], batch["text"], strict=True) for hit in automaton.passages(body)], columns=columns)

        return docs.mapInPandas(run, schema).withColumnsRenamed({"id": id, "item": item})
    told = stage(long.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")), by=["part"])
    paths = [f"{told.inputFiles()[0].rsplit('/part=', 1)[0]}/part={k}" for k in sorted(r["part"] for r in told.select("part").distinct().collect())]  # numbers of parts

    def run_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stretch in _stretches(batches):
            for path in paths:
                automaton = _automaton(path, lambda path=path: _read(path), n)
                yield pd.DataFrame([(doc, *hit) for doc, body in stretch for hit in automaton.passages(body)], columns=columns)

    return docs.mapInPandas(run_parts, schema).withColumnsRenamed({"id": id, "item": item})


def leaked(found: DataFrame, id: str, item: str) -> DataFrame:
    """(id, item, share, whole) of `passages`: the largest share of a field's words that the document holds, and whether it holds a field in whole."""
    of = found.groupBy(id, item).agg(F.max(F.col("covered") / F.col("total")).alias("share"))
    return of.withColumn("whole", F.col("share") >= 1.0)
