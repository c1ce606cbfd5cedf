"""Oversized texts in pieces under a token limit, cut at natural boundaries, each sharing an overlap with the next.

A text is cut into sections; what is too long is cut into paragraphs, then sentences and lines, then words, then characters. Neighbouring parts are
packed greedily up to the limit. The next piece begins within the last tokens of the one before, at a word where there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.tokens import VOCABULARY, encoded, spread, token_bytes

#: A cut lies at the end of each match. Headings, rules and the edges of fenced code; blank lines; ends of sentences and lines; white space.
BOUNDARIES = {
    "section": re.compile(r"(?:\r?\n|\r)(?=#{1,6} |(?:-{3,}|={3,}|\*{3,})[ \t]*[\r\n])|(?:\r?\n|\r)[ \t]*(?:```|~~~)[^\r\n]*(?:\r?\n|\r)"),
    "paragraph": re.compile(r"(?:\r?\n|\r)(?:[ \t]*(?:\r?\n|\r))+"),
    "sentence": re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+|\r?\n|\r"),
    "word": re.compile(r"\s+"),
}
LEVELS = [*BOUNDARIES, "character"]
#: Tokens kept free in a piece, because a cut may change the tokens beside it; a piece is counted again before it is given out.
SLACK = 3


class Splitter:
    """Cuts of one text. Positions are code points."""

    def __init__(self, text: str, limit: int, overlap: int, path: str):
        self.text, self.limit, self.overlap, self.path = text, limit, overlap, path
        tokens = np.asarray(encoded(text, path), np.int64)
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        self.total = len(tokens)
        first_byte = np.cumsum(token_bytes(path)[tokens]) - token_bytes(path)[tokens]
        #: Tokens that begin before each code point.
        self.before = np.append(np.searchsorted(first_byte, starts, "left"), self.total)
        self.cuts = {}

    def tokens(self, a: int, b: int) -> int:
        return int(self.before[b] - self.before[a])

    def counted(self, a: int, b: int) -> int:
        return len(encoded(self.text[a:b], self.path))

    def at(self, level: str) -> np.ndarray:
        if level not in self.cuts:
            self.cuts[level] = np.array([m.end() for m in BOUNDARIES[level].finditer(self.text)], np.int64)
        return self.cuts[level]

    def parts(self, a: int, b: int, room: int, level: int = 0) -> Iterator[tuple[int, str]]:
        """(end, level of the cut) of consecutive parts of [a, b) with at most `room` tokens each; the last end is b."""
        todo = [(a, b, level, "end")]
        while todo:
            a, b, level, cut = todo.pop()
            if self.tokens(a, b) <= room:
                yield b, cut
            elif LEVELS[level] == "character":
                end = a + 1
                while a < b:
                    end = max(a + 1, int(np.searchsorted(self.before[a : b + 1], self.before[a] + room, "right")) + a - 1)
                    end = min(end, b)
                    yield end, cut if end == b else "character"
                    a = end
            else:
                inner = self.at(LEVELS[level])
                inner = inner[np.searchsorted(inner, a, "right") : np.searchsorted(inner, b, "left")].tolist()
                ends = [*((e, LEVELS[level]) for e in inner), (b, cut)]
                begins = [a, *inner]
                todo += [(s, e, level + 1, c) for s, (e, c) in zip(begins, ends, strict=True)][::-1]

    def shared(self, a: int, end: int) -> int:
        """Where the piece after [a, end) begins."""
        if not self.overlap:
            return end
        least = int(np.searchsorted(self.before[: end + 1], self.before[end] - self.overlap, "left"))
        least = max(least, a + 1)
        words = self.at("word")
        k = int(np.searchsorted(words, least, "left"))
        # A word that begins in the older half of the overlap; where there is none, the exact place.
        if k < len(words) and words[k] < end and self.tokens(int(words[k]), end) * 2 >= self.overlap:
            return int(words[k])
        return min(least, end)

    def pieces(self) -> Iterator[tuple[int, int, int, str]]:
        """(start, end, tokens, level of the cut at its end)."""
        room = self.limit - SLACK
        parts = list(self.parts(0, len(self.text), room - self.overlap))
        start, done = 0, 0
        while done < len(self.text):
            k = self._part_after(parts, done)
            end, cut = parts[k]
            while k + 1 < len(parts) and self.tokens(start, parts[k + 1][0]) <= room:
                k += 1
                end, cut = parts[k]
            end, cut, n = self._fitting(start, end, cut)
            if end <= done:  # the overlap leaves no room for what follows it
                start = done
                continue
            yield start, end, n, cut
            start, done = self.shared(start, end), end

    @staticmethod
    def _part_after(parts: list[tuple[int, str]], end: int) -> int:
        lo, hi = 0, len(parts)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if parts[mid][0] <= end else (lo, mid)
        return lo

    def _fitting(self, start: int, end: int, cut: str) -> tuple[int, str, int]:
        """The largest end not above `end` for which the piece, counted by itself, is within the limit; cut back by words, then characters."""
        n = self.counted(start, end)
        while n > self.limit and end > start + 1:
            words = self.at("word")
            target = int(np.searchsorted(self.before[: end + 1], self.before[end] - max(1, n - self.limit), "left"))
            target = max(min(target, end - 1), start + 1)
            k = int(np.searchsorted(words, target, "right")) - 1
            end, cut = (int(words[k]), "word") if k >= 0 and words[k] > start and self.tokens(int(words[k]), target) < self.limit // 4 else (target, "character")
            n = self.counted(start, end)
        return end, cut, n


def split(df: DataFrame, id: str, text: str, limit: int = 512, overlap: int = 64, path: str = VOCABULARY) -> DataFrame:
    """(id, piece, start, end, n_tokens, cut, text) of every text of more than `limit` tokens.

    Pieces are numbered from 0 in order, have at most `limit` tokens (a single character that has more stays whole) and together cover the text:
    each begins before or at the end of the one before. Neighbours share up to `overlap` tokens: exactly as many where no word begins in the older
    half of the overlap, else from that word on. `cut` names the boundary at the piece's end. start and end count code points.
    Null, empty and short texts give no rows; every row with a long text is split, repeated rows too. Other columns are ignored.
    """
    if not 0 <= overlap <= limit // 2 or limit < 16:
        raise ValueError("the limit must be at least 16 tokens and the overlap at most half of it")
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = spread(rows.filter(F.octet_length("text") > limit), "id")  # a token has at least one byte

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, body in zip(batch["id"], batch["text"], strict=True):
                of = Splitter(body, limit, overlap, path)
                if of.total > limit:
                    out += [(key, k, a, b, n, cut, body[a:b]) for k, (a, b, n, cut) in enumerate(of.pieces())]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "end", "n_tokens", "cut", "text"])

    kind = df.schema[id].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, piece int, start int, end int, n_tokens int, cut string, text string").withColumnRenamed("id", id)
