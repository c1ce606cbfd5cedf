import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tissuegrid.llm.splitting import Splitter, split
from tissuegrid.llm.tokens import VOCABULARY, encoded


def check(text, limit, overlap):
    of = list(Splitter(text, limit, overlap, VOCABULARY).pieces())
    assert of[0][0] == 0 and of[-1][1] == len(text)
    for start, end, n, _ in of:
        assert start < end and n == len(encoded(text[start:end], VOCABULARY))
        assert n <= limit or end == start + 1
    rebuilt, at = "", 0
    for start, end, _, _ in of:
        assert start <= at < end
        rebuilt, at = rebuilt + text[at:end], end
    assert rebuilt == text
    for (a, b, _, _), (c, _, _, _) in zip(of, of[1:]):
        assert a < c and len(encoded(text[c:b], VOCABULARY)) <= overlap + 3
    return of


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=900), st.sampled_from([16, 20, 64]), st.sampled_from([0, 3, 8]))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@pytest.mark.parametrize("text", ["a" * 60_000, "漢字" * 9_000, " " * 20_000, "xYz9/+" * 9_000, "👩‍👩‍👧" * 3_000, "\r\n" * 4_000, "one two. " * 6_000])
def test_long_texts(text):
    check(text, 512, 64)


def test_overlap_is_exact_without_words_and_natural_with_them():
    of = check("漢" * 5_000, 128, 32)
    assert all(len(encoded(("漢" * 5_000)[c:b], VOCABULARY)) in range(28, 33) for (_, b, _, _), (c, _, _, _) in zip(of, of[1:]))
    text = " ".join(random.Random(3).choice(["alpha", "beta", "gamma."]) for _ in range(3_000))
    of = check(text, 128, 32)
    assert all(text[c - 1] == " " for c, _, _, _ in of[1:])
    assert all(16 <= len(encoded(text[c:b], VOCABULARY)) for (_, b, _, _), (c, _, _, _) in zip(of, of[1:]))


def test_cuts_are_natural():
    paragraph = "The reader keeps every row. " * 12
    text = "\n\n".join([paragraph.strip()] * 12)
    cuts = [c for *_, c in check(text, 200, 20)]
    assert set(cuts[:-1]) == {"paragraph"} and cuts[-1] == "end"
    sections = "\n".join(f"# Part {k}\n\n{paragraph}\n" for k in range(6))
    assert set([c for *_, c in check(sections, 120, 8)][:-1]) == {"section"}


def test_table(spark):
    rows = [(1, "short", 0), (2, None, 0), (3, "", 0), (4, "word " * 900, 0), (4, "word " * 900, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = split(df, "doc_id", "text", 100, 10).collect()
    assert {r.doc_id for r in got} == {4} and all(r.n_tokens <= 100 for r in got)
    assert len({(r.piece, r.start, r.end) for r in got}) * 2 == len(got)
    assert split(df.limit(0), "doc_id", "text").count() == 0
