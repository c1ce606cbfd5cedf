import random

import tissuegrid.llm.leakage as leakage
from tissuegrid.llm.leakage import Automaton, passages, words

DOCS, ITEMS = "doc_id long, text string, item long, words int", "item_id long, question string, answer string"


def by_hand(docs, items, n):
    out = set()
    windows = {}
    for item, *fields in items:
        for name, text in zip(("question", "answer"), fields):
            w = words(text)
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add((item, name))
    for doc, text, *_ in docs:
        w = words(text)
        for k in range(len(w) - n + 1):
            out |= {(doc, item, name) for item, name in windows.get(tuple(w[k : k + n]), ())}
    return out


def sample():
    r = random.Random(9)
    vocabulary = ["Alpha", "beta", "Été", "ñandú", "42", "漢字", "ΣΊΣΥΦΟΣ", "İstanbul", "x_y", "ﬁn", "straße", "naïve", "o'clock", "1,000"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.randint(2, 30)), say(r.randint(0, 14)) or None) for k in range(60)] + [(99, None, ""), (100, "same text " * 8, "same text " * 8), (101, "same text " * 8, None)]
    docs = []
    for k in range(300):
        w = words(r.choice(items)[1]) or ["none"]
        a = r.randint(0, max(0, len(w) - 5))
        part = r.choice([" ", "\n", " -- ", "​", "_"]).join(x.upper() if k % 3 else x for x in w[a : a + r.randint(4, 20)])
        docs.append((k, f"{say(r.randint(0, 20))} <b>{part}</b>! {say(5)}", 1, 1))
    return docs + [(900, None, 1, 1), (901, "", 1, 1), (902, "word " * 50_000 + "same text " * 3, 1, 1)] + docs[:5], items


def test_against_windows(spark):
    docs, items = sample()
    got = passages(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", ["question", "answer"], 5).collect()
    assert {(r.doc_id, r.item_id, r.field) for r in got} == by_hand(docs, items, 5)
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        piece = words(texts[r.doc_id][r.start : r.end])
        assert len(piece) == r.words >= 5
        assert (r.doc_id, r.item_id, r.field) in by_hand([(r.doc_id, texts[r.doc_id][r.start : r.end])], items, 5)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = sample()
    monkeypatch.setattr(leakage, "BLOCK", 300)
    got = passages(spark.createDataFrame(docs, DOCS), "doc_id", "text", spark.createDataFrame(items, ITEMS), "item_id", ["question", "answer"], 5).collect()
    assert {(r.doc_id, r.item_id, r.field) for r in got} == by_hand(docs, items, 5)


def test_runs_and_offsets():
    a = Automaton([(1, "q", "one two three four five six")], 3)
    assert a.scan("ONE, two; three four! x five six one_two_three") == [(1, "q", 0, 20, 4), (1, "q", 33, 46, 3)]
    assert a.scan("one two") == [] and a.scan(None) == [] and Automaton([], 3).scan("one two three") == []


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full = spark.createDataFrame([(1, "a b c d e f", 1, 1)], DOCS)
    for d, i in ((docs, items), (full, items), (docs, spark.createDataFrame([(1, "a b c d e f", None)], ITEMS))):
        assert passages(d, "doc_id", "text", i, "item_id", ["question", "answer"], 5).count() == 0
