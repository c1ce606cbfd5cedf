import csv
import io
import random
import re

import pytest

from tissuegrid.sources.delimited import BARCODE, DECIMAL, PREDICTION, faults, judge, reason_counts, valid_rows

GOOD = "ACGTACGTACGTACGT-1"


def reason_by_hand(line):
    """The rules, character by character."""
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    fields, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            value, k = "", at + 1
            while True:
                if k >= len(line):
                    return "quoting", None
                if line[k] == '"' and line[k + 1 : k + 2] == '"':
                    value, k = value + '"', k + 2
                elif line[k] == '"':
                    break
                else:
                    value, k = value + line[k], k + 1
            at = k + 1
            if at < len(line) and line[at] != "\t":
                return "quoting", None
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            value, at = line[at:end], end
        fields.append(value)
        if at >= len(line):
            break
        at += 1
    if len(fields) != 4:
        return "columns", None
    cell, kind, score = (f.strip(" ") for f in fields[:3])
    if not re.fullmatch(BARCODE[2:-2], cell):
        return "cell_id", None
    if kind.lower() not in ("aneuploid", "diploid", "not.defined"):
        return "cell_type", None
    if score and not (re.fullmatch(DECIMAL[2:-2], score, re.ASCII) and 0 <= float(score) <= 1):
        return "score", None
    return None, (cell, kind.lower(), float(score) if score else None, fields[3])


CASES = [
    None, "", "\r", "\t\t\t", f"{GOOD}\tdiploid\t0.5\tnote", f"{GOOD}\tdiploid\t0.5\tnote\r", f'"{GOOD}"\t" Diploid "\t" 1e0 "\t"a\tb\nc ""d"""', f'{GOOD}\tdiploid\t0.5\t"open', f'{GOOD}\tdiploid\t0.5\t"x"y',
    f'{GOOD}\tdiploid\t0.5\t""', f'{GOOD}\tdiploid\t0.5\t"', f'{GOOD}\tdiploid\t0.5\t"""', f'{GOOD}\tdiploid\t0.5\t""""', f'{GOOD}\tdiploid\t0.5\ta "b" c', f"{GOOD}\tdiploid\t\t", f"{GOOD}\tdiploid\tNaN\t", f"{GOOD}\tdiploid\t1.0001\t",
    f"{GOOD}\tdiploid\t-0.0\t", f"{GOOD}\tdiploid\t+.5\t", f"{GOOD}\tdiploid\t1e999\t", f"{GOOD}\tdiploid\t0x1\t", f"{GOOD}\ttumor\t2\t", f"{GOOD}-2.3\tdiploid\t0\t", f"{GOOD}.7-8\tNOT.DEFINED\t0\t", "ACGT-1\tdiploid\t0\t",
    f"{GOOD}\tdiploid\t0.5", f"{GOOD}\tdiploid\t0.5\tx\ty", f'"{GOOD}\n"\tdiploid\t0\t', f'"{GOOD}" \tdiploid\t0\t', f"{GOOD}\tdiploid\t0\t" + "long " * 40_000, f'{GOOD}\tdiploid\t0\t"' + '""' * 30_000 + '"',
]


def random_lines(n):
    r = random.Random(5)
    pieces = ['"', '""', "\t", "\t", GOOD, "diploid", "0.5", " ", "\n", "\r", "x", "aneuploid", "\\"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_against_rules_by_hand(spark):
    lines = CASES + random_lines(600) + CASES[:9]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    judged = judge(df, "raw_line", PREDICTION)
    got = {r.line_id: r.reason for r in faults(judged).collect()}
    typed = {r.line_id: (r.cell_id, r.cell_type, r.score, r.note) for r in valid_rows(judged, PREDICTION, "line_id").collect()}
    for k, line in enumerate(lines):
        reason, row = reason_by_hand(line)
        assert got.get(k) == reason, (line, got.get(k), reason)
        assert typed.get(k) == row, line
    assert len(got) + len(typed) == len(lines)


def test_written_by_a_csv_writer(spark):
    r = random.Random(8)
    notes = ["".join(r.choice('ab"\t\n ') for _ in range(r.randint(0, 9))) for _ in range(200)]
    rows = []
    for k, note in enumerate(notes):
        out = io.StringIO()
        csv.writer(out, delimiter="\t", lineterminator="", quoting=csv.QUOTE_ALL).writerow([GOOD, "diploid", "0.25", note])
        rows.append((k, out.getvalue()))
    judged = judge(spark.createDataFrame(rows, "line_id long, raw_line string"), "raw_line", PREDICTION)
    assert {r.line_id: r.note for r in valid_rows(judged, PREDICTION, "line_id").collect()} == dict(enumerate(notes))


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, f"{GOOD}\ttumor\t0\t", "x", "y", "z")], "line_id long, raw_line string, reason string, values string, _parsed string")
    got = judge(df, "raw_line", PREDICTION)
    assert got.first().reason == "cell_type" and got.first()._parsed == "z"
    renamed = df.select("line_id", df.raw_line.alias("values"))
    assert judge(renamed, "values", PREDICTION).first().reason == "cell_type"
    none = judge(df.limit(0), "raw_line", PREDICTION)
    assert faults(none).count() == 0 and reason_counts(none, ["line_id"]).count() == 0


@pytest.mark.parametrize("hot", [None, "", "tumor"])
def test_one_value_in_most_lines(spark, hot):
    lines = [f"{GOOD}\t{hot}\t0\t" if hot is not None else None for _ in range(3000)] + [f"{GOOD}\tdiploid\t0\t"] * 10
    judged = judge(spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "line_id long, raw_line string"), "raw_line", PREDICTION)
    assert {r.reason: r["count"] for r in judged.groupBy("reason").count().collect()} == {"columns" if hot is None else "cell_type": 3000, None: 10}
