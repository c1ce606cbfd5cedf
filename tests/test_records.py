import re

import pytest
from pyspark.sql import functions as F

from tissuegrid.sources.delimited import PREDICTION, judge, valid_rows
from tissuegrid.sources.records import read_records

FIELD = re.compile(r'"(?:[^"]|"")*"|[^"\t][^\t]*|')


def well_quoted(text):
    """The rule of the format, field by field: None where a quoted field never ends, else whether the text is in order."""
    text, at = text.removesuffix("\r"), 0
    while True:
        found = FIELD.match(text, at)
        if not found.group() and text[at : at + 1] == '"':
            return None
        at = found.end()
        if at == len(text):
            return True
        if text[at] != "\t":
            return False
        at += 1


def brute(text, most):
    lines, out, at = text.removesuffix("\n").split("\n") if text else [], [], 0
    while at < len(lines):
        n = 1
        while at + n < len(lines) and n <= most and opens("\n".join(lines[at : at + n])):
            n += 1
        whole = "\n".join(lines[at : at + n])
        if n > 1 and (n > most or opens(whole) or not well_quoted(whole)):
            n = 1
        out.append("\n".join(lines[at : at + n]))
        at += n
    return out


def opens(text):
    """Whether a quoted field is open at the end; what follows a closed one belongs to it up to the next separator."""
    inside, fresh, at = False, True, 0
    while at < len(text):
        c = text[at]
        if inside and c == '"':
            if text[at + 1 : at + 2] == '"':
                at += 1
            else:
                inside = False
        elif not inside and c == '"' and fresh:
            inside = True
        elif not inside and c == "\t":
            fresh, at = True, at + 1
            continue
        fresh = False
        at += 1
    return inside


TEXTS = {
    "plain.tsv": "a\tb\nc\td\n",
    "quoted.tsv": 'a\t"one\ntwo"\nb\tc\n"x\n\n""y""\nz"\tq\nlast\t"a""b"\n',
    "broken.tsv": 'a\t"never\nb\t1\nc\t"fine"\nd\t"open\nend"\ne\n"z',
    "runs.tsv": "".join(f'{k}\t"open {k}\n' for k in range(7)) + 'ok\t"p\nq"\n',
    "junk.tsv": 'a\t"b"c\nd\t"e"f\t"g\nh"\ni\tsaid "x"\n\n"\n"\tq\r\nr\t"s"\r\n',
    "long.tsv": 'a\t"' + "\n" * 12 + 'b"\nc\td\n',
    "empty.tsv": "",
}


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_records_equal_brute_force(spark, tmp_path, split):
    for name, text in TEXTS.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = read_records(spark, str(tmp_path), most=10).orderBy("file", "split", "line").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in TEXTS.items():
        assert [r.raw_line for r in rows if r.file.endswith(name)] == brute(text, 10), name


def test_valid_rows_of_a_file(spark, tables, tmp_path):
    raw = spark.read.parquet(f"{tables}/cna_predictions_raw.parquet")
    known = valid_rows(judge(raw, "raw_line", PREDICTION), PREDICTION, "line_id")
    fine = raw.join(known.select("line_id"), "line_id", "left_semi").filter(~F.endswith("raw_line", F.lit("\r")))
    fine.select("raw_line").write.text(str(tmp_path / "lines"))
    got = [r.raw_line for r in read_records(spark, str(tmp_path / "lines")).collect()]
    assert sorted(got) == sorted(r.raw_line for r in fine.collect()) and any("\n" in r for r in got)
