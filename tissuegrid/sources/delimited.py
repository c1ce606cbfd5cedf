"""Lines of delimited text: typed rows from the valid ones, the others apart with the reason of their failure.

Structure (quoting, number of fields) is judged line by line. Values are judged once for each distinct value of a column: the invalid ones
form a dictionary (column, value, reason), which is joined back to the lines. Everything is built from JVM expressions. Lines are parsed once, and their
fields written to the shared folder; the dictionary reads one column of fields at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.common import fresh, stage


@dataclass(frozen=True)
class Field:
    """A column of the file. valid: tells of a value whether it is in order (null means it isn't); typed: its cast; reason: the reason given otherwise."""

    name: str
    valid: Callable[[Column], Column] | None = None
    typed: Callable[[Column], Column] = lambda c: c
    trim: bool = False

    def text(self, raw: Column) -> Column:
        return F.trim(raw) if self.trim else raw


def _fold(parts: Column) -> Column:
    """Put the parts between separators together to fields: (fields, open, bad). Inside quotes a separator is text, and a doubled quote stands for one."""
    empty = F.struct(F.array().cast("array<string>").alias("fields"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("bad"))

    def step(state: Column, part: Column) -> Column:
        inside = state["open"].isNotNull()
        quoted = inside | F.startswith(part, F.lit('"'))
        text = F.when(inside, part).otherwise(F.substring(part, 2, 2147483647))
        bare = F.replace(text, F.lit('""'), F.lit(""))  # what is left of quotes after taking out the doubled ones, from the left
        at = F.instr(bare, '"')
        ends, fine = at > 0, at == F.length(bare)
        so_far = F.when(inside, F.concat(state["open"], F.lit("\t"), text)).otherwise(text)
        value = F.replace(F.substring(so_far, F.lit(1), F.length(so_far) - 1), F.lit('""'), F.lit('"'))
        field = F.when(quoted & ends, value).when(~quoted, part)
        return F.struct(
            F.when(field.isNull(), state["fields"]).otherwise(F.concat(state["fields"], F.array(field))).alias("fields"),
            F.when(quoted & ~ends, so_far).alias("open"),
            (state["bad"] | F.coalesce(quoted & ends & ~fine, F.lit(False))).alias("bad"),
        )

    return F.aggregate(parts, empty, step)


def fields_of(raw: Column, separator: str = "\t") -> Column:
    """(fields, bad) of a line. One carriage return at its end is dropped. A null line counts as an empty one, which has one empty field."""
    line = F.coalesce(raw, F.lit(""))
    line = F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    parts = F.split(line, separator, -1)
    folded = _fold(parts)
    general = F.struct(folded["fields"].alias("fields"), (folded["bad"] | folded["open"].isNotNull()).alias("bad"))
    # Without doubled quotes fields can be matched one by one; characters that no match takes stand after a closing quote or behind one that never closes.
    led = F.concat(F.lit(separator), line)
    matches = F.regexp_extract_all(led, F.lit(rf'{separator}(?:"[^"]*+"|[^"{separator}][^{separator}]*+|)'), F.lit(0))
    text = lambda m: F.when(F.startswith(m, F.lit(separator + '"')), F.substring(m, F.lit(3), F.length(m) - 3)).otherwise(F.substring(m, 2, 2147483647))
    simple = F.struct(F.transform(matches, text).alias("fields"), (F.length(F.array_join(matches, "")) != F.length(led)).alias("bad"))
    plain = F.struct(parts.alias("fields"), F.lit(False).alias("bad"))
    return F.when(~F.contains(line, F.lit('"')), plain).when(~F.contains(line, F.lit('""')), simple).otherwise(general)


def judge(df: DataFrame, raw: str, fields: list[Field]) -> DataFrame:
    """`df` with `reason` (null for a valid line) and `values`, a struct of the fields as text (null for a line of wrong structure).

    The first reason that holds is given: `quoting`, `columns`, then the names of the fields in their order. Repeated lines are judged alike,
    each for itself; extra columns stay as they are, but for columns called reason or values, which are replaced (unless one of them is the raw
    line). An empty table gives an empty result.
    """
    df = df.drop(*(c for c in df.columns if c.lower() in ("reason", "values") and c != raw))
    if raw.lower() in ("reason", "values"):
        line = fresh(df, "raw_line")
        df, raw = df.withColumnRenamed(raw, line), line
    parsed = fresh(df, "_parsed")
    split = df.withColumn(parsed, fields_of(F.col(raw)))
    bad, of = F.col(f"{parsed}.bad"), F.col(f"{parsed}.fields")
    structure = F.when(bad, F.lit("quoting")).when(F.size(of) != len(fields), F.lit("columns"))
    held = [fresh(df, f"_field_{i}") for i in range(len(fields))]
    texts = [F.when(F.col("reason").isNull(), f.text(F.get(of, i))).alias(h) for i, (f, h) in enumerate(zip(fields, held, strict=True))]
    rows = stage(split.withColumn("reason", structure).select(*df.columns, "reason", *texts))
    reason = F.col("reason")
    for f, h in zip(fields, held, strict=True):
        if f.valid:
            key = fresh(rows, f"_{f.name}_wrong")
            invalid = stage(rows.filter("reason is null").select(F.col(h).alias(key)).distinct().filter(~F.coalesce(f.valid(F.col(key)), F.lit(False))))
            rows = rows.join(invalid, F.col(h) == F.col(key), "left")
            reason = F.coalesce(reason, F.when(F.col(key).isNotNull(), F.lit(f.name)))
    values = F.struct(*(F.col(h).alias(f.name) for f, h in zip(fields, held, strict=True)))
    found = fresh(rows, "_structure")
    return rows.withColumn(found, F.col("reason")).withColumn("reason", reason).select(*df.columns, "reason", F.when(F.col(found).isNull(), values).alias("values"))


def faults(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").drop("values")


def valid_rows(judged: DataFrame, fields: list[Field], *keep: str) -> DataFrame:
    """The valid lines as typed columns, beside the columns in `keep`."""
    return judged.filter("reason is null").select(*keep, *(f.typed(F.col("values")[f.name]).alias(f.name) for f in fields))


def reason_counts(judged: DataFrame, by: list[str]) -> DataFrame:
    return judged.groupBy(*by, F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("lines"))


#: A record of a split prediction file.
BARCODE = r"\A[ACGT]{16}[-.][0-9]+(?:[-.][0-9]+)?\z"
DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
CELL_TYPES = ("aneuploid", "diploid", "not.defined")

PREDICTION = [
    Field("cell_id", lambda c: c.rlike(BARCODE), trim=True),
    Field("cell_type", lambda c: F.lower(c).isin(*CELL_TYPES), lambda c: F.lower(c), trim=True),
    Field("score", lambda c: (c == "") | (c.rlike(DECIMAL) & F.coalesce(c.try_cast("double").between(0, 1), F.lit(False))), lambda c: c.try_cast("double"), trim=True),
    Field("note"),
]

__all__ = ["Field", "PREDICTION", "faults", "fields_of", "judge", "reason_counts", "valid_rows"]
