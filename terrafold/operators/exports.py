"""Lines of the files that an assembly leaves: CSV fields, numbers as Python prints them, transforms and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import col, fixed

#: The head of joins.csv and what a file begins with, fixed values.
BOM = "\ufeff"
JOIN_COLUMNS = ("fragment_a", "fragment_b", "band", "in_assembly", "group", "score", "seam_t", "tight", "gap_t", "normal_agreement", "penetration")


def csv_field(c: str | Column) -> Column:
    """Quoted where it has a comma, a quote or a line end; quotes are doubled. Null is empty."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def html_text(c: str | Column) -> Column:
    """Text with &, <, > and quotes escaped."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def python_float(c: str | Column) -> Column:
    """A number as Python's str() has it: positional from 1e-4 to under 1e16, else with an exponent of two digits at least; nan, inf and -inf."""
    x = col(c).cast("double")
    text = x.cast("string")
    part = lambda i: F.regexp_extract(text, r"^-?(\d+)\.(\d+)(?:E(-?\d+))?$", i)
    whole, behind, power = part(1), part(2), F.try_to_number(part(3), F.lit("S999")).cast("int")
    zeros = F.length(behind) - F.length(F.ltrim(behind, F.lit("0")))
    # of the first digit that isn't 0
    place = F.when(power.isNotNull(), power).when(whole != "0", F.length(whole) - 1).otherwise(-zeros - 1)
    digits = F.rtrim(F.ltrim(F.concat(whole, behind), F.lit("0")), F.lit("0"))
    rest = lambda skip: F.substring(digits, skip + 1, F.length(digits))
    large = F.concat(F.rpad(F.substring(digits, F.lit(1), place + 1), place + 1, F.lit("0")), F.lit("."), F.when(F.length(digits) > place + 1, rest(place + 1)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place - 1), digits)
    tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), rest(F.lit(1)))).otherwise("")
    sized = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(place < 0, "-").otherwise("+"), F.when(F.abs(place) < 10, "0").otherwise(""), F.abs(place).cast("string"))
    shown = F.when(x == 0, "0.0").when((place < -4) | (place > 15), sized).when(place < 0, small).otherwise(large)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.concat(F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), shown))


def python_bool(c: str | Column) -> Column:
    return F.when(col(c), "True").when(~col(c), "False").otherwise("None")


def join_lines(joins: DataFrame) -> DataFrame:
    """a, b, band_rank, score, line: joins(a, b, name_a, name_b, tier, in_assembly, grp, score, seam, tight, gap, cont, pen) as lines of joins.csv; rejected ones have none."""
    j = joins.where("tier in ('confirmed', 'probable')")
    parts = [csv_field("name_a"), csv_field("name_b"), F.col("tier"), F.col("in_assembly").cast("int").cast("string"), F.coalesce(F.col("grp").cast("string"), F.lit("")), fixed("score", 3), fixed("seam", 2), fixed("tight", 3), fixed("gap", 4), fixed("cont", 3), fixed("pen", 4)]
    return j.select("a", "b", F.when(F.col("tier") == "confirmed", 0).otherwise(1).alias("band_rank"), "score", F.concat_ws(",", *parts).alias("line"))


def matrix_text(pose: str | Column) -> Column:
    """A pose as four lines of four numbers, as viewers of point clouds read a transformation."""
    rows = [F.concat_ws(" ", *[python_float(F.element_at(col(pose), 4 * i + j + 1)) for j in range(4)]) for i in range(3)]
    return F.concat_ws("\n", *rows, F.lit("0.0 0.0 0.0 1.0"))


def write_matrices(nodes: DataFrame, path: str) -> None:
    """The pose of each of nodes(name, pose) as a text under path/name=NAME; nodes without one have none."""
    nodes.where("pose is not null").select("name", matrix_text("pose").alias("value")).repartition("name").write.partitionBy("name").text(path)


def transform_lines(nodes: DataFrame) -> DataFrame:
    """node, line: nodes(node, name, source, grp, pose) as lines of transforms.csv: the group (empty without one), whether it is assembled, and sixteen numbers."""
    cells = [python_float(F.element_at("pose", i + 1)) for i in range(12)] + [F.lit(x) for x in ("0.0", "0.0", "0.0", "1.0")]
    parts = [csv_field("name"), csv_field("source"), F.coalesce(F.col("grp").cast("string"), F.lit("")), F.col("grp").isNotNull().cast("int").cast("string"), *cells]
    return nodes.select("node", F.concat_ws(",", *parts).alias("line"))


def write_lines(lines: DataFrame, head: str, order: list, path: str) -> None:
    """One head line in each part, then the lines, sorted over all parts."""
    def with_head(batches):
        import pandas as pd

        first = True
        for b in batches:
            yield pd.DataFrame({"line": ([BOM + head] if first else []) + list(b["line"])})
            first = False

    lines.orderBy(*order).select("line").mapInPandas(with_head, "line string").write.text(path)
