"""Line deduplication with overlapping three-line windows.

A text's lines are hashed; each run of ``window`` consecutive lines is a window,
known by a 128-bit hash. Of the windows that occur more than once in the corpus,
the first occurrence (by doc_id, then position) stays, and every later one
covers its lines. Covered positions are merged, and covered lines go.

Only DataFrame functions are used. Windows are counted with partial aggregation,
so a window that a third of all documents share costs one row per task; finding
its later occurrences is a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

WINDOW = 3
_BLANK = " \t\n\x0b\x0c\r"


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, pos, w1, w2: a row for each window that has a line which isn't blank."""
    trimmed = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANK)))
    hashed = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (x != "").alias("says")))
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), hashed.alias("l")).where(F.size("l") >= window)
    at = F.sequence(F.lit(0), F.size("l") - window)

    def key(i):
        part = [F.element_at(F.col("l"), i + 1 + k) for k in range(window)]
        says = part[0]["says"]
        for x in part[1:]:
            says = says | x["says"]
        return F.struct(i.alias("pos"), F.xxhash64(*[x["a"] for x in part]).alias("w1"), F.xxhash64(*[x["b"] for x in part]).alias("w2"), says.alias("says"))

    w = d.select("doc_id", "text_hash", F.explode(F.transform(at, key)).alias("w"))
    return w.where("w.says").select("doc_id", "text_hash", "w.pos", "w.w1", "w.w2")


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, covered: the line positions (from 0) that later occurrences cover."""
    w = line_windows(docs, window)
    place = F.struct("doc_id", "text_hash", "pos")
    repeated = w.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = w.join(repeated.select("w1", "w2", "first"), ["w1", "w2"]).where(place != F.col("first"))
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))
    merged = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + window - 1))))
    return starts.select("doc_id", "text_hash", F.array_sort(merged).alias("covered"))


def line_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text cleaned and the columns n_lines and n_removed added.

    Lines are compared without the white space around them. Texts with fewer
    lines than a window, windows of blank lines only and null texts stay as they
    are (a null text has 0 lines, an empty one has 1). Rows that repeat an
    earlier row wholly, doc_id and text, count as that row: what happens to one
    happens to each. Null ids come first in order. All columns of docs stay; the
    new ones get underscores in front where docs has their names already.
    """
    key = fresh(docs, "text_hash")
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    c = covered_lines(docs, window).alias("c")
    j = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"d.{key}") == F.col("c.text_hash")), "left")
    lines = F.split(F.col("d.text"), "\n")
    # the difference of two sets of positions is linear, and keeps their order
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("c.covered"))
    text = F.when(F.col("c.covered").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n"))
    return j.select(
        *[text.alias("text") if x.lower() == "text" else F.col(f"d.`{x}`") for x in docs.columns],
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(fresh(docs, "n_lines")),
        F.coalesce(F.size("c.covered"), F.lit(0)).cast("long").alias(fresh(docs, "n_removed")),
    )


def line_dedup_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with cleaned texts and its own columns only; n_chars follows the text. Odd rows as in line_dedup()."""
    out = line_dedup(docs, window).select(*[f"`{c}`" for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op6_line_dedup(spark, sf_dir):
    """Lines of each row of documents, how many go, and the length and MD5 of what stays (null for null texts)."""
    d = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM l WHERE len(lines) >= 3
), w AS (
  SELECT doc_id, pos, [trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN lines[pos + 1:pos + 3]] AS k FROM t
), f AS (
  SELECT doc_id, pos, k, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM w WHERE len([x FOR x IN k IF x <> '']) > 0
), c AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM f, (SELECT unnest([0, 1, 2]) AS d) WHERE nth > 1
), s AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM l
), k AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM s ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(kept, '')) END AS kept_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(kept, '')) END AS kept_md5
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
