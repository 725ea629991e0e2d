"""Exact deduplication by content hash, with bytes compared inside each group.

Rows are grouped by a 128-bit hash of the normalised text together with the
text itself. The hash spreads the rows and the text, compared byte for byte,
separates texts whose hashes collide. Spark aggregates before it shuffles, so a
group with a third of all rows leaves each task as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id of the rows with the same normalised text.
    Null texts equal empty ones. Repeated rows with the smallest doc_id are all
    kept (no id tells them apart). A null doc_id is never preferred to another;
    a group of null ids only keeps them all. An empty table gives no rows. Other
    columns of docs are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("h"))
    sha = F.sha2(F.col("norm"), 256)
    classes = (
        rows.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(sha.alias("text_sha256"), "keep_id", "group_size")
    )
    light = rows.select("doc_id", sha.alias("text_sha256"))
    return light.join(classes, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
