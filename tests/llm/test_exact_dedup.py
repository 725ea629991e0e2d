import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from terrafold.llm.exact_dedup import exact_dedup

from .helpers import DOCS, doc_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    g = defaultdict(list)
    for r in rows:
        g[norm(r[1])].append(r[0])
    low = {k: min([x for x in v if x is not None], default=None) for k, v in g.items()}
    return sorted(((r[0], low[norm(r[1])], len(g[norm(r[1])]), r[0] == low[norm(r[1])], hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows), key=str)


def test_against_brute_force(spark):
    rows = doc_rows()
    got = exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_colliding_hashes_are_told_apart(spark):
    rows = doc_rows()
    got = exact_dedup(spark.createDataFrame(rows, DOCS), content_hash=lambda c: F.lit("same")).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, keep_id long, h string")
    assert sorted(r["keep_id"] for r in exact_dedup(df).collect()) == [1, 1]
