"""Packing into optimal length buckets.

The global histogram of lengths goes to a dynamic program that chooses bucket
boundaries with the least padding; inside each bucket, batches are filled up to
a token budget. The histogram has a bounded number of bins: lengths up to 4,096
are exact, longer ones are rounded up to twelve significant bits, which is also
the length to which such documents are padded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Documents of a bucket are batched in this many at most at once; each such part leaves one batch that isn't full.
PART_ROWS = 8_192
EXACT_BITS = 12


def binned(n: Column) -> Column:
    """n, at least 1, rounded up to EXACT_BITS significant bits."""
    n = F.greatest(n, F.lit(1)).cast("long")
    bits = F.length(F.bin(n)) - EXACT_BITS
    unit = F.when(bits > 0, F.expr("1L") * F.pow(F.lit(2.0), bits)).otherwise(F.lit(1.0)).cast("long")
    return (F.ceil(n / unit) * unit).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """At most ``buckets`` upper boundaries with the least total of padded lengths.

    histogram has (length, count) with distinct lengths. best[j] is the least
    padded total of the first j lengths; the next layer takes the minimum over i
    of best[i] + length[j] * (count up to j - count up to i), which is the lower
    envelope of straight lines in length[j]. Slopes fall and queries rise, so
    each layer takes linear time.
    """
    h = sorted(histogram)
    n = len(h)
    if not n:
        return []
    upto = [0]
    for _, c in h:
        upto.append(upto[-1] + c)
    best = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        layer, came = [0] + [None] * n, [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        front = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, b = -upto[i], best[i]
                while len(hull) - front >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((m, b, i))
            x = h[j - 1][0]
            while len(hull) - front >= 2 and hull[front + 1][0] * x + hull[front + 1][1] <= hull[front][0] * x + hull[front][1]:
                front += 1
            if len(hull) > front:
                m, b, i = hull[front]
                layer[j], came[j] = m * x + b + x * upto[j], i
        choice.append(came)
        best = layer
    out, j = [], n
    for came in reversed(choice):
        if j:
            out.append(h[j - 1][0])
            j = came[j]
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = 11, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, pad_to, part, batch, slot: one row per row of docs.

    Tokens are words. A batch is known by (bucket, part, batch); it holds
    documents padded to pad_to, and batch size times pad_to is at most the
    budget (a document longer than the budget is a batch of its own). Null and
    empty texts have 0 tokens and are padded to the shortest boundary. Rows that
    repeat get slots of their own. An empty table gives no rows.
    """
    rows = stored(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")), "lengths")
    hist = rows.groupBy(binned(F.col("n_tokens")).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()
    bounds = optimal_boundaries([(r["n"], r["c"]) for r in hist], buckets) or [1]
    sizes = [0] * len(bounds)
    for r in hist:
        sizes[sum(r["n"] > b for b in bounds)] += r["c"]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds), F.lit(0))
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    r = rows.withColumn("bucket", bucket)
    r = r.withColumn("pad_to", of(bounds)).withColumn("part", F.pmod(F.shiftright("h", 16), of([-(-s // part_rows) or 1 for s in sizes])))
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", "doc_id")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("pad_to"))).cast("long")
    return r.withColumn("place", place).select(
        "doc_id", "n_tokens", "bucket", "pad_to", "part", F.floor(F.col("place") / each).alias("batch"), (F.col("place") % each).alias("slot")
    )


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
