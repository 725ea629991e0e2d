"""Robust statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_mode(rows: DataFrame, key: str, value: str, bins: int = 60, quantile: float = 0.9) -> DataFrame:
    """key, mode: centre of the fullest of ``bins`` bins on [0, quantile]; the first one on ties.

    The last bin is closed on the right; larger values are left out.
    """
    top = rows.groupBy(key).agg(F.percentile(value, F.lit(quantile)).alias("top"))
    r = rows.select(key, F.col(value).alias("v")).join(top, key).where((F.col("v") >= 0) & (F.col("v") <= F.col("top")) & (F.col("top") > 0))
    b = F.least(F.lit(bins - 1), F.floor(F.col("v") / F.col("top") * bins))
    counts = r.groupBy(key, "top", b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(key).agg(F.max_by(F.struct("bin", "top"), F.struct("c", -F.col("bin"))).alias("m"))
    return best.select(key, ((F.col("m.bin") + 0.5) * F.col("m.top") / bins).alias("mode"))


def median_and_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med, mad: exact median and median absolute deviation; null and NaN are passed over."""
    r = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    m = r.groupBy(*keys).agg(F.median("v").alias("med"), F.count(F.lit(1)).alias("n"))
    d = r.join(m, keys).groupBy(*keys, "n", "med").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return d.select(*keys, "n", "med", "mad")


def consensus(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, feature, n, med, mad: the consensus of each feature over a group's members."""
    long = rows.select(key, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([key], features, "feature", "v")
    return median_and_mad(long, [key, "feature"], "v")


def _others_median(keys: list[str], order: list[str], value: str) -> tuple[Column, Column]:
    """Median of the group's other rows, and their number.

    Only three order statistics of the group can be it, so they are picked by
    rank; no row is compared with each other one.
    """
    group = Window.partitionBy(*keys)
    rank, n = F.row_number().over(group.orderBy(value, *order)), F.count(F.lit(1)).over(group)
    return rank, n


def leave_one_out_median(rows: DataFrame, keys: list[str], ident: str, value: str, name: str) -> DataFrame:
    """rows with the median of ``value`` over the other rows of the group (null when alone)."""
    rank, n = _others_median(keys, [ident], value)
    r = rows.withColumn("_rank", rank).withColumn("_n", n)
    group = Window.partitionBy(*keys)
    # the others are n - 1: their middle ranks, each moved up by one from the row's own rank on
    low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)
    at = lambda k: F.max(F.when(F.col("_rank") == k, F.col(value))).over(group)
    r = r.withColumn("_a", at(low)).withColumn("_b", at(low + 1)).withColumn("_c", at(high)).withColumn("_d", at(high + 1))
    first = F.when(F.col("_rank") > low, F.col("_a")).otherwise(F.col("_b"))
    second = F.when(F.col("_rank") > high, F.col("_c")).otherwise(F.col("_d"))
    out = F.when(F.col("_n") > 1, (first + second) / 2)
    return r.withColumn(name, out).drop("_rank", "_n", "_a", "_b", "_c", "_d")


def leave_one_out_deviation(rows: DataFrame, key: str, ident: str, value: str, k: float, least: float = 0.0, min_members: int = 3) -> DataFrame:
    """key, ident, med, mad, times: how many MADs a member is from the median of its group's other members.

    The others' median is one of at most four values in a group. For each of
    these, deviations are ranked once, and the others' MAD is again picked by rank.
    Groups with fewer than ``min_members`` others have no row.
    """
    r = rows.select(F.col(key), F.col(ident), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    r = leave_one_out_median(r, [key], ident, "v", "med").where("med is not null")
    mids = r.select(key, "med").distinct()
    spread = r.select(key, ident, "v").join(mids, key).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    spread = leave_one_out_median(spread, [key, "med"], ident, "dev", "mad")
    size = r.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("others"))
    j = r.join(spread.select(key, ident, "med", "mad"), [key, ident, "med"]).join(size, key).where(F.col("others") >= min_members)
    times = F.try_divide(F.abs(F.col("v") - F.col("med")), F.greatest("mad", F.lit(least)))  # null without any spread
    return j.select(key, ident, "med", "mad", times.alias("times"), (times > k).alias("deviates"))


def edge_use(rows: DataFrame, a: str, b: str, most_open: float = 0.002) -> DataFrame:
    """One row: n_edges, n_boundary (edges not used exactly twice) and whether that share is small enough to be watertight."""
    e = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("c") != 2).alias("n_boundary")).withColumn("watertight", F.col("n_boundary") <= most_open * F.col("n_edges"))


def consecutive_faces(rows: DataFrame, edge: list[str], face: list[str]) -> DataFrame:
    """Edge, f0, f1: each two faces that stand next to each other in an edge's list."""
    w = Window.partitionBy(*edge).orderBy(*face)
    nxt = F.lead(F.struct(*face)).over(w)
    return rows.select(*edge, F.struct(*face).alias("f0"), nxt.alias("f1")).where("f1 is not null")
