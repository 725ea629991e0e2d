"""What a stored match is used for again: poses that the operator pins, and refined poses that a new assembly keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import pair_key
from terrafold.operators.objects import inside_joins


def pinned(cand: DataFrame, forced: DataFrame) -> DataFrame:
    """cand(a, b, pose, accepted, ..) in which the pairs of forced(a, b, pose) have one candidate, accepted, with just that pose, and a column pinned.

    A pair's candidate with the very same pose (each number, of several the one of the
    smallest ord) keeps what it measured; otherwise all columns but these are
    null, to be verified. forced without a pose pins nothing; pairs are taken
    either way round, poses as they are given.
    """
    rest = [c for c in cand.columns if c not in ("a", "b", "pose", "accepted")]
    a, b = pair_key("a", "b")
    pins = forced.where("pose is not null").groupBy(a.alias("_a"), b.alias("_b")).agg(F.min(F.struct("a", "b", "pose")).alias("pin"))
    c = cand.withColumn("_a", a).withColumn("_b", b)
    free = c.join(pins.select("_a", "_b"), ["_a", "_b"], "left_anti").select(*cand.columns, F.lit(False).alias("pinned"))
    same = c.join(pins, ["_a", "_b"]).where("pose = pin.pose and a = pin.a and b = pin.b")
    scored = same.groupBy("_a", "_b").agg(F.min_by(F.struct(*rest), "ord").alias("m"))
    held = pins.join(scored, ["_a", "_b"], "left").select("pin.a", "pin.b", "pin.pose", F.lit(True).alias("accepted"), *[F.col(f"m.{k}").alias(k) for k in rest], F.lit(True).alias("pinned"))
    return free.unionByName(held)


def merge_refined(base: DataFrame, base_joins: DataFrame, fresh: DataFrame, fresh_joins: DataFrame) -> DataFrame:
    """fresh(node, grp, pose) with base's poses where its group is a refined one of base(node, grp, pose, refined), and a column refined.

    Two groups are the same if they have the same members and the same joins among
    them, either way round; a group of one is never refined. Sets are compared by
    the numbers of what they have and what they share.
    """
    size = lambda df, n: df.groupBy("grp").agg(F.count(F.lit(1)).alias(n))
    links = lambda nodes, joins, n: inside_joins(nodes, joins).groupBy("grp").agg(F.count(F.lit(1)).alias(n))
    b = base.where("refined").select("node", F.col("grp").alias("old"), F.col("pose").alias("was"))
    shared = fresh.select("node", "grp").join(b.select("node", "old"), "node").groupBy("grp", "old").agg(F.count(F.lit(1)).alias("common"))
    old = base.where("refined")
    sized = lambda df, joins, s: size(df, f"n_{s}").join(links(df, joins, f"l_{s}"), "grp", "left").na.fill(0, [f"l_{s}"])
    mine, theirs = sized(fresh, fresh_joins, "new"), sized(old, base_joins, "old").withColumnRenamed("grp", "old")
    both = inside_joins(fresh, fresh_joins).join(inside_joins(old, base_joins).withColumnRenamed("grp", "old"), ["a", "b"]).groupBy("grp", "old").agg(F.count(F.lit(1)).alias("l_both"))
    j = shared.join(mine, "grp").join(theirs, "old").join(both, ["grp", "old"], "left").na.fill(0, ["l_both"])
    kept = j.where("common = n_new and common = n_old and common > 1 and l_both = l_new and l_both = l_old").select("grp", "old")
    out = fresh.select("node", "grp", "pose").join(kept, "grp", "left").join(b, ["node", "old"], "left")
    return out.select("node", "grp", F.coalesce("was", "pose").alias("pose"), F.col("old").isNotNull().alias("refined"))
