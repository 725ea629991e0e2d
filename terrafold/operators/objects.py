"""Objects: groups of joined fragments, their members that don't fit, joins that are demoted for it, and what the operator's lists say of the groups.

Groups are nodes(node, grp), used joins are used(a, b). All plans are joins on
nodes and pairs; no group is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import fixed, pair_key
from terrafold.operators.aggregates import leave_one_out_deviation
from terrafold.operators.graph import written


def inside_joins(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """grp, a, b (a < b): the distinct joins whose ends are both in one group."""
    a, b = pair_key("a", "b")
    j = used.where("a != b").select(a.alias("a"), b.alias("b")).distinct()
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("grp").alias(f"g{c}"))
    return j.join(of("a"), "a").join(of("b"), "b").where("ga = gb").select(F.col("ga").alias("grp"), "a", "b")


def objects(nodes: DataFrame, used: DataFrame, features: DataFrame) -> DataFrame:
    """grp, n_members, n_joins, rim_diameter for features(node, rim, rim_diameter): the median diameter, where any member is a rim; nulls and NaN are passed over."""
    d = F.when(~F.isnan("rim_diameter"), F.col("rim_diameter"))
    g = nodes.join(features.select("node", "rim", d.alias("d")), "node", "left").groupBy("grp").agg(F.count(F.lit(1)).alias("n_members"), F.median("d").alias("d"), F.coalesce(F.bool_or("rim"), F.lit(False)).alias("rim"))
    n = inside_joins(nodes, used).groupBy("grp").agg(F.count(F.lit(1)).alias("n_joins"))
    return g.join(n, "grp", "left").select("grp", "n_members", F.coalesce("n_joins", F.lit(0)).alias("n_joins"), F.when(F.col("rim"), F.col("d")).alias("rim_diameter"))


def rejects(nodes: DataFrame, features: DataFrame, names: list[str], k: float = 3.0, min_members: int = 3, floors: dict[str, float] | None = None) -> DataFrame:
    """grp, node, feature, value, med, mads: members over k MADs away from the other members' median of a feature.

    ``floors`` is the least spread of a feature. Groups have to have more members
    than ``min_members`` (2 at least), and that many others with the feature. Others
    without any spread reject nobody.
    """
    least = max(min_members, 2)
    size = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("grp")
    rows = written(nodes.join(size, "grp", "left_semi").join(features.select("node", *[F.col(c).cast("double").alias(c) for c in names]), "node"))
    out = None
    for c in names:
        d = leave_one_out_deviation(rows, "grp", "node", c, k, (floors or {}).get(c, 0.0), least).where("deviates")
        d = d.join(rows.select("node", F.col(c).alias("value")), "node").select("grp", "node", F.lit(c).alias("feature"), "value", "med", F.col("times").alias("mads"))
        out = d if out is None else out.unionByName(d)
    return out


def demotions(confirmed: DataFrame, rejected: DataFrame, same: DataFrame) -> DataFrame:
    """a, b, reason: the pairs of used confirmed(a, b) joins with a rejected end, but for the pairs of same(a, b), which the operator has declared to be one object.

    The reason is the worst deviation of the end; of two rejected ends the smaller one's.
    """
    a, b = pair_key("a", "b")
    keep = same.select(a.alias("a"), b.alias("b")).distinct()
    pairs = confirmed.select(a.alias("a"), b.alias("b")).distinct().join(keep, ["a", "b"], "left_anti")
    worst = rejected.groupBy("grp", "node").agg(F.max_by(F.struct("feature", "value", "med", "mads"), F.struct("mads", "feature")).alias("w"))
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(worst, "node")
    said = F.concat(F.col("node").cast("string"), F.lit(" is "), fixed("w.mads", 1), F.lit(" MAD from object "), F.col("grp").cast("string"), F.lit("'s "), F.col("w.feature"), F.lit(" ("), fixed("w.value", 4), F.lit(" against "), fixed("w.med", 4), F.lit(")"))
    return ends.groupBy("a", "b").agg(F.min_by(said, "node").alias("reason"))


def object_round(joins: DataFrame, build: Callable[[DataFrame], DataFrame], features: DataFrame, names: list[str], same: DataFrame, **rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, demoted, last): an assembly of the joins, what its objects demote, and the assembly without the demoted pairs.

    ``build`` turns joins into rows a, b, status, grp, .. (assembly.assemble or
    assemble_poses). A demotion is said of the pair, so none of its joins takes part
    again. Where nothing is demoted, last is first.
    """
    first = written(build(joins))
    used = written(first.where("status = 'used'").select("a", "b", "grp"))
    nodes = written(used.select(F.explode(F.array("a", "b")).alias("node"), "grp").distinct())
    demoted = written(demotions(used, rejects(nodes, features, names, **rule), same))
    if demoted.isEmpty():
        return first, demoted, first
    a, b = pair_key("a", "b")
    left = joins.withColumn("_a", a).withColumn("_b", b).join(demoted.select(F.col("a").alias("_a"), F.col("b").alias("_b")), ["_a", "_b"], "left_anti").drop("_a", "_b")
    return first, demoted, written(build(left))


def operator_view(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """kind, a, b: pairs of lists(list, a, b) that the groups contradict: split ones of same_object and ones of different_object that are together.

    Fragments without a group are together with nobody, and two of them aren't split.
    """
    a, b = pair_key("a", "b")
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("grp").alias(f"g{c}"))
    j = lists.select("list", a.alias("a"), b.alias("b")).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    split = (F.col("list") == "same_object") & ~F.col("ga").eqNullSafe(F.col("gb"))
    together = (F.col("list") == "different_object") & F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))
    return j.withColumn("kind", F.when(split, "split").when(together, "together")).where("kind is not null").select("kind", "a", "b")
