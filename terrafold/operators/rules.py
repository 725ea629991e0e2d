"""Acceptance, refusal reasons, tiers and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.columns import fixed, pair_key
from terrafold.operators.graph import written
from terrafold.params import Acceptance, TierRule

INF = float("inf")


def _at_least(c: str, low: float) -> Column:
    return F.coalesce(~F.isnan(c) & (F.col(c) >= low), F.lit(False))


def _at_most(c: str, high: float) -> Column:
    return F.coalesce(~F.isnan(c) & (F.col(c) <= high), F.lit(False))


def acceptance_tests(rule: Acceptance) -> dict[str, Column]:
    return {"tight": _at_least("tight", rule.min_tight), "gap": _at_most("gap", rule.max_gap), "pen": _at_most("pen", rule.max_pen), "seam": _at_least("seam", rule.min_seam), "cont": _at_least("cont", rule.min_cont)}


def refusal_reasons(cand: DataFrame, rule: Acceptance) -> DataFrame:
    """cand with ``reasons``, an array with a sentence for each test that fails (a value that can't be measured fails)."""
    said = {"tight": f"below {rule.min_tight}", "gap": f"above {rule.max_gap}", "pen": f"above {rule.max_pen}", "seam": f"below {rule.min_seam}", "cont": f"below {rule.min_cont}"}
    reasons = F.array(*[F.when(~ok, F.concat(F.lit(f"{k} "), F.when(F.col(k).isNull(), "unknown").otherwise(fixed(k, 3)), F.lit(f" {said[k]}"))) for k, ok in acceptance_tests(rule).items()])
    return cand.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))


def reason_parts(refused: DataFrame) -> DataFrame:
    """refused (with ``reasons``) as a row for each sentence: test, value (null if unknown, NaN if it was that), side (below or above) and limit."""
    r = refused.withColumn("reason", F.explode("reasons"))
    part = lambda i: F.regexp_extract("reason", r"^(\w+) (\S+) (below|above) (\S+)$", i)
    return r.select(*[c for c in refused.columns if c != "reasons"], part(1).alias("test"), part(2).try_cast("double").alias("value"), part(3).alias("side"), part(4).cast("double").alias("bound"))


def _row_tests(rule: TierRule) -> dict[str, Column]:
    return {
        "tight": _at_least("tight", rule.min_tight), "gap": _at_most("gap", rule.max_gap), "seam": _at_least("seam", rule.min_seam), "cont": _at_least("cont", rule.min_cont),
        "pen": _at_most("pen", rule.max_pen), "slide": _at_most("slide", rule.max_slide),
    }


def tested(cand: DataFrame, rule: TierRule) -> DataFrame:
    """cand with _off, a bit for each test of its own values that it fails: one number to shuffle instead of six."""
    off = sum((F.when(ok, 0).otherwise(1 << i) for i, ok in enumerate(_row_tests(rule).values())), F.lit(0))
    return cand.withColumn("_off", off)


def classify(cand: DataFrame, rule: TierRule) -> DataFrame:
    """cand (with support and margin) with failed (tests that a confirmed join has to pass) and tier.

    A join is independent by support, or by its margin over a second placement
    that lies far enough away (moved) and, if the rule asks for it, is one that
    was refused (rival_accepted). Where cand comes from tested(), its tests are read.
    """
    by_margin = F.coalesce(F.col("margin") >= rule.min_margin, F.lit(False))
    if rule.min_moved:
        by_margin = by_margin & F.coalesce(F.col("moved") >= rule.min_moved, F.lit(False))
    if rule.rival_refused:
        by_margin = by_margin & F.coalesce(~F.col("rival_accepted"), F.lit(False))
    strong = (F.coalesce(F.col("support"), F.lit(0)) >= rule.min_support) | by_margin
    cand = cand if "_off" in cand.columns else tested(cand, rule)
    tests = {k: F.col("_off").bitwiseAND(1 << i) == 0 for i, k in enumerate(_row_tests(rule))} | {"independent": strong}
    failed = F.filter(F.array(*[F.when(~ok, F.lit(k)) for k, ok in tests.items()]), lambda x: x.isNotNull())
    confirmed = (F.col("_off") == 0) & strong
    out = cand.withColumn("failed", failed)
    return out.withColumn("tier", F.when(F.col("accepted") & confirmed, "confirmed").when(F.col("accepted"), "probable").otherwise("rejected")).drop("_off")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "confirmed", 0).when(tier == "probable", 1).otherwise(2)


def without_vetoed(cand: DataFrame, vetoes: DataFrame) -> DataFrame:
    """cand without pairs that are in vetoes(a, b), in either order."""
    a, b = pair_key("a", "b")
    return cand.join(vetoes.select(a.alias("a"), b.alias("b")).distinct(), ["a", "b"], "left_anti")


def contradictions(constraints: DataFrame) -> DataFrame:
    """a, b, lists: pairs that constraints(list, a, b) puts into more than one list."""
    a, b = pair_key("a", "b")
    g = constraints.groupBy(a.alias("a"), b.alias("b")).agg(F.array_sort(F.collect_set("list")).alias("lists"))
    return g.where(F.size("lists") > 1)


def walk_order(best: DataFrame, forced: DataFrame) -> DataFrame:
    """best with forced and place: pairs that have to join first, then by score, then in order.

    Rows are dealt to ranges of that order; a place is the rows of the ranges
    before and the place inside the own one.
    """
    f = forced.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("forced", F.lit(True))
    j = best.join(f, ["a", "b"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    order = [F.desc("forced"), F.desc("score"), F.asc("ord")]
    r = written(j.repartitionByRange(j.sparkSession.sparkContext.defaultParallelism, *order).withColumn("_part", F.spark_partition_id()))
    n = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    n = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return r.join(n, "_part").withColumn("place", F.col("_before") + inside).drop("_part", "_before")


def promoted(best: DataFrame, forced: DataFrame) -> DataFrame:
    """a, b, satisfied, tier, said: what becomes of each pair that has to join, given each pair's best accepted candidate with its tier."""
    a, b = pair_key("a", "b")
    f = forced.select(a.alias("a"), b.alias("b")).distinct()
    j = f.join(best.select("a", "b", "score", F.col("tier").alias("was")), ["a", "b"], "left")
    said = F.when(F.col("was").isNull(), "unsatisfiable: no candidate is accepted").when(F.col("was") == "confirmed", F.concat(F.lit("already confirmed at score "), fixed("score", 2))).otherwise(F.concat(F.lit("promoted from "), F.col("was"), F.lit(" to confirmed at score "), fixed("score", 2)))
    return j.select("a", "b", F.col("was").isNotNull().alias("satisfied"), F.when(F.col("was").isNotNull(), "confirmed").alias("tier"), said.alias("said"))


def resolved(named: DataFrame, names: DataFrame) -> DataFrame:
    """named(list, name_a, name_b) with ids a, b from names(name, id) and, where they can't stand, an error: a name that is unknown, or one fragment twice."""
    of = lambda s: names.select(F.col("name").alias(f"name_{s}"), F.col("id").alias(s))
    j = named.join(of("a"), "name_a", "left").join(of("b"), "name_b", "left")
    unknown = lambda s: F.when(F.col(s).isNull(), F.concat(F.lit("no fragment named "), F.coalesce(f"name_{s}", F.lit("null"))))
    return j.withColumn("error", F.coalesce(unknown("a"), unknown("b"), F.when(F.col("a") == F.col("b"), "one fragment twice")))
