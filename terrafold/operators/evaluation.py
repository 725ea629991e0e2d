"""Evaluation against ground truth, and rule search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import poses


def join_verdicts(joins: DataFrame, objects: DataFrame, adjacent: DataFrame) -> DataFrame:
    """joins(a, b, ...) with a verdict: unscorable (an end has no object), cross_object, non_adjacent or correct."""
    oa, ob = objects.select(F.col("node").alias("a"), F.col("object").alias("object_a")), objects.select(F.col("node").alias("b"), F.col("object").alias("object_b"))
    adj = adjacent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("adj", F.lit(True))
    j = joins.join(oa, "a", "left").join(ob, "b", "left").join(adj, ["a", "b"], "left")
    verdict = (
        F.when(F.col("object_a").isNull() | F.col("object_b").isNull(), "unscorable").when(F.col("object_a") != F.col("object_b"), "cross_object").when(F.col("adj").isNull(), "non_adjacent").otherwise("correct")
    )
    return j.withColumn("verdict", verdict).drop("adj")


def precision_recall(verdicts: DataFrame, adjacent: DataFrame) -> DataFrame:
    """One row: n_joins, n_correct, n_truth, precision and recall (null where nothing can be scored)."""
    n = verdicts.where("verdict != 'unscorable'").agg(F.count(F.lit(1)).alias("n_joins"), F.count_if(F.col("verdict") == "correct").alias("n_correct"))
    t = adjacent.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().agg(F.count(F.lit(1)).alias("n_truth"))
    both = n.crossJoin(F.broadcast(t))  # a row each
    return both.withColumn("precision", F.try_divide("n_correct", "n_joins")).withColumn("recall", F.try_divide("n_correct", "n_truth"))


def group_purity(groups: DataFrame, objects: DataFrame) -> DataFrame:
    """grp, n_members, main_object (most members, then smallest), purity for groups(node, grp)."""
    c = groups.join(objects, "node").groupBy("grp", "object").agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy("grp").agg(F.sum("c").alias("n_members"), F.max("c").alias("most"), F.min_by("object", F.struct(-F.col("c"), F.col("object"))).alias("main_object"))
    return g.select("grp", "n_members", "main_object", (F.col("most") / F.col("n_members")).alias("purity"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: n_pos, n_neg, auc = P(positive above negative) + half of ties.

    Scores are counted by value first; a running sum over the distinct values
    gives the negatives below each, so no two rows are paired. The running sum
    is taken inside ranges of values, with the ranges' totals before it.
    """
    v = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    parts = v.repartitionByRange(v.sparkSession.sparkContext.defaultParallelism, "s").withColumn("part", F.spark_partition_id())
    before = parts.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = before.withColumn("before", F.coalesce(F.sum("part_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    w = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = parts.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, "part")
    won = F.sum(F.col("p") * (F.col("inside") + F.col("before") + F.col("n") / 2))
    r = below.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), won.alias("won"))
    return r.select("n_pos", "n_neg", F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def threshold_search(rows: DataFrame, tests: dict[str, list[float]], positive: Column) -> DataFrame:
    """low1, low2, ok, bad for each pair of thresholds on two columns: rows at least both, by truth.

    Rows are first counted by the highest threshold that they pass in either
    column, so the grid meets a small table and not the rows.
    """
    (c1, g1), (c2, g2) = tests.items()
    level = lambda c, g: sum(((F.col(c) >= x).cast("int") for x in sorted(g)[1:]), (F.col(c) >= sorted(g)[0]).cast("int"))
    small = rows.where(F.col(c1).isNotNull() & F.col(c2).isNotNull()).groupBy(level(c1, g1).alias("l1"), level(c2, g2).alias("l2")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.lit(float(x)).alias("low1"), F.lit(float(y)).alias("low2")) for i, x in enumerate(sorted(g1)) for j, y in enumerate(sorted(g2))])
    e = small.withColumn("g", F.explode(grid))
    hit = (F.col("l1") >= F.col("g.i")) & (F.col("l2") >= F.col("g.j"))
    return e.groupBy(F.col("g.low1").alias("low1"), F.col("g.low2").alias("low2")).agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("ok"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("bad"))


def best_thresholds(rows: DataFrame, tests: dict[str, tuple[int, list[float | None]]], positive: Column, negative: Column) -> DataFrame:
    """One row: a threshold for each test (null: the test is off), ok and bad, of the combination that passes most positive rows and no negative one; no row where none does.

    tests are name: (1 for at least or -1 for at most, values). A null or NaN passes
    only a test that is off. Of equal combinations the first in the order of the
    tests and their values is taken. Rows are counted by how strict a value they
    pass in each test; these counts are then summed along one test after the
    other, so no combination ever meets a row.
    """
    r, order, names = rows, {}, list(tests)
    for c, (sign, values) in tests.items():
        # from the laxest on
        order[c] = sorted(range(len(values)), key=lambda i: (values[i] is not None, sign * (values[i] or 0.0)))  # noqa: B023
        holds = [F.lit(1) if values[i] is None else F.coalesce(~F.isnan(F.col(c).cast("double")) & (F.col(c) >= values[i] if sign > 0 else F.col(c) <= values[i]), F.lit(False)).cast("int") for i in order[c]]
        r = r.withColumn(f"_{c}", sum(holds[1:], holds[0]))
    g = r.groupBy(*[f"_{c}" for c in names]).agg(F.count_if(positive).alias("ok"), F.count_if(negative).alias("bad"))
    for c in names:
        g = g.where(F.col(f"_{c}") > 0).withColumn(f"_{c}", F.explode(F.sequence(F.lit(1), F.col(f"_{c}")))).groupBy(*[f"_{k}" for k in names]).agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"))
    place = F.struct(*[(-F.element_at(F.array(*map(F.lit, order[c])), F.col(f"_{c}"))).alias(c) for c in names])
    best = g.where("bad = 0").agg(F.max(F.struct("ok", place.alias("place"), "bad")).alias("m")).where("m is not null")
    at = lambda c: F.element_at(F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in tests[c][1]]), (1 - F.col(f"m.place.{c}")).cast("int"))
    return best.select(*[at(c).alias(c) for c in names], "m.ok", "m.bad")


def pose_verdicts(joins: DataFrame, objects: DataFrame, truth: DataFrame, adjacent: DataFrame, centres: DataFrame, t: float, most_deg: float = 5.0, most_t: float = 0.5) -> DataFrame:
    """joins(a, b, pose, ..) with deg, off and a verdict: cross_object, unscorable, non_adjacent, wrong_pose or correct, the first that holds.

    A join between two objects is wrong whatever the poses; fragments of no object
    are of one unknown object. truth(node, pose) says where fragments belong;
    without both the join is unscorable. deg and off are how far the join is from
    what they say, off at the middle centres(node, x, y, z) of the pair's larger
    node, or at the origin. Poses take b to a; limits are most_deg and most_t walls.
    """
    node = lambda df, c, k: df.select(F.col("node").alias(c), F.col(k).alias(f"{k}_{c}"))
    adj = adjacent.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct().withColumn("_adj", F.lit(True))
    j = joins.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b")).withColumn("_pose", F.explode(F.array(F.when(F.col("a") > F.col("b"), poses.inverse("pose")).otherwise(F.col("pose")))))
    where = truth.select("node", F.col("pose").alias("at"))
    for c in ("_lo", "_hi"):
        j = j.join(node(objects, c, "object"), c, "left").join(node(where, c, "at"), c, "left")
    j = j.join(centres.select(F.col("node").alias("_hi"), *[F.col(c).alias(f"_{c}") for c in "xyz"]), "_hi", "left").join(adj, ["_lo", "_hi"], "left")
    # each is exploded, not only named, or the long expressions would be written out anew wherever they are used
    once = lambda x: F.explode(F.array(x))
    j = j.withColumn("_back", once(poses.inverse("at__lo"))).withColumn("_said", once(poses.compose("_back", "at__hi")))
    middle = [F.coalesce(f"_{c}", F.lit(0.0)) for c in "xyz"]
    known = F.col("at__lo").isNotNull() & F.col("at__hi").isNotNull() & F.col("object__lo").eqNullSafe(F.col("object__hi"))
    far = F.struct(poses.trace_deg("_pose", "_said").alias("deg"), poses.gap_at("_pose", "_said", middle).alias("off"))
    j = j.withColumn("_far", once(F.when(known, far))).withColumn("deg", F.col("_far.deg")).withColumn("off", F.col("_far.off"))
    right = (F.col("deg") <= most_deg) & (F.col("off") <= most_t * t)
    verdict = F.when(~F.col("object__lo").eqNullSafe(F.col("object__hi")), "cross_object").when(~known, "unscorable").when(F.col("_adj").isNull(), "non_adjacent").when(right, "correct").otherwise("wrong_pose")
    return j.select(*joins.columns, "deg", "off", verdict.alias("verdict"))


def contact_areas(voxels: DataFrame, size: float = 1.0) -> DataFrame:
    """a, b (a < b), area: how much surface two labels of voxels(label, i, j, k) share, six neighbours a voxel; a voxel has one label, null is empty."""
    v = voxels.where("label is not null").select("label", "i", "j", "k")
    step = F.explode(F.array(*[F.struct(*[(F.col(c) + int(c == d)).alias(c) for c in "ijk"]) for d in "ijk"])).alias("s")
    near = v.select(F.col("label").alias("from"), step).select("from", "s.i", "s.j", "s.k").join(v, ["i", "j", "k"]).where("from != label")
    return near.groupBy(F.least("from", "label").alias("a"), F.greatest("from", "label").alias("b")).agg((F.count(F.lit(1)) * size * size).alias("area"))


def veto_cost(rows: DataFrame, value: str, positive: Column, factors: list[float]) -> DataFrame:
    """k, lost, caught: rows farther than k MADs from the median, by truth."""
    r = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), positive.alias("pos"))
    m = r.agg(F.median("v").alias("med"))
    d = r.crossJoin(F.broadcast(m)).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    s = d.agg(F.median("dev").alias("mad"))
    e = d.crossJoin(F.broadcast(s)).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in factors])))
    return e.groupBy("k").agg(F.count_if((F.col("dev") > F.col("k") * F.col("mad")) & F.col("pos")).alias("lost"), F.count_if((F.col("dev") > F.col("k") * F.col("mad")) & ~F.col("pos")).alias("caught"))


def ratio_gate(rows: DataFrame, key: str, value: str, ratios: list[float]) -> DataFrame:
    """ratio, kept, n: values within the ratio of their group's median."""
    m = rows.groupBy(key).agg(F.median(value).alias("med"))
    e = rows.select(key, F.col(value).alias("v")).join(m, key).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    q = F.col("v") / F.col("med")
    return e.groupBy("ratio").agg(F.count_if((q <= F.col("ratio")) & (q >= 1 / F.col("ratio"))).alias("kept"), F.count(F.lit(1)).alias("n"))


def agreeing_pairs(cand: DataFrame, run: Column, runs: int, tol: float) -> DataFrame:
    """a, b: pairs whose best accepted candidates of all runs are in the same place (seam within tol)."""
    g = cand.where("accepted").withColumn("run", run).groupBy("a", "b", "run").agg(F.max_by("seam", F.struct("score", "seam")).alias("seam"))
    p = g.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.max("seam") - F.min("seam")).alias("spread"))
    return p.where((F.col("n") == runs) & (F.col("spread") <= tol)).select("a", "b", "spread")
