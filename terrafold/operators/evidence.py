"""Measures of joins and fragments that rules read: shares, flags, extents, margins, unbounded neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.graph import written
from terrafold.operators.spatial import AXES, ball_join


def nearest_any(left: DataFrame, right: DataFrame, key: str, ident: str, radius: float, most: int = 40) -> DataFrame:
    """key, ident, other, d: for each row of left(key, ident, x, y, z) the nearest row of right with the same key, however far; ties go to the smaller ident.

    Rows look around in grid cells; those that find nothing look again twice as
    far, so most are done in the first rounds. Rows whose key right lacks have
    no row.
    """
    has = right.select(key).distinct()
    left = written(left.select(key, ident, *AXES).join(has, key, "left_semi"))
    right = right.select(key, ident, *AXES)
    found = None
    for _ in range(most):
        near = ball_join(left, right, radius, key)
        best = near.groupBy(F.col(f"l.{key}").alias(key), F.col(f"l.{ident}").alias(ident)).agg(F.min(F.struct("d", F.col(f"r.{ident}").alias("other"))).alias("m"))
        new = written(best.select(key, ident, "m.other", "m.d"))
        found = new if found is None else found.unionByName(new)
        left = written(left.join(new.select(key, ident), [key, ident], "left_anti"))
        if not left.limit(1).count():
            break
        radius *= 2
    return found


def shell_margin(intact: DataFrame, frags: DataFrame, low: float = 0.12, high: float = 1.5) -> DataFrame:
    """intact(frag, vid, d) whose distance to the fracture is strictly between ``low`` and ``high`` walls (frags has t)."""
    j = intact.join(frags.select("frag", "t"), "frag")
    return j.where((F.col("d") > low * F.col("t")) & (F.col("d") < high * F.col("t"))).select("frag", "vid", "d")


def two_sided(rows: DataFrame, keys: list[str], side: Column, inside: Column) -> DataFrame:
    """keys, share, tight, gap, depth: of the two sides of a pair, the larger share of rows ``inside``, the smaller tight, the larger gap and depth (pen)."""
    g = rows.groupBy(*keys, side.alias("side")).agg(F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("share"), F.avg("tight").alias("tight"), F.avg("gap").alias("gap"), F.max(F.when(inside, F.col("pen"))).alias("depth"))
    return g.groupBy(*keys).agg(F.max("share").alias("share"), F.min("tight").alias("tight"), F.max("gap").alias("gap"), F.max("depth").alias("depth"))


def thickness_flags(frags: DataFrame, most: float = 0.4) -> DataFrame:
    """frag, t, outlier: whether the wall differs from the collection's median by more than ``most`` of it."""
    m = frags.agg(F.median("t").alias("med"))  # one row
    return frags.crossJoin(F.broadcast(m)).select("frag", "t", (F.abs(F.col("t") / F.col("med") - 1) > most).alias("outlier"))


def extents(pts: DataFrame, key: str) -> DataFrame:
    """key, n, the box's corners lo_x.. and hi_x.., and its diagonal."""
    g = pts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in AXES])
    return g.withColumn("diagonal", F.sqrt(sum(((F.col(f"hi_{c}") - F.col(f"lo_{c}")) ** 2 for c in AXES), F.lit(0.0))))


def recentred(pts: DataFrame, group: str, every: int = 10) -> DataFrame:
    """pts moved so that the mean of every ``every``-th point (by vid) of its group lies at the origin; a group without such points stays."""
    c = pts.where(F.col("vid") % every == 0).groupBy(group).agg(*[F.avg(x).alias(f"_{x}") for x in AXES])
    j = pts.join(c, group, "left")
    return j.select(*[(F.col(x) - F.coalesce(f"_{x}", F.lit(0.0))).alias(x) if x in AXES else F.col(x) for x in pts.columns])


def fracture_samples(area: Column, t: Column, per_t2: float = 150.0, least: int = 5_000, most: int = 12_000) -> Column:
    """How many samples a fracture surface gets."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(per_t2 * area / (t * t)))).cast("long")


def split_half_even(n: Column, share: float) -> Column:
    """A share of n, rounded half to even."""
    return F.bround(n * share).cast("long")


def rejection_margins(rows: DataFrame, limits: dict[str, tuple[float, int]]) -> DataFrame:
    """rows with margin and by: the largest relative distance by which a test throws the row out, and that test.

    limits has (limit, 1 for at least or -1 for at most) for each test. A value
    that is null throws out by infinity; a row that no test throws out has 0 and null.
    """
    parts = []
    for k, (limit, sign) in limits.items():
        short = (limit - F.col(k)) * sign / (abs(limit) or 1.0)
        parts.append(F.struct(F.when(F.col(k).isNull(), float("inf")).otherwise(short).alias("margin"), F.lit(k).alias("by")))
    thrown = F.filter(F.array(*parts), lambda x: x["margin"] > 0)
    best = F.array_max(thrown)
    return rows.withColumn("margin", F.coalesce(best["margin"], F.lit(0.0))).withColumn("by", best["by"])


def boundary_distances(rows: DataFrame, limits: dict[str, tuple[float, int]]) -> DataFrame:
    """test, nearest: how far the nearest row that a test throws out is from its limit (null where it throws out none)."""
    gap = lambda k: (limits[k][0] - F.col(k)) * limits[k][1]
    one = rows.agg(*[F.min(F.when((gap(k) > 0) & ~F.isnan(k), gap(k))).alias(k) for k in limits])
    return one.unpivot([], list(limits), "test", "nearest")


def missed_pairs(cand: DataFrame, truth: DataFrame, used: DataFrame) -> DataFrame:
    """The best candidate of each pair of truth(a, b) that used(a, b) has not."""
    t = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    c = cand.join(t, ["a", "b"], "left_semi").join(used.select("a", "b").distinct(), ["a", "b"], "left_anti")
    fields = cand.schema["ord"].dataType.names
    return c.groupBy("a", "b").agg(F.max_by(F.struct("score", "accepted"), F.struct("score", *[(-F.col(f"ord.{f}")).alias(f) for f in fields])).alias("m")).select("a", "b", "m.score", "m.accepted")


def object_rollup(verdicts: DataFrame, objects: DataFrame, truth: DataFrame) -> DataFrame:
    """object, fragments, correct_fragments, gt_pairs, correct_joins: fragments in a correct join, and true pairs found, by object (of a pair's first fragment)."""
    t = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = objects.select(F.col("node").alias("a"), "object")
    ok = verdicts.where("verdict = 'correct'").select("a", "b").distinct()
    placed = ok.select(F.col("a").alias("node")).union(ok.select("b")).distinct().withColumn("ok", F.lit(1))
    f = objects.join(placed, "node", "left").groupBy("object").agg(F.count(F.lit(1)).alias("fragments"), F.count("ok").alias("correct_fragments"))
    pairs = t.join(of, "a").groupBy("object").agg(F.count(F.lit(1)).alias("gt_pairs"))
    joins = ok.join(of, "a").groupBy("object").agg(F.count(F.lit(1)).alias("correct_joins"))
    j = f.join(pairs, "object", "left").join(joins, "object", "left")
    return j.select("object", "fragments", "correct_fragments", F.coalesce("gt_pairs", F.lit(0)).alias("gt_pairs"), F.coalesce("correct_joins", F.lit(0)).alias("correct_joins"))


def feature_set(names: Column, known: list[str]) -> Column:
    """A set of features as a bit for each of ``known``."""
    return sum((F.when(F.array_contains(names, k), 1 << i).otherwise(0) for i, k in enumerate(known)), F.lit(0)).cast("int")


def features_of(bits: Column, known: list[str]) -> Column:
    """The names in a feature set, in the order of ``known``."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, k) for i, k in enumerate(known)]), lambda x: x.isNotNull())
