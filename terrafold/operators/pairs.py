"""Pairs of fragments: enumeration, pruning, scales and hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import angle_deg, dot, pair_scales


def wall_ratio_pairs(frags: DataFrame, ratio: float, parts: int = 16) -> DataFrame:
    """a, b, ta, tb, ratio: pairs a < b whose wall thicknesses differ by ``ratio`` at most.

    Thickness is cut into bands of the ratio, so a pair is in the same band or
    the next one: an equi-join finds all of them without comparing all pairs. One
    band may hold nearly all fragments, so each is dealt to ``parts`` tasks on one side.
    """
    f = frags.where("t > 0").withColumn("band", F.floor(F.log("t") / F.log(F.lit(ratio))))
    a = f.select(F.col("frag").alias("a"), F.col("t").alias("ta"), F.pmod(F.xxhash64("frag"), F.lit(parts)).cast("int").alias("part"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    b = f.select(F.col("frag").alias("b"), F.col("t").alias("tb"), "band", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    j = a.join(b, ["band", "part"]).where(F.col("a") < F.col("b"))
    r = F.col("ta") / F.col("tb")
    return j.where((r >= 1 / ratio) & (r <= ratio)).select("a", "b", "ta", "tb", r.alias("ratio"))


def scales_of_pairs(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """a, b and the length scales from the thinner wall and the coarser mesh."""
    fa = frags.select(F.col("frag").alias("a"), F.col("t").alias("t1"), F.col("res").alias("r1"))
    fb = frags.select(F.col("frag").alias("b"), F.col("t").alias("t2"), F.col("res").alias("r2"))
    j = pairs.select("a", "b").join(fa, "a").join(fb, "b")
    return j.select("a", "b", *[c.alias(k) for k, c in pair_scales(F.least("t1", "t2"), F.greatest("r1", "r2")).items()])


def with_dihedral(pts: DataFrame) -> DataFrame:
    return pts.withColumn("dih", angle_deg(dot(["nx", "ny", "nz"], ["fx", "fy", "fz"])))


def dihedral_hypotheses(pts: DataFrame, pairs: DataFrame, tol: float) -> DataFrame:
    """a, b, ia, ib, off: point pairs of the fragments of pairs(a, b) whose dihedral angles complement each other to 180 within tol.

    The theta join is an equi-join on the pair and a band of the angle, each row
    visiting three, so only points of pairs that are left meet.
    """
    d = with_dihedral(pts)
    left = d.select(F.col("frag").alias("a"), F.col("vid").alias("ia"), F.col("dih").alias("da")).join(pairs.select("a", "b"), "a")
    left = left.withColumn("band", F.explode(F.array(*[F.floor(F.col("da") / tol) + k for k in (-1, 0, 1)])))
    right = d.select(F.col("frag").alias("b"), F.col("vid").alias("ib"), F.col("dih").alias("db"), F.floor((180 - F.col("dih")) / tol).alias("band"))
    off = F.col("da") + F.col("db") - 180
    return left.join(right, ["b", "band"]).where(F.abs(off) < tol).select("a", "b", "ia", "ib", off.alias("off"))
