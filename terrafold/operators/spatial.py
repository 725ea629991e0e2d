"""Spatial joins on a grid: neighbours in a ball, nearest neighbour in a window, voxels.

A cell's edge is the radius, so a ball lies in the 27 cells around a point: the
join is an equi-join on cells with the distance as residual, not a comparison of
all points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cells(pts: DataFrame, size: float) -> DataFrame:
    return pts.withColumn("cell", F.struct(*[F.floor(F.col(c) / size).alias(f"c{c}") for c in AXES]))


def around(pts: DataFrame, size: float) -> DataFrame:
    """Each row once for each of the 27 cells around its own."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for c, v in zip(AXES, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    p = pts.withColumn("_s", F.explode(steps))
    return p.withColumn("cell", F.struct(*[(F.floor(F.col(c) / size) + F.col(f"_s.d{c}")).alias(f"c{c}") for c in AXES])).drop("_s")


def ball_join(left: DataFrame, right: DataFrame, radius: float, key: str | None = None) -> DataFrame:
    """Rows of left and right (as structs l and r) nearer than radius, with their distance d (strict); with ``key``, only rows that share it meet."""
    own = [F.col(key).alias("_key")] if key else []
    l = around(left, radius).select("cell", *own, F.struct(*left.columns).alias("l"))
    r = cells(right, radius).select("cell", *own, F.struct(*right.columns).alias("r"))
    d2 = sum(((F.col(f"l.{c}") - F.col(f"r.{c}")) ** 2 for c in AXES[1:]), (F.col("l.x") - F.col("r.x")) ** 2)
    return l.join(r, ["cell", "_key"] if key else "cell").where(d2 < radius * radius).select("l", "r", F.sqrt(d2).alias("d"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str], ident: str, key: str | None = None) -> DataFrame:
    """For each left row (by ``keys``) and right fragment, the nearest right row within radius; ties go to the smaller ``ident``. With ``key``, only rows that share it meet."""
    j = ball_join(left, right, radius, key)
    best = F.min_by("r", F.struct("d", F.col(f"r.{ident}"))).alias("r")
    return j.groupBy(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("r.frag").alias("other")).agg(best, F.min("d").alias("d"), F.first("l").alias("l"))


def smoothed_normals(pts: DataFrame, radius: float) -> DataFrame:
    """frag, vid, n_near and the area-weighted mean normal of the fragment's points in the ball (not scaled to 1)."""
    j = ball_join(pts, pts, radius, "frag")
    w = F.sum("r.area")
    return j.groupBy(F.col("l.frag").alias("frag"), F.col("l.vid").alias("vid")).agg(F.count(F.lit(1)).alias("n_near"), *[(F.sum(F.col("r.area") * F.col(f"r.{c}")) / w).alias(c) for c in ("nx", "ny", "nz")])


def majority_labels(pts: DataFrame, radius: float) -> DataFrame:
    """frag, vid, majority: whether more than half of the area in the ball is fracture."""
    j = ball_join(pts, pts, radius, "frag")
    broken = F.sum(F.when(F.col("r.is_fracture"), F.col("r.area")).otherwise(0.0))
    return j.groupBy(F.col("l.frag").alias("frag"), F.col("l.vid").alias("vid")).agg((broken > 0.5 * F.sum("r.area")).alias("majority"))


def voxel_representatives(pts: DataFrame, size: float) -> DataFrame:
    """frag, vid: the lowest vid of each voxel of a fragment, counted from one unit below its smallest corner."""
    low = pts.groupBy("frag").agg(*[(F.min(c) - 1).alias(f"low_{c}") for c in AXES])
    p = pts.join(low, "frag")
    vox = [F.floor((F.col(c) - F.col(f"low_{c}")) / size).alias(f"v{c}") for c in AXES]
    return p.groupBy("frag", *vox).agg(F.min("vid").alias("vid")).select("frag", "vid")


def seam_length(pts: DataFrame, frags: DataFrame) -> DataFrame:
    """frag, seam: distinct voxels of a third of the wall among fracture points, over three."""
    p = pts.where("is_fracture").join(frags.select("frag", "t"), "frag")
    vox = [F.floor(F.col(c) / (F.col("t") / 3)) for c in AXES]
    return p.select("frag", *[v.alias(f"v{c}") for v, c in zip(vox, AXES)]).distinct().groupBy("frag").agg((F.count(F.lit(1)) / 3).alias("seam"))
