"""Shell and fracture of a fragment's faces: votes of inward rays, majority, islands, growth of the shell.

Lengths are counted in walls: each fragment is scaled by its own thickness, so
one radius serves all fragments.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions.columns import cross, dot, unit
from terrafold.functions.poses import cone_rays
from terrafold.operators.graph import connected_components, written
from terrafold.operators.mesh import face_adjacency, face_geometry, topology
from terrafold.operators.spatial import AXES, ball_join, majority_labels, smoothed_normals
from terrafold.operators.surface import first_hits, triangles

NORMAL = [f"n{c}" for c in AXES]


def scaled(vertices: DataFrame, walls: DataFrame) -> DataFrame:
    """vertices in walls(frag, t); fragments without a wall over 0 go."""
    return vertices.join(walls.where("t > 0"), "frag").select("frag", "vid", *[(F.col(c) / F.col("t")).alias(c) for c in AXES])


def face_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """frag, vid (the face), x.. (its centre), nx.. and area."""
    return face_geometry(vertices, faces).select("frag", F.col("fid").alias("vid"), *[F.col(f"c{c}").alias(c) for c in AXES], *NORMAL, "area")


def wall_votes(pts: DataFrame, tri: DataFrame, radius: float = 1 / 3, window: tuple[float, float] = (0.5, 1.8), back: float = 0.7) -> DataFrame:
    """frag, vid, votes: how many of seven rays around the smoothed inward normal reach, within the window, a face that looks back.

    The normal is the mean in a ball around each face itself.
    """
    n = smoothed_normals(pts, radius)
    n = n.select("frag", "vid", *[x.alias(f"d{c}") for x, c in zip(unit([-F.col(c) for c in NORMAL]), AXES)])
    d = [F.col(f"d{c}") for c in AXES]
    along = F.abs(d[0]) < 0.9
    across = unit(cross(d, [F.when(along, 1.0).otherwise(0.0), F.when(along, 0.0).otherwise(1.0), F.lit(0.0)]))
    n = n.select("*", *[x.alias(f"u{c}") for x, c in zip(across, AXES)])
    rays = n.select("frag", "vid", F.posexplode(cone_rays([f"d{c}" for c in AXES], [f"u{c}" for c in AXES])).alias("k", "way")).join(pts.select("frag", "vid", *AXES), ["frag", "vid"])
    rays = written(rays.select("frag", F.struct("vid", "k").alias("rid"), F.col("vid").alias("own"), *AXES, *[F.col("way")[i].alias(f"d{c}") for i, c in enumerate(AXES)]))
    hits = first_hits(rays, tri, F.lit(window[1])).where(F.col("t") > window[0])
    hits = hits.join(rays.select("frag", "rid", *[f"d{c}" for c in AXES]), ["frag", "rid"]).join(pts.select("frag", F.col("vid").alias("fid"), *NORMAL), ["frag", "fid"])
    good = hits.where(dot(NORMAL, [f"d{c}" for c in AXES]) > back).groupBy("frag", F.col("rid.vid").alias("vid")).agg(F.count(F.lit(1)).alias("votes"))
    return pts.select("frag", "vid").join(good, ["frag", "vid"], "left").select("frag", "vid", F.coalesce("votes", F.lit(0)).alias("votes"))


def without_islands(labels: DataFrame, adjacency: DataFrame, value: bool, least: float) -> DataFrame:
    """labels(frag, vid, area, is_fracture) in which connected faces labelled ``value`` that have less than ``least`` area together get the other label."""
    ids = written(labels.withColumn("node", F.monotonically_increasing_id()))
    mine = ids.where(F.col("is_fracture") == value)
    end = lambda v, n: mine.select("frag", F.col("vid").alias(v), F.col("node").alias(n))
    edges = adjacency.join(end("f0", "a"), ["frag", "f0"]).join(end("f1", "b"), ["frag", "f1"]).select("a", "b")
    part = mine.join(connected_components(edges), "node", "left").withColumn("part", F.coalesce("component", "node"))
    small = part.groupBy("part").agg(F.sum("area").alias("all_")).where(F.col("all_") < least)
    gone = part.join(small, "part").select("node", F.lit(True).alias("gone"))
    return written(ids.join(gone, "node", "left").select("frag", "vid", "area", F.when(F.col("gone"), not value).otherwise(F.col("is_fracture")).alias("is_fracture")))


def grown_shell(labels: DataFrame, pts: DataFrame, adjacency: DataFrame, radius: float = 0.5, most_deg: float = 25.0, passes: int = 60) -> DataFrame:
    """labels after the shell has grown, face by face, over fracture whose normal is within ``most_deg`` of the shell's.

    The shell's normal is the mean over the shell before any growth in a ball around the face; without any there, the face stays.
    """
    shell = pts.join(labels.where("not is_fracture").select("frag", "vid"), ["frag", "vid"], "left_semi")
    broken = pts.join(labels.where("is_fracture").select("frag", "vid"), ["frag", "vid"], "left_semi")
    near = ball_join(broken, shell, radius, "frag")
    ref = near.groupBy(F.col("l.frag").alias("frag"), F.col("l.vid").alias("vid")).agg(*[F.sum(F.col("r.area") * F.col(f"r.{c}")).alias(f"r{c}") for c in NORMAL])
    u = unit([f"r{c}" for c in NORMAL])
    may = written(broken.join(ref, ["frag", "vid"]).where(dot(NORMAL, u) > math.cos(math.radians(most_deg))).select("frag", "vid"))
    beside = written(adjacency.select("frag", "f0", "f1").union(adjacency.select("frag", "f1", "f0")).distinct())
    front, grown = labels.where("not is_fracture").select("frag", "vid"), may.limit(0)
    for _ in range(passes):
        new = beside.join(front.withColumnRenamed("vid", "f0"), ["frag", "f0"]).select("frag", F.col("f1").alias("vid")).distinct()
        front = written(may.join(new, ["frag", "vid"], "left_semi").join(grown, ["frag", "vid"], "left_anti"))
        if not front.limit(1).count():
            break
        grown = grown.unionByName(front)
    flipped = grown.withColumn("flipped", F.lit(True))
    return written(labels.join(flipped, ["frag", "vid"], "left").select("frag", "vid", "area", (F.col("is_fracture") & F.col("flipped").isNull()).alias("is_fracture")))


def segment(vertices: DataFrame, faces: DataFrame, walls: DataFrame) -> DataFrame:
    """frag, fid, is_fracture for the faces of fragments with walls(frag, t).

    Shell are the faces with five votes of seven, or four where the mesh is
    coarser than a tenth of the wall. A majority in a quarter wall smooths it,
    fracture under half a squared wall and shell under two go, the shell grows,
    and fracture islands go again.
    """
    v = written(scaled(vertices, walls))
    f = written(faces.join(walls.where("t > 0").select("frag"), "frag", "left_semi"))
    pts = written(face_points(v, f))
    adjacency = written(face_adjacency(f))
    need = topology(v, f).select("frag", F.when(F.col("res") > 0.1, 4).otherwise(5).alias("need"))
    votes = wall_votes(pts, triangles(v, f)).join(need, "frag")
    first = written(pts.join(votes.select("frag", "vid", (F.col("votes") < F.col("need")).alias("is_fracture")), ["frag", "vid"]))
    labels = pts.select("frag", "vid", "area").join(majority_labels(first, 0.25), ["frag", "vid"]).withColumnRenamed("majority", "is_fracture")
    labels = without_islands(labels, adjacency, True, 0.5)
    labels = without_islands(labels, adjacency, False, 2.0)
    labels = without_islands(grown_shell(labels, pts, adjacency), adjacency, True, 0.5)
    return labels.select("frag", F.col("vid").alias("fid"), "is_fracture")
