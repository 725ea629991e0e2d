"""Breaklines: the edges between shell and fracture, their frames, and the curves that they form.

Lengths are counted in walls, so one radius serves all fragments (see
``segment.scaled``). Fragments with labels of one kind only have no breakline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.columns import cross, dot, norm
from terrafold.operators.chains import ranked_chains
from terrafold.operators.graph import written
from terrafold.operators.mesh import edges
from terrafold.operators.spatial import AXES, ball_join, voxel_representatives

#: Radii of the annulus whose faces give a point its two normals, the cell of the subset, and the least length of a direction; fixed values.
INNER, OUTER, CELL, LEAST = 0.15, 0.60, 0.5, 0.5


def breakline_points(vertices: DataFrame, faces: DataFrame, labels: DataFrame) -> DataFrame:
    """frag, vid, a, b, x, y, z: the middle of each edge (a, b) that two neighbouring faces with different labels share.

    labels has frag, vid (the face) and is_fracture; faces without one are in no
    neighbourhood. vid numbers the points in order of frag, a, b and face. An edge of
    more than two faces gives a point for each change along its list of faces.
    """
    own = Window.partitionBy("frag", "a", "b").orderBy("slot", "fid")
    e = edges(faces).join(labels.select("frag", F.col("vid").alias("fid"), "is_fracture"), ["frag", "fid"])
    e = e.withColumn("next", F.lead("is_fracture").over(own)).where("next != is_fracture").select("frag", "a", "b", "fid")
    order = ["frag", "a", "b", "fid"]
    e = written(e.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("vid", F.monotonically_increasing_id()))
    for k in ("a", "b"):
        e = e.join(vertices.select("frag", F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in AXES]), ["frag", k])
    return e.select("frag", "vid", "a", "b", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in AXES])


def mean_normals(at: DataFrame, pts: DataFrame, radius: float) -> DataFrame:
    """frag, vid, nx..: for rows of at(frag, vid, x..) with any of pts(frag, x.., nx.., area) nearer than radius, their area-weighted mean normal, of length 1; 0 where they cancel out."""
    j = ball_join(at.select("frag", "vid", *AXES), pts.select("frag", *AXES, *[f"n{c}" for c in AXES], "area"), radius, "frag")
    w = F.greatest(F.sum("r.area"), F.lit(1e-12))
    g = j.groupBy(F.col("l.frag").alias("frag"), F.col("l.vid").alias("vid")).agg(*[(F.sum(F.col("r.area") * F.col(f"r.n{c}")) / w).alias(f"m{c}") for c in AXES])
    length = F.greatest(norm([f"m{c}" for c in AXES]), F.lit(1e-12))
    return g.select("frag", "vid", *[(F.col(f"m{c}") / length).alias(f"n{c}") for c in AXES])


def macro_normals(at: DataFrame, pts: DataFrame, inner: float = INNER, outer: float = OUTER) -> DataFrame:
    """frag, vid, sx.. and fx..: the shell's and the fracture's mean normal around each row of at(frag, vid, x..).

    pts has frag, vid, x.., nx.., area, is_fracture. A label's points count between
    the radii: those nearer than inner to any row of ``at`` are left out, as the
    break rounds them. Rows that find none take the whole ball, and those that
    still find none get zeros.
    """
    close = ball_join(pts.select("frag", "vid", *AXES), at.select("frag", "vid", *AXES), inner, "frag").select("l.frag", "l.vid").distinct()
    far = written(pts.join(close, ["frag", "vid"], "left_anti"))
    out = at.select("frag", "vid")
    for name, label in (("s", ~F.col("is_fracture")), ("f", F.col("is_fracture"))):
        first = written(mean_normals(at, far.where(label), outer))
        good = first.where(norm([f"n{c}" for c in AXES]) >= LEAST)
        rest = at.join(good, ["frag", "vid"], "left_anti")
        found = good.unionByName(mean_normals(rest, pts.where(label), outer))
        out = out.join(found.select("frag", "vid", *[F.col(f"n{c}").alias(f"{name}{c}") for c in AXES]), ["frag", "vid"], "left")
    return out.select("frag", "vid", *[F.coalesce(f"{n}{c}", F.lit(0.0)).alias(f"{n}{c}") for n in "sf" for c in AXES])


def frames(normals: DataFrame) -> DataFrame:
    """normals(sx.., fx..) with gx.. (the fracture's normal made square to the shell's, of length 1), tx.. (the tangent, s x g), dihedral (degrees) and valid."""
    s, f = [f"s{c}" for c in AXES], [f"f{c}" for c in AXES]
    d = dot(f, s)
    flat = [F.col(a) - d * F.col(b) for a, b in zip(f, s)]
    length = F.greatest(norm(flat), F.lit(1e-9))
    out = normals.select("*", *[(x / length).alias(f"g{c}") for x, c in zip(flat, AXES)], F.degrees(F.acos(F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)))).alias("dihedral"))
    out = out.select("*", *[x.alias(f"t{c}") for x, c in zip(cross(s, [f"g{c}" for c in AXES]), AXES)])
    return out.withColumn("valid", (norm(s) > LEAST) & (norm(f) > LEAST) & (norm([f"t{c}" for c in AXES]) > LEAST))


def hypothesis_points(framed: DataFrame, cell: float = CELL) -> DataFrame:
    """frag, vid: of the points framed(frag, vid, x.., valid), the lowest of each cell, if its frame is valid."""
    return voxel_representatives(framed.select("frag", "vid", *AXES), cell).join(framed.where("valid").select("frag", "vid"), ["frag", "vid"], "left_semi")


def breaklines(vertices: DataFrame, faces: DataFrame, pts: DataFrame) -> DataFrame:
    """The breakline points of labelled meshes with their frames: frag, vid, a, b, x.., sx.., fx.., gx.., tx.., dihedral, valid, sub.

    pts has the faces' centres: frag, vid, x.., nx.., area, is_fracture.
    """
    at = written(breakline_points(vertices, faces, pts))
    framed = written(at.join(frames(macro_normals(at, pts)), ["frag", "vid"]))
    return framed.join(hypothesis_points(framed).withColumn("sub", F.lit(True)), ["frag", "vid"], "left").withColumn("sub", F.coalesce("sub", F.lit(False)))


def traced_chains(e: DataFrame) -> DataFrame:
    """frag, vid, chain, pos, closed for edges e(frag, vid, a, b) with vid unique over all: the curves that they form.

    Edges follow each other at a vertex of exactly two ends; where three or more
    meet, and where one ends, curves end. Each edge is followed both ways, and of
    the two ways along a curve the one whose first half-edge is smaller counts, so
    a curve begins at its end with the smaller edge, a ring at its smallest edge.
    """
    half = lambda way, p, q: e.select("frag", (2 * F.col("vid") + way).alias("item"), F.col(p).alias("from"), F.col(q).alias("to"))
    ways = written(half(0, "a", "b").unionByName(half(1, "b", "a")))
    two = ways.groupBy("frag", F.col("to").alias("from")).agg(F.count(F.lit(1)).alias("ends"), F.min("item").alias("i"), F.max("item").alias("j")).where("ends = 2")
    # of the two half-edges that arrive where one begins, its own other way is no predecessor
    own = F.col("item").bitwiseXOR(F.lit(1))
    met = ways.join(two, ["frag", "from"], "left")
    links = met.select("item", F.when(F.col("i") == own, F.col("j")).when(F.col("j") == own, F.col("i")).alias("prev"))
    ranked = written(ranked_chains(links).withColumn("vid", F.shiftright("item", 1)))
    chosen = ranked.groupBy("vid").agg(F.min("head").alias("head"))
    return e.select("frag", "vid").join(ranked.join(chosen, ["vid", "head"]).select("vid", F.col("head").alias("chain"), "pos", "closed"), "vid").select("frag", "vid", "chain", "pos", "closed")
