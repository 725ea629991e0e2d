"""Mesh operators on vertex and face tables: cleaning, geometry, topology, smoothing, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.columns import cross, norm
from terrafold.operators.graph import connected_components, written


def clean(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vertices become the first of them (NaN equals nothing), faces that use one twice go, and so do vertices without a face.

    vid and fid stay as they were.
    """
    plus = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))  # noqa: E731  -0 is 0
    nan = F.isnan("x") | F.isnan("y") | F.isnan("z")
    v = vertices.select("frag", "vid", *[plus(c).alias(c) for c in "xyz"])
    first = v.where(~nan).groupBy("frag", "x", "y", "z").agg(F.min("vid").alias("to"))
    to = v.where(~nan).join(first, ["frag", "x", "y", "z"]).select("frag", "vid", "to").unionByName(v.where(nan).select("frag", "vid", F.col("vid").alias("to")))
    f = faces
    for c in ("v0", "v1", "v2"):
        f = f.join(to.select("frag", F.col("vid").alias(c), F.col("to").alias(f"_{c}")), ["frag", c]).drop(c).withColumnRenamed(f"_{c}", c)
    f = f.where("v0 != v1 and v1 != v2 and v0 != v2").select("frag", "fid", "v0", "v1", "v2")
    used = f.select("frag", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, ["frag", "vid"], "left_semi"), f


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with unit normal nx.., area and centroid cx..; a normal's length under 1e-12 counts as 1e-12."""
    f = faces
    for i in range(3):
        f = f.join(vertices.select("frag", F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), ["frag", f"v{i}"])
    e1, e2 = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in "xyz"] for k in (1, 2))
    n = cross(e1, e2)
    length = norm(n)
    unit = [x / F.greatest(length, F.lit(1e-12)) for x in n]
    return f.select("frag", "fid", "v0", "v1", "v2", *[u.alias(f"n{c}") for u, c in zip(unit, "xyz")], (length / 2).alias("area"), *[((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(f"c{c}") for c in "xyz"])


def edges(faces: DataFrame) -> DataFrame:
    """frag, a, b (a < b), fid, slot: each face's three edges."""
    e = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(i).alias("slot")) for i, (p, q) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0")))])).alias("e")
    return faces.select("frag", "fid", e).select("frag", "e.a", "e.b", "fid", "e.slot")


def topology(vertices: DataFrame, faces: DataFrame, most_open: float = 0.002) -> DataFrame:
    """frag, n_edges, n_boundary, watertight and res, the median length of distinct edges."""
    e = edges(faces).groupBy("frag", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    for k in ("a", "b"):
        e = e.join(vertices.select("frag", F.col("vid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), ["frag", k])
    length = norm([F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"])
    g = e.groupBy("frag").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("c") != 2).alias("n_boundary"), F.median(length).alias("res"))
    return g.withColumn("watertight", F.col("n_boundary") <= most_open * F.col("n_edges"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """frag, f0, f1: faces that stand next to each other in an edge's list, by slot and face."""
    w = Window.partitionBy("frag", "a", "b").orderBy("slot", "fid")
    e = edges(faces).withColumn("f1", F.lead("fid").over(w))
    return e.where("f1 is not null").select("frag", F.col("fid").alias("f0"), "f1")


def face_components(faces: DataFrame) -> DataFrame:
    """frag, fid, component: faces that adjacency connects, named by the smallest fid; single faces too."""
    # faces of all fragments get ids of their own, so one run does all fragments
    ids = written(faces.select("frag", "fid").withColumn("node", F.monotonically_increasing_id()))
    adj = face_adjacency(faces)
    e = adj.join(ids.select("frag", F.col("fid").alias("f0"), F.col("node").alias("a")), ["frag", "f0"]).join(ids.select("frag", F.col("fid").alias("f1"), F.col("node").alias("b")), ["frag", "f1"])
    c = ids.join(connected_components(e.select("a", "b")), "node", "left").withColumn("g", F.coalesce("component", "node"))
    low = c.groupBy("g").agg(F.min("fid").alias("component"))
    return c.drop("component").join(low, "g").select("frag", "fid", "component")


def largest_component(faces: DataFrame) -> DataFrame:
    """faces of each fragment's component with the most faces; the first one on ties."""
    c = face_components(faces)
    size = c.groupBy("frag", "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("frag").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return faces.join(c.join(best, ["frag", "component"]).select("frag", "fid"), ["frag", "fid"], "left_semi")


def taubin(vertices: DataFrame, faces: DataFrame, rounds: int = 3, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """vertices smoothed by ``rounds`` pairs of steps towards, and away from, the inverse-distance mean of their neighbours."""
    e = edges(faces).select("frag", "a", "b").distinct()
    both = written(e.union(e.select("frag", F.col("b").alias("a"), F.col("a").alias("b"))))
    v = vertices.select("frag", "vid", "x", "y", "z")
    for factor in [shrink, grow] * rounds:
        p, q = v.select("frag", F.col("vid").alias("a"), *[F.col(c).alias(f"p{c}") for c in "xyz"]), v.select("frag", F.col("vid").alias("b"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
        j = both.join(p, ["frag", "a"]).join(q, ["frag", "b"])
        w = 1 / F.greatest(norm([F.col(f"p{c}") - F.col(f"q{c}") for c in "xyz"]), F.lit(1e-12))
        step = j.groupBy("frag", F.col("a").alias("vid")).agg(*[(F.sum(w * (F.col(f"q{c}") - F.col(f"p{c}"))) / F.sum(w)).alias(f"d{c}") for c in "xyz"])
        v = written(v.join(step, ["frag", "vid"], "left").select("frag", "vid", *[(F.col(c) + factor * F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"]))
    return v


def cluster_decimation(vertices: DataFrame, faces: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """A coarser mesh: the vertices of a cubic cell become their mean, and faces that collapse go."""
    key = F.struct(*[F.floor(F.col(c) / cell).alias(c) for c in "xyz"])
    v = vertices.withColumn("cell", key)
    low = v.groupBy("frag", "cell").agg(F.min("vid").alias("to"), *[F.avg(c).alias(c) for c in "xyz"])
    to = v.select("frag", "vid", "cell").join(low.select("frag", "cell", "to"), ["frag", "cell"]).select("frag", "vid", "to")
    f = faces
    for c in ("v0", "v1", "v2"):
        f = f.join(to.select("frag", F.col("vid").alias(c), F.col("to").alias(f"_{c}")), ["frag", c]).drop(c).withColumnRenamed(f"_{c}", c)
    f = f.where("v0 != v1 and v1 != v2 and v0 != v2")
    corners = F.array_sort(F.array("v0", "v1", "v2"))
    f = f.withColumn("k", corners).groupBy("frag", "k").agg(F.min_by(F.struct("fid", "v0", "v1", "v2"), "fid").alias("m")).select("frag", "m.*")
    return low.select("frag", F.col("to").alias("vid"), "x", "y", "z"), f


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the keys: the same in any partitioning and run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def sample_on_faces(vertices: DataFrame, faces: DataFrame, per_area: float | DataFrame, seed: int = 0) -> DataFrame:
    """frag, fid, k, x, y, z: points spread over faces by area, floor(per_area * area) or one more each; per_area may be a table (frag, per_area).

    Every face draws its own number of points, so no running total over faces is
    needed; points outside the triangle (u + v > 1) are folded back.
    """
    g = face_geometry(vertices, faces).select("frag", "fid", "v0", "v1", "v2", "area")
    g = g.join(per_area, "frag") if isinstance(per_area, DataFrame) else g.withColumn("per_area", F.lit(float(per_area)))
    want = F.col("area") * F.col("per_area")
    n = F.floor(want) + (uniform(seed, "frag", "fid") < want - F.floor(want)).cast("int")
    f = g.withColumn("n", n.cast("int")).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    f = f.withColumn("_u", uniform(seed + 1, "frag", "fid", "k")).withColumn("_v", uniform(seed + 2, "frag", "fid", "k"))
    fold = F.col("_u") + F.col("_v") > 1
    f = f.withColumn("u", F.when(fold, 1 - F.col("_u")).otherwise(F.col("_u"))).withColumn("v", F.when(fold, 1 - F.col("_v")).otherwise(F.col("_v")))
    for i in range(3):
        f = f.join(vertices.select("frag", F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), ["frag", f"v{i}"])
    at = lambda c: F.col(f"{c}0") + F.col("u") * (F.col(f"{c}1") - F.col(f"{c}0")) + F.col("v") * (F.col(f"{c}2") - F.col(f"{c}0"))
    return f.select("frag", "fid", "k", *[at(c).alias(c) for c in "xyz"])


def subsample(rows: DataFrame, keys: list[str], ident: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, by hash order."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, ident), ident)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
