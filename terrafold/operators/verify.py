"""Verification of placed pairs: what a candidate join measures, from the meshes of its two fragments.

A candidate(cid, a, b, pose) says that the pose takes fragment b to where it joins
a. Meshes stay as they are and stand in their grids once, however many candidates
look at them; only sampled points are placed, b's by the pose and a's back by its
inverse. Distances that tests ask for are in the pair's own scales, from the
thinner wall and the coarser mesh. All candidates go through each join together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import poses
from terrafold.functions.columns import dot, fixed, pair_scales
from terrafold.operators.breakline import breaklines
from terrafold.operators.evidence import fracture_samples, nearest_any, shell_margin
from terrafold.operators.graph import written
from terrafold.operators.mesh import face_geometry, sample_on_faces, topology
from terrafold.operators.segment import face_points, scaled
from terrafold.operators.spatial import AXES
from terrafold.operators.surface import closest_faces, faces_within, inside_votes, triangles
from terrafold.params import Acceptance

#: Facing samples and near margin points that a measure needs, cosine over which two shells agree, seam cells a wall, surface samples of a fragment.
MIN_FACING, MIN_NEAR, NORMAL_AGREE, SEAM_VOXEL, SURFACE_SAMPLES = 20, 21, 0.7, 3, 5_000

_NORMAL = [f"n{c}" for c in AXES]
_SCALES = ("tight", "facing", "gap", "seam", "near", "pen")


@dataclass(frozen=True)
class Measured:
    """What verification reads of a collection; lengths are in the meshes' own unit.

    frags has frag, t, res, watertight, frac_area; tri has frag, fid, ax.. to cz and
    is_fracture; the points have frag, vid (unique in its fragment) and x, y, z,
    those of breakline and margin also the shell's normal nx..
    """

    frags: DataFrame
    tri: DataFrame
    fracture: DataFrame
    surface: DataFrame
    breakline: DataFrame
    margin: DataFrame


def measured(vertices: DataFrame, faces: DataFrame, labels: DataFrame, walls: DataFrame, surface_samples: int = SURFACE_SAMPLES, seed: int = 0) -> Measured:
    """The tables of labelled meshes: labels(frag, fid, is_fracture), walls(frag, t). Fragments without a wall over 0 are left out; another seed draws other samples."""
    walls = walls.where("t > 0").select("frag", "t")
    faces = faces.join(walls.select("frag"), "frag", "left_semi")
    geo = face_geometry(vertices, faces).join(labels.select("frag", "fid", "is_fracture"), ["frag", "fid"])
    area = geo.groupBy("frag").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("is_fracture"), F.col("area")).otherwise(0.0)).alias("frac_area"))
    frags = written(walls.join(topology(vertices, faces).select("frag", "res", "watertight"), "frag").join(area, "frag"))
    tri = written(triangles(vertices, faces).join(labels.select("frag", "fid", "is_fracture"), ["frag", "fid"]))
    broken = faces.join(labels.where("is_fracture").select("frag", "fid"), ["frag", "fid"], "left_semi")
    n = fracture_samples(F.col("frac_area"), F.col("t"))
    on = lambda f, n, over, seed: sample_on_faces(vertices, f, frags.where(F.col(over) > 0).select("frag", (n / F.col(over)).alias("per_area")), seed).select("frag", F.struct("fid", "k").alias("vid"), *AXES)
    fracture, surface = written(on(broken, n, "frac_area", 11 + seed)), written(on(faces, F.lit(surface_samples), "area", 17 + seed))
    # breaklines and margins are found in walls
    v = scaled(vertices, walls)
    pts = written(face_points(v, faces).join(labels.select("frag", F.col("fid").alias("vid"), "is_fracture"), ["frag", "vid"]))
    lines = written(breaklines(v, faces, pts))
    back = lambda df, normal: df.join(walls, "frag").select("frag", "vid", *[(F.col(c) * F.col("t")).alias(c) for c in AXES], *[F.col(k).alias(c) for k, c in zip(normal, _NORMAL)])
    shell = pts.where("not is_fracture")
    near = shell_margin(nearest_any(shell, lines, "frag", "vid", 0.375, most=3), walls.select("frag", F.lit(1.0).alias("t")))
    margin = back(shell.join(near.select("frag", "vid"), ["frag", "vid"], "left_semi"), _NORMAL)
    return Measured(frags, tri, fracture, surface, written(back(lines, [f"s{c}" for c in AXES])), written(margin))


def scaled_candidates(cand: DataFrame, frags: DataFrame) -> DataFrame:
    """cid, a, b, pose with t, the pair's scales (as sc_tight and so on), sealed (both watertight) and the areas of fracture; candidates with an unknown fragment go."""
    end = lambda k: frags.select(F.col("frag").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("t", "res", "watertight", "frac_area")])
    j = cand.select("cid", "a", "b", "pose").join(end("a"), "a").join(end("b"), "b")
    sc = pair_scales(F.least("t_a", "t_b"), F.greatest("res_a", "res_b"))
    sealed = F.coalesce(F.col("watertight_a") & F.col("watertight_b"), F.lit(False))
    return j.select("cid", "a", "b", "pose", F.least("t_a", "t_b").alias("t"), *[sc[k].alias(f"sc_{k}") for k in _SCALES], sealed.alias("sealed"), "frac_area_a", "frac_area_b")


def placed(cand: DataFrame, pts: DataFrame, side: str, moved: bool = True) -> DataFrame:
    """cand with each of the points of its fragment a or b (``side``): vid, x.. and nx.. (if they have them), brought to the other fragment unless ``moved`` is false."""
    has = [c for c in _NORMAL if c in pts.columns]
    j = cand.join(pts.select(F.col("frag").alias(side), "vid", *[F.col(c).alias(f"p{c}") for c in (*AXES, *has)]), side)
    if not moved:
        return j.select(*cand.columns, "vid", *[F.col(f"p{c}").alias(c) for c in (*AXES, *has)])
    j = j if side == "b" else j.withColumn("pose", poses.inverse("pose"))
    at = poses.apply("pose", [f"p{c}" for c in AXES])
    turned = poses.rotate("pose", [f"p{c}" for c in has]) if has else []
    return j.select(*[c for c in cand.columns], "vid", *[x.alias(c) for x, c in zip([*at, *turned], (*AXES, *has))])


def _both(cand: DataFrame, pts: DataFrame, scale: str) -> DataFrame:
    """frag (the other fragment's), pid (candidate, side whose points they are, vid), x.. and window: the points of both sides, each placed on the other."""
    one = lambda side, other: placed(cand, pts, side).select(F.col(other).alias("frag"), F.struct("cid", F.lit(side).alias("side"), "vid").alias("pid"), *AXES, F.col(scale).alias("window"))
    return one("a", "b").unionByName(one("b", "a"))


def _windowed(tri: DataFrame, cand: DataFrame, scale: str) -> DataFrame:
    """tri with window: the widest that any of its fragment's candidates has."""
    ends = cand.select(F.explode(F.array("a", "b")).alias("frag"), F.col(scale).alias("window"))
    return tri.join(ends.groupBy("frag").agg(F.max("window").alias("window")), "frag")


def _counts(cand: DataFrame, pts: DataFrame) -> DataFrame:
    """cid, n_a, n_b: how many points each side has."""
    n = pts.groupBy("frag").agg(F.count(F.lit(1)).alias("n"))
    for k in "ab":
        cand = cand.join(n.select(F.col("frag").alias(k), F.col("n").alias(f"n_{k}")), k, "left")
    return cand.select("cid", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def _by_side(rows: DataFrame, names: list[str]) -> DataFrame:
    """A row for each cid from rows(cid, side, names): name_a, name_b."""
    return rows.groupBy("cid").agg(*[F.max(F.when(F.col("side") == s, F.col(n))).alias(f"{n}_{s}") for n in names for s in "ab"])


def contacts(cand: DataFrame, m: Measured, min_facing: int = MIN_FACING) -> DataFrame:
    """cid and, for side a, side b and the worse of both: tight, the share of facing fracture samples in tight contact, gap, their median distance in walls, and contact, the area within twice tight in squared walls.

    A side of fewer than ``min_facing`` facing samples has 0, 1 and 0.
    """
    d = faces_within(_both(cand, m.fracture, "sc_facing"), _windowed(m.tri.where("is_fracture"), cand, "sc_facing"), F.col("window"), "frag", "pid")
    d = d.select("pid.cid", "pid.side", "d").join(cand.select("cid", "sc_tight"), "cid")
    g = d.groupBy("cid", "side").agg(F.count(F.lit(1)).alias("facing"), F.avg((F.col("d") < F.col("sc_tight")).cast("double")).alias("tight"), F.count_if(F.col("d") < 2 * F.col("sc_tight")).alias("touching"), F.median("d").alias("gap"))
    j = cand.select("cid", "t", "frac_area_a", "frac_area_b").join(_counts(cand, m.fracture), "cid").join(_by_side(g, ["facing", "tight", "touching", "gap"]), "cid", "left")
    for s in "ab":
        enough = F.coalesce(F.col(f"facing_{s}") >= min_facing, F.lit(False))
        j = j.withColumn(f"contact_{s}", F.when(enough, F.col(f"touching_{s}") / F.col(f"n_{s}") * F.col(f"frac_area_{s}") / F.col("t") ** 2).otherwise(0.0))
        j = j.withColumn(f"tight_{s}", F.when(enough, F.col(f"tight_{s}")).otherwise(0.0)).withColumn(f"gap_{s}", F.when(enough, F.col(f"gap_{s}") / F.col("t")).otherwise(1.0))
    worse = {"tight": F.least, "gap": F.greatest, "contact": F.least}
    return j.select("cid", *[c for k, f in worse.items() for c in (f"{k}_a", f"{k}_b", f(f"{k}_a", f"{k}_b").alias(k))])


def _nearest(left: DataFrame, right: DataFrame, scale: str) -> DataFrame:
    """cid, vid, with lx.., ln.. of each left row and rx.., rn.. of the nearest right row of its candidate, nearer than the scale (strict)."""
    left, right = written(left), written(right)
    unit = lambda df: df.select("cid", "vid", *[(F.col(c) / F.col(scale)).alias(c) for c in AXES])
    near = nearest_any(unit(left), unit(right), "cid", "vid", 0.25, most=3)
    cols = [*AXES, *_NORMAL]
    out = near.select("cid", "vid", "other").join(left.select("cid", "vid", "t", *[F.col(c).alias(f"l{c}") for c in cols]), ["cid", "vid"])
    return out.join(right.select("cid", F.col("vid").alias("other"), *[F.col(c).alias(f"r{c}") for c in cols]), ["cid", "other"])


def seam_points(cand: DataFrame, m: Measured) -> DataFrame:
    """cid, vid, t, lx.., ..: a's breakline points whose nearest placed breakline point of b lies within the seam's scale, with shells that agree."""
    near = _nearest(placed(cand, m.breakline, "a", moved=False), placed(cand, m.breakline, "b"), "sc_seam")
    return near.where(dot([f"l{c}" for c in _NORMAL], [f"r{c}" for c in _NORMAL]) > NORMAL_AGREE)


def seams(cand: DataFrame, m: Measured) -> DataFrame:
    """cid, seam: how long the seam is in walls, in cells of a third of the wall; candidates without one have no row."""
    cells = seam_points(cand, m).select("cid", *[F.floor(F.col(f"l{c}") / (F.col("t") / SEAM_VOXEL)).alias(f"c{c}") for c in AXES]).distinct()
    return cells.groupBy("cid").agg((F.count(F.lit(1)) / SEAM_VOXEL).alias("seam"))


def continuities(cand: DataFrame, m: Measured, min_near: int = MIN_NEAR) -> DataFrame:
    """cid, cont, cont_n: the median step between the two shells at the seam in walls, and their normals' median agreement; fewer than ``min_near`` points have no row."""
    near = _nearest(placed(cand, m.margin, "b"), placed(cand, m.margin, "a", moved=False), "sc_near")
    normal = [f"r{c}" for c in _NORMAL]
    step = F.abs(dot([F.col(f"l{c}") - F.col(f"r{c}") for c in AXES], normal)) / F.col("t")
    g = near.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.median(step).alias("cont"), F.median(dot([f"l{c}" for c in _NORMAL], normal)).alias("cont_n"))
    return g.where(F.col("n") >= min_near).select("cid", "cont", "cont_n")


def penetrations(cand: DataFrame, m: Measured) -> DataFrame:
    """cid, pen, pen_depth: the larger share of a side's surface samples deeper than the pair's scale inside the other, and the deepest in walls.

    Where nothing is inside, pen_depth is minus the clearance, if that is under the
    near scale, and null beyond. Only candidates of two watertight fragments have a row.
    """
    cand = cand.where("sealed")
    pts = written(_both(cand, m.surface, "sc_pen"))
    box = m.tri.groupBy("frag").agg(*[f(g(*[f"{p}{c}" for p in "abc"])).alias(f"{k}_{c}") for c in AXES for k, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    within = F.lit(True)
    for c in AXES:
        within = within & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    boxed = written(pts.join(box, "frag").where(within).select(*pts.columns))
    tri = written(_windowed(m.tri, cand, "sc_pen"))
    inside = boxed.join(inside_votes(boxed, tri, "frag", "pid").where("inside").select("frag", "pid"), ["frag", "pid"], "left_semi")
    deep = closest_faces(inside, tri, F.col("window"), "frag", "pid").select("pid.cid", "pid.side", "d").join(cand.select("cid", "sc_pen"), "cid")
    deep = written(deep.groupBy("cid", "side").agg(F.count_if(F.col("d") > F.col("sc_pen")).alias("deep"), F.max("d").alias("low")))
    # sides of which nothing is inside: how near the surfaces come
    clear = _both(cand, m.surface, "sc_near").join(deep.select("cid", "side"), (F.col("pid.cid") == F.col("cid")) & (F.col("pid.side") == F.col("side")), "left_anti")
    clear = faces_within(clear, _windowed(m.tri, cand, "sc_near"), F.col("window"), "frag", "pid")
    clear = clear.groupBy("pid.cid", "pid.side").agg(F.lit(0).cast("long").alias("deep"), (-F.min("d")).alias("low"))
    j = cand.select("cid", "t").join(_counts(cand, m.surface), "cid").join(_by_side(deep.unionByName(clear), ["deep", "low"]), "cid", "left")
    share = [F.when(F.col(f"n_{s}") > 0, F.coalesce(f"deep_{s}", F.lit(0)) / F.col(f"n_{s}")).otherwise(0.0) for s in "ab"]
    return j.select("cid", F.greatest(*share).alias("pen"), (F.greatest("low_a", "low_b") / F.col("t")).alias("pen_depth"))


def verify(cand: DataFrame, m: Measured, early: float | None = None, min_facing: int = MIN_FACING, min_near: int = MIN_NEAR) -> DataFrame:
    """A row for each candidate: cid, a, b, the measures of contacts, seam, gap_limit, tight_delta (the pair's scales in walls), cont, cont_n, pen, pen_depth, pen_unavailable, partial, score.

    Fragments that aren't both watertight have pen 0 and pen_unavailable; too few
    points at the seam give cont 1 and cont_n -1. With ``early``, a candidate whose
    tight is under it is partial: its shells and penetration aren't measured, and
    it has those values too. Empty tables give no rows; a fragment without
    samples, breakline or margin measures as one that is far away.
    """
    c = written(scaled_candidates(cand, m.frags))
    first = written(contacts(c, m, min_facing).join(seams(c, m), "cid", "left").withColumn("partial", F.col("tight") < early if early is not None else F.lit(False)))
    rest = c if early is None else written(c.join(first.where("not partial").select("cid"), "cid", "left_semi"))
    out = c.select("cid", "a", "b", "t", "sc_gap", "sc_tight", "sealed").join(first, "cid").join(continuities(rest, m, min_near), "cid", "left").join(penetrations(rest, m), "cid", "left")
    or_else = lambda k, v: F.coalesce(k, F.lit(v)).alias(k)
    sides = [f"{k}{s}" for k in ("tight", "gap", "contact") for s in ("_a", "_b", "")]
    return out.select(
        "cid", "a", "b", *sides, or_else("seam", 0.0), (F.col("sc_gap") / F.col("t")).alias("gap_limit"), (F.col("sc_tight") / F.col("t")).alias("tight_delta"),
        or_else("cont", 1.0), or_else("cont_n", -1.0), or_else("pen", 0.0), F.when(F.col("sealed") & ~F.col("partial"), F.col("pen_depth")).otherwise(0.0).alias("pen_depth"),
        (~F.col("sealed") & ~F.col("partial")).alias("pen_unavailable"), "partial", (F.coalesce("seam", F.lit(0.0)) * F.col("tight")).alias("score"),
    )


def refusals(rule: Acceptance, early: float = 0.0) -> Column:
    """Why verify's row is refused, a sentence for each limit that it misses, empty where it is accepted. A null or NaN misses. The gap's limit is the pair's own."""
    low = lambda k, v: ~F.coalesce(~F.isnan(k) & (F.col(k) >= v), F.lit(False))
    high = lambda k, v: ~F.coalesce(~F.isnan(k) & (F.col(k) <= v), F.lit(False))
    text = lambda k, n: F.coalesce(fixed(k, n), F.lit("NaN"))
    said = [
        F.when(low("tight", rule.min_tight), F.concat(F.lit("tight "), text("tight", 3), F.lit(f" < {rule.min_tight}"))),
        F.when(high("gap", F.col("gap_limit")), F.concat(F.lit("gap "), text("gap", 4), F.lit(" t > "), text("gap_limit", 4), F.lit(" t"))),
        F.when(high("pen", rule.max_pen), F.concat(F.lit("penetration "), text("pen", 4), F.lit(f" > {rule.max_pen}"))),
        F.when(low("seam", rule.min_seam), F.concat(F.lit("seam "), text("seam", 1), F.lit(f" t < {rule.min_seam:g} t"))),
        F.when(low("cont_n", rule.min_cont), F.concat(F.lit("normal agreement "), text("cont_n", 3), F.lit(f" < {rule.min_cont}"))),
    ]
    return F.when(F.col("partial"), F.array(F.lit(f"rejected early (tight below {early})"))).otherwise(F.filter(F.array(*said), lambda x: x.isNotNull()))
