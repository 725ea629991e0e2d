"""Two halves of a slab broken along a wavy face: the true pose, one slid along the break, one pressed in and one far away, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import verify
from terrafold.params import Acceptance

DEPTH, STEP = 6.0, 0.2
YS = np.linspace(0, DEPTH, 31)
XS = 2.5 + 0.5 * np.sin(YS * 1.7) + 0.3 * np.sin(YS * 3.1 + 1)


def half(side):
    """A closed half slab, x from 0 to the break (side 0) or from it to 5 (side 1): vertices, faces, which faces are fracture."""
    m, k = 14, 6
    v, ids, f, frac = [], {}, [], []

    def at(i, j, l):
        if (i, j, l) not in ids:
            ids[i, j, l] = len(v)
            u = i / m
            v.append((u * XS[j] if side == 0 else 5 + u * (XS[j] - 5), YS[j], l / (k - 1)))
        return ids[i, j, l]

    def grid(point, ni, nj, broken):
        for i in range(ni):
            for j in range(nj):
                a, b, c, d = point(i, j), point(i + 1, j), point(i + 1, j + 1), point(i, j + 1)
                for t in ((a, b, c), (a, c, d)):
                    f.append(t[::-1] if side else t)
                    frac.append(broken)

    n = len(YS) - 1
    grid(lambda i, j: at(i, n - j, 0), m, n, False)
    grid(lambda i, j: at(i, j, k - 1), m, n, False)
    grid(lambda j, l: at(m, j, l), n, k - 1, True)
    grid(lambda j, l: at(0, n - j, l), n, k - 1, True)
    grid(lambda i, l: at(i, 0, l), m, k - 1, True)
    grid(lambda i, l: at(m - i, n, l), m, k - 1, True)
    return np.array(v), np.array(f), frac


def rotation(axis, deg):
    axis = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(np.radians(deg)) * k + (1 - np.cos(np.radians(deg))) * k @ k


def segment_d(p, a, b):
    s = np.clip(((p - a) * (b - a)).sum(-1) / ((b - a) ** 2).sum(-1), 0, 1)
    return np.linalg.norm(p - a - s[..., None] * (b - a), axis=-1)


def surface_d(p, tri):
    """Distance of points to the nearest of the triangles, by all of them."""
    out = []
    for q in np.array_split(p, max(1, len(p) // 200)):
        q = q[:, None]
        a, b, c = tri[None, :, 0], tri[None, :, 1], tri[None, :, 2]
        n = np.cross(b - a, c - a)
        over = np.ones((len(q), tri.shape[0]), bool)
        for u, w in ((a, b), (b, c), (c, a)):
            over &= (np.cross(w - u, q - u) * n).sum(-1) >= 0
        plane = np.abs(((q - a) * n).sum(-1)) / np.linalg.norm(n, axis=-1)
        edge = np.minimum(np.minimum(segment_d(q, a, b), segment_d(q, b, c)), segment_d(q, c, a))
        out.append(np.where(over, plane, edge).min(1))
    return np.concatenate(out)


def in_half(p, side):
    x = np.interp(p[:, 1], YS, XS)
    return (p[:, 1] > 0) & (p[:, 1] < DEPTH) & (p[:, 2] > 0) & (p[:, 2] < 1) & ((p[:, 0] > 0) & (p[:, 0] < x) if side == 0 else (p[:, 0] > x) & (p[:, 0] < 5))


TURN, SHIFT = rotation([1, 2, 3], 50), np.array([4.0, -2, 7])
#: how b, in its place, is moved by each candidate
MOVES = {1: (np.eye(3), [0, 0, 0]), 2: (np.eye(3), [0.1, 0.9, 0]), 3: (np.eye(3), [-0.4, 0, 0]), 4: (np.eye(3), [60, 0, 0]), 5: (rotation([0, 0, 1], 1.0), [0.06, 0, 0.02])}


def pose_of(move):
    r, s = move
    rot = np.array(r) @ TURN.T
    return np.hstack([rot, (np.array(s) - rot @ SHIFT)[:, None]])


@pytest.fixture(scope="module")
def slab(spark):
    vs, fs, ls = [], [], []
    for frag in (0, 1):
        v, f, frac = half(frag)
        v = v if frag == 0 else v @ TURN.T + SHIFT
        vs += [(frag, i, *map(float, p)) for i, p in enumerate(v)]
        fs += [(frag, i, *map(int, q)) for i, q in enumerate(f)]
        ls += [(frag, i, bool(b)) for i, b in enumerate(frac)]
    v = spark.createDataFrame(vs, "frag long, vid long, x double, y double, z double")
    f = spark.createDataFrame(fs, "frag long, fid long, v0 long, v1 long, v2 long")
    labels = spark.createDataFrame(ls, "frag long, fid long, is_fracture boolean")
    walls = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None)], "frag long, t double")
    m = verify.measured(v, f, labels, walls, surface_samples=800)
    cand = spark.createDataFrame([(i, 0, 1, pose_of(q).ravel().tolist()) for i, q in MOVES.items()] + [(9, 0, 7, pose_of(MOVES[1]).ravel().tolist())], "cid long, a long, b long, pose array<double>")
    return m, cand


@pytest.fixture(scope="module")
def rows(slab):
    m, cand = slab
    return {r["cid"]: r for r in verify.verify(cand, m).withColumn("why", verify.refusals(Acceptance())).collect()}


def test_measures_are_those_of_plain_loops(slab, rows):
    (m, _), got = slab, rows
    assert set(got) == set(MOVES)  # an unknown fragment gives no row
    frags = {r["frag"]: r for r in m.frags.collect()}
    assert all(r["watertight"] for r in frags.values())
    t, res = 1.0, max(r["res"] for r in frags.values())
    sc = {k: max(a * t, b * res) for k, (a, b) in {"tight": (0.01, 0.15), "facing": (0.3, 1.0), "gap": (0.03, 0.45), "seam": (0.12, 1.8), "near": (0.5, 4.0), "pen": (0.06, 0.9)}.items()}
    of = lambda df, frag, cols="xyz": np.array([[r[c] for c in cols] for r in df.where(f"frag = {frag}").select(*cols).collect()]).reshape(-1, len(cols))
    corners = [f"{p}{c}" for p in "abc" for c in "xyz"]
    tri = {k: of(m.tri, k, corners).reshape(-1, 3, 3) for k in (0, 1)}
    broken = {k: of(m.tri.where("is_fracture"), k, corners).reshape(-1, 3, 3) for k in (0, 1)}
    pf, ps = ({k: of(d, k) for k in (0, 1)} for d in (m.fracture, m.surface))
    normal = ["nx", "ny", "nz"]
    brk, mar = ({k: (of(d, k), of(d, k, normal)) for k in (0, 1)} for d in (m.breakline, m.margin))
    for cid, move in MOVES.items():
        r, p = got[cid], pose_of(move)
        to = lambda q: q @ p[:, :3].T + p[:, 3]
        back = lambda q: (q - p[:, 3]) @ p[:, :3]
        for s, d, area in (("a", surface_d(back(pf[0]), broken[1]), frags[0]["frac_area"]), ("b", surface_d(to(pf[1]), broken[0]), frags[1]["frac_area"])):
            near = d[d < sc["facing"]]
            want = ((near < sc["tight"]).mean(), np.median(near) / t, (d < 2 * sc["tight"]).mean() * area) if len(near) >= 20 else (0, 1, 0)
            assert np.allclose([r[f"{k}_{s}"] for k in ("tight", "gap", "contact")], want, atol=1e-6), (cid, s)
        assert r["tight"] == min(r["tight_a"], r["tight_b"]) and r["gap"] == max(r["gap_a"], r["gap_b"]) and r["contact"] == min(r["contact_a"], r["contact_b"])
        gap = np.linalg.norm(brk[0][0][:, None] - to(brk[1][0])[None], axis=-1)
        j = gap.argmin(1)
        on = (gap.min(1) < sc["seam"]) & ((brk[0][1] * (brk[1][1] @ p[:, :3].T)[j]).sum(1) > 0.7)
        assert abs(r["seam"] - len({tuple(c) for c in np.floor(brk[0][0][on] * 3)}) / 3) < 1e-9, cid
        moved = to(mar[1][0])
        gap = np.linalg.norm(moved[:, None] - mar[0][0][None], axis=-1)
        # margins lie in lattices, so a nearest row is often a tie: either counts
        on = gap.min(1) < sc["near"]
        if on.sum() > 20:
            low, high = [], []
            for i in np.flatnonzero(on):
                ties = np.flatnonzero(gap[i] < gap[i].min() + 1e-9)
                n = mar[0][1][ties]
                steps, agree = np.abs(((moved[i] - mar[0][0][ties]) * n).sum(1)), n @ (p[:, :3] @ mar[1][1][i])
                low.append((steps.min(), agree.min()))
                high.append((steps.max(), agree.max()))
            low, high = np.median(low, axis=0), np.median(high, axis=0)
            assert low[0] - 1e-9 <= r["cont"] <= high[0] + 1e-9 and low[1] - 1e-9 <= r["cont_n"] <= high[1] + 1e-9, cid
        else:
            assert (r["cont"], r["cont_n"]) == (1.0, -1.0), cid
        shares, lows = [], []
        home = lambda q: (q - SHIFT) @ TURN  # noqa: E731  b's own place
        for pts, inside, surface in ((to(ps[1]), in_half(to(ps[1]), 0), tri[0]), (back(ps[0]), in_half(home(back(ps[0])), 1), tri[1])):
            d = surface_d(pts, surface)
            shares.append((inside & (d > sc["pen"])).mean())
            # on the surface itself the side is a matter of the last digit
            clear = (d > 1e-6) & inside
            lows.append(d[inside].max() if clear.any() else -d.min())
        assert abs(r["pen"] - max(shares)) < 1e-9, cid
        if cid == 4:
            assert r["pen_depth"] is None
        else:
            assert abs(r["pen_depth"] - max(lows)) < 1e-5, cid
    assert got[1]["tight"] > 0.9 and got[1]["seam"] > 5 and got[1]["cont_n"] > 0.95 and got[1]["pen"] == 0


def test_true_pose_is_accepted_and_others_say_why_not(rows):
    why = {i: [w.split(" ")[0] for w in r["why"]] for i, r in rows.items()}
    assert why[1] == [] and "penetration" in why[3] and {"tight", "gap", "seam", "normal"} <= set(why[4])
    assert "normal agreement -1.000 < 0.8" in rows[4]["why"]


def test_early_rejection_measures_only_the_rest(slab, rows):
    (m, cand), full = slab, rows
    got = {r["cid"]: r for r in verify.verify(cand.where("cid in (1, 4)"), m, early=0.25).withColumn("why", verify.refusals(Acceptance(), 0.25)).collect()}
    for cid, r in got.items():
        assert r["partial"] == (full[cid]["tight"] < 0.25)
        if r["partial"]:
            assert (r["cont"], r["cont_n"], r["pen"], r["why"]) == (1.0, -1.0, 0.0, ["rejected early (tight below 0.25)"])
        else:
            assert all(r[k] == full[cid][k] for k in ("cont", "cont_n", "pen", "pen_depth"))
    assert got[4]["partial"] and not got[1]["partial"]


def test_holes_make_penetration_unavailable_and_no_candidates_no_rows(spark, slab):
    m, cand = slab
    from dataclasses import replace

    open_ = replace(m, frags=m.frags.withColumn("watertight", F.col("frag") == 0), margin=m.margin.limit(0))
    r = verify.verify(cand.where("cid = 3"), open_).first()
    assert (r["pen"], r["pen_depth"], r["pen_unavailable"], r["cont_n"]) == (0.0, 0.0, True, -1.0)
    assert verify.verify(cand.limit(0), m).count() == 0


def test_redraws_name_the_draw_that_fails(slab):
    m, cand = slab
    from dataclasses import replace

    from terrafold.operators import probes
    from terrafold.params import TierRule

    # the second draw has no samples on the break
    rows, held = probes.redraws(cand.where("cid in (1, 9)"), [m, replace(m, fracture=m.fracture.limit(0))], Acceptance(), TierRule(min_seam=3.0))
    assert sorted((r["cid"], r["draw"]) for r in rows.collect()) == [(1, 1), (1, 2)]
    assert [tuple(r) for r in held.collect()] == [(1, 1, "redraw 2: tight 0.0000 < 0.35")]
