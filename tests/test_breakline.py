"""Breaklines of a plate and of hand-made edges, against loops."""

import random

import numpy as np

from terrafold.operators import breakline, segment

from .test_surface import plate

XYZ = ("x", "y", "z")


def curves(edges):
    """Every curve as a tuple of edge names, from its smaller end on (rings from the smallest edge on, towards the smaller next half-edge), walked edge by edge."""
    at = {}
    for k, (a, b) in edges.items():
        at.setdefault(a, []).append(k)
        at.setdefault(b, []).append(k)

    def follow(k, v):
        way, seen = [k], {k}
        while len(at[v]) == 2:
            e = at[v][0] if at[v][1] == way[-1] else at[v][1]
            if e in seen:
                return way, e == k
            seen.add(e)
            way.append(e)
            v = edges[e][0] if edges[e][1] == v else edges[e][1]
        return way, False

    left, out = set(edges), []
    while left:
        k = min(left)
        way, ring = follow(k, edges[k][1])
        if not ring:
            back, _ = follow(k, edges[k][0])
            way = back[::-1] + way[1:]
            if way[-1] < way[0]:
                way = way[::-1]
        left -= set(way)
        out.append((tuple(way), ring))
    return sorted(out)


def traced(spark, edges):
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in edges.items()], "frag long, vid long, a long, b long")
    rows = {}
    for r in breakline.traced_chains(df).collect():
        rows.setdefault((r["chain"], r["closed"]), []).append((r["pos"], r["vid"]))
    for v in rows.values():
        assert sorted(p for p, _ in v) == list(range(len(v)))
    return sorted((tuple(k for _, k in sorted(v)), c) for (_, c), v in rows.items())


def test_curves_forks_and_rings(spark):
    rng = random.Random(4)
    names = iter(rng.sample(range(1000), 300))
    edges = {}

    def line(vertices):
        for a, b in zip(vertices, vertices[1:]):
            edges[next(names)] = (a, b) if rng.random() < 0.5 else (b, a)

    line(range(0, 40))  # an open curve
    line([*range(100, 130), 100])  # a ring
    line([200, 201, 202]); line([202, 203]); line([202, 204, 205])  # a fork  # noqa: E702
    line([300, 301])  # one edge
    line([400, 401, 402, 403, 401])  # a loop that hangs on a fork
    line([500, 501, 502, 500]); line([500, 503, 504, 500])  # two rings that touch  # noqa: E702
    line([600, 601]); line([600, 601])  # a ring of two edges  # noqa: E702
    assert traced(spark, edges) == curves(edges)


def test_the_rims_of_a_plate(spark):
    c, f = plate(10, np.array((4.0, 4.0, 0.5)))
    c = np.array(c, float)
    tri = c[np.array(f)]
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    side = np.abs(n[:, 2]) < 1e-9 * np.linalg.norm(n, axis=1).max()
    v = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(c)], "frag long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(1, i, *map(int, q)) for i, q in enumerate(f)], "frag long, fid long, v0 long, v1 long, v2 long")
    walls = spark.createDataFrame([(1, 0.5)], "frag long, t double")
    v = segment.scaled(v, walls)
    labels = spark.createDataFrame([(1, i, bool(s)) for i, s in enumerate(side)], "frag long, vid long, is_fracture boolean")
    pts = segment.face_points(v, faces).join(labels, ["frag", "vid"])
    got = breakline.breaklines(v, faces, pts).toPandas().sort_values("vid")
    want = {}
    for i, q in enumerate(f):
        for a, b in zip(q, [*q[1:], q[0]]):
            want.setdefault((min(a, b), max(a, b)), []).append(side[i])
    rim = {k for k, s in want.items() if len(s) == 2 and s[0] != s[1]}
    assert set(zip(got.a, got.b)) == rim and len(got) == len(rim)
    mid = np.array([(c[a] + c[b]) / 2 / 0.5 for a, b in zip(got.a, got.b)])
    assert np.allclose(got[list(XYZ)], mid)

    # normals and frames against a loop
    p, nn, area = tri.mean(1) / 0.5, n / np.linalg.norm(n, axis=1, keepdims=True), np.linalg.norm(n, axis=1) / 2 / 0.25
    near = np.linalg.norm(p[:, None] - mid[None], axis=2)
    far = near.min(1) >= breakline.INNER
    for k in range(0, len(got), 7):
        r = got.iloc[k]
        for name, mask in (("s", ~side), ("f", side)):
            for use in (far & mask, mask):
                ball = use & (near[:, k] < breakline.OUTER)
                m = (nn[ball] * area[ball, None]).sum(0)
                m = m / max(np.linalg.norm(m), 1e-12)
                if np.linalg.norm(m) >= 0.5:
                    break
            assert np.allclose([r[f"{name}{x}"] for x in XYZ], m, atol=1e-9)
        s, g, t = ([r[f"{q}{x}"] for x in XYZ] for q in "sgt")
        if r.valid:
            assert abs(np.dot(s, g)) < 1e-9 and np.allclose(np.cross(s, g), t) and 45 < r.dihedral < 135
    assert got.valid.mean() > 0.9 and 0 < got["sub"].sum() < len(got) and got[got["sub"]].valid.all()

    lines = breakline.traced_chains(spark.createDataFrame(got[["frag", "vid", "a", "b"]])).toPandas()
    assert lines.chain.nunique() == 2 and lines.closed.all() and (lines.groupby("chain").size() == len(rim) // 2).all()
