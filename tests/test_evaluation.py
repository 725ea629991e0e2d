"""Thresholds, verdicts of poses, contact areas, and circles, spheres and axes against plain loops."""

from itertools import product

import numpy as np

from terrafold.operators import evaluation, fits


def test_best_thresholds_against_all_combinations(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 10)) if rng.random() > 0.1 else None, float(rng.integers(0, 10)) if i % 9 else float("nan"), bool(rng.random() < 0.7)) for i in range(60)]
    rows = [(p, q, ok or (p or 0) > 7) for p, q, ok in rows]
    df = spark.createDataFrame(rows, "p double, q double, ok boolean")
    tests = {"p": (1, [5.0, None, 8.0, 2.0, 5.0]), "q": (-1, [3.0, 9.0, None, 1.0])}
    best = None
    for x, y in product(tests["p"][1], tests["q"][1]):
        hit = [r for r in rows if (x is None or (r[0] is not None and r[0] >= x)) and (y is None or (r[1] == r[1] and r[1] <= y))]
        if all(r[2] for r in hit) and (best is None or len(hit) > best[2]):
            best = (x, y, len(hit), 0)
    got = evaluation.best_thresholds(df, tests, df.ok, ~df.ok).collect()
    assert [tuple(r) for r in got] == [best] and best[2] > 0
    assert evaluation.best_thresholds(df, {"p": (1, [None])}, df.ok, ~df.ok).count() == 0


def test_pose_verdicts(spark):
    still, off = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0], [1.0, 0, 0, 2.0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    back = [1.0, 0, 0, -2.0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    table = lambda rows, schema: spark.createDataFrame([tuple(list(map(float, x)) if isinstance(x, list) else x for x in r) for r in rows], schema)
    joins = table([(1, 2, off), (2, 1, back), (1, 3, still), (1, 4, off), (2, 5, still), (1, 2, back), (6, 7, still)], "a long, b long, pose array<double>")
    objects = table([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "x")], "node long, object string")
    truth = table([(1, still), (2, off), (3, still), (4, off)], "node long, pose array<double>")
    adjacent = table([(2, 1), (1, 4), (5, 2)], "a long, b long")
    got = evaluation.pose_verdicts(joins, objects, truth, adjacent, table([(2, 1.0, 0.0, 0.0)], "node long, x double, y double, z double"), 1.0)
    said = sorted((r["a"], r["b"], r["verdict"], r["off"]) for r in got.collect())
    # 6 and 7 are of no object and have no place
    assert [r[:3] for r in said] == [(1, 2, "correct"), (1, 2, "wrong_pose"), (1, 3, "non_adjacent"), (1, 4, "cross_object"), (2, 1, "correct"), (2, 5, "unscorable"), (6, 7, "unscorable")]
    assert said[1][3] == 4.0 and said[3][3] is None


def test_contact_areas_against_a_loop(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 4, (5, 6, 4))
    rows = [(int(grid[c]) if grid[c] else None, *map(int, c)) for c in np.ndindex(grid.shape)]
    want = {}
    for axis in range(3):
        p, q = (np.take(grid, range(o, grid.shape[axis] - 1 + o), axis) for o in (0, 1))
        for x, y in zip(p.ravel(), q.ravel()):
            if x and y and x != y:
                want[min(x, y), max(x, y)] = want.get((min(x, y), max(x, y)), 0) + 4.0
    got = {(r["a"], r["b"]): r["area"] for r in evaluation.contact_areas(spark.createDataFrame(rows, "label long, i long, j long, k long"), 2.0).collect()}
    assert got == want


def test_circles_spheres_and_axes(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 2 * np.pi, 40)
    circle = [(1, float(3 + 2 * np.cos(x)), float(-1 + 2 * np.sin(x))) for x in a] + [(2, float(i), float(2 * i)) for i in range(5)] + [(3, 0.0, 0.0)]
    got = {r["k"]: r for r in fits.circle_fit(spark.createDataFrame(circle, "k long, u double, v double"), "k").collect()}
    assert np.allclose([got[1]["cu"], got[1]["cv"], got[1]["radius"]], [3, -1, 2]) and got[2]["radius"] is None and got[3]["cu"] is None and got[2]["n"] == 5
    d = rng.normal(size=(30, 3))
    ball = [(1, *map(float, p)) for p in d / np.linalg.norm(d, axis=1, keepdims=True) * 5 + [1, 2, 3]] + [(2, float(i), 1.0, 0.0) for i in range(6)]
    got = {r["k"]: r for r in fits.sphere_fit(spark.createDataFrame(ball, "k long, x double, y double, z double"), "k").collect()}
    assert np.allclose([got[1][c] for c in ("cx", "cy", "cz", "radius")], [1, 2, 3, 5]) and got[2]["radius"] is None
    axis = np.array([2.0, -1.0, 2.0]) / 3
    u = np.cross(axis, [1, 0, 0])
    u /= np.linalg.norm(u)
    n = np.cos(a)[:, None] * u + np.sin(a)[:, None] * np.cross(axis, u)
    r = fits.axis_fit(spark.createDataFrame([(1, *map(float, p)) for p in n], "k long, nx double, ny double, nz double"), "k").first()
    assert abs(abs(np.array([r["ax"], r["ay"], r["az"]]) @ axis) - 1) < 1e-9 and r["n"] == 40 and abs(r["spread"]) < 1e-12
