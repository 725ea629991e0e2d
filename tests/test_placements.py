"""Placements of pairs against loops."""

import numpy as np

from terrafold.operators import placements

SCHEMA = "a long, b long, pose array<double>, score double, ord struct<i: long>, t double, accepted boolean"


def made(rng):
    """Pairs with clouds of like poses, ties in score, and one without an accepted candidate."""
    rows = []
    for pair in range(6):
        spots = [(rng.uniform(0, 6), rng.normal(size=3) * 3) for _ in range(3)]
        for i in range(14):
            a, at = spots[int(rng.integers(0, 3))]
            a += rng.normal() * 0.12
            m = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1.0]])
            pose = np.hstack([m, (at + rng.normal(size=3) * 0.3)[:, None]])
            rows.append((pair, pair + 10, pose.ravel().tolist(), float(rng.integers(0, 9)), (pair * 100 + i,), 1.0 + pair % 2, bool(pair and rng.random() < 0.5)))
    return rows


def by_pair(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        out.setdefault(r[:2], []).append(r)
    return out


def test_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = made(rng)
    points = {b: rng.normal(size=(7, 3)) * 2 for b in range(10, 16)}
    df = spark.createDataFrame(rows, SCHEMA)
    probes = spark.createDataFrame([(b, *map(float, p)) for b, ps in points.items() for p in ps], "node long, x double, y double, z double")
    m = lambda r: np.array(r[2]).reshape(3, 4)
    alike = lambda p, q: np.linalg.norm(m(p)[:, 3] - m(q)[:, 3]) < 0.8 and np.trace(m(p)[:, :3].T @ m(q)[:, :3]) > 2.9
    gap = lambda p, q: max(np.linalg.norm((m(p) - m(q)) @ [*x, 1]) for x in points[p[1]]) / p[5]

    kept, counts, rivals = [], {}, {}
    for pair, rs in by_pair(rows).items():
        mine = []
        for r in rs:
            if r[3] >= 2 and len(mine) < 4 and not any(alike(r, k) for k in mine):
                mine.append(r)
        kept += [(*pair, k, r[4][0]) for k, r in enumerate(mine)]
        apart = []
        for r in rs:
            if all(gap(r, k) > 1 for k in apart):
                apart.append(r)
        counts[pair] = len(apart)
        far = [r for r in rs[1:] if gap(r, rs[0]) > 1]
        if far and any(r[6] for r in rs):
            rivals[pair] = (far[0][4][0], round(gap(far[0], rs[0]), 9), far[0][6])
    got = placements.suppress_alike(df, 0.8, 2.0, 4).collect()
    assert sorted((r["a"], r["b"], r["rank"], r["ord"]["i"]) for r in got) == sorted(kept)
    assert {(r["a"], r["b"]): r["placements"] for r in placements.distinct_placements(df, probes).collect()} == counts and max(counts.values()) > 2
    assert {(r["a"], r["b"]): (r["ord"]["i"], round(r["moved"], 9), r["accepted"]) for r in placements.wide_rivals(df, probes).collect()} == rivals and len(rivals) == 5
    assert placements.distinct_placements(df.limit(0), probes).count() == 0
