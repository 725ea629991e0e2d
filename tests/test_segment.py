"""Shell and fracture of a plate whose sides are the fracture, and the steps against loops."""

import numpy as np

from terrafold.operators import mesh, segment

from .test_surface import plate


def test_the_sides_of_a_plate_are_fracture(spark):
    c, f = plate(12, np.array((4.0, 3.0, 0.5)))
    v = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(c)], "frag long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(1, i, *q) for i, q in enumerate(f)], "frag long, fid long, v0 long, v1 long, v2 long")
    walls = spark.createDataFrame([(1, 0.5), (2, 0.0)], "frag long, t double")
    got = {r["fid"]: r["is_fracture"] for r in segment.segment(v, faces, walls).collect()}
    assert len(got) == len(f)
    c = np.array(c)
    area, right = 0.0, 0.0
    for i, q in enumerate(f):
        a, b, d = c[list(q)]
        n = np.cross(b - a, d - a)
        side = abs(n[2]) < 1e-9
        area += np.linalg.norm(n)
        right += np.linalg.norm(n) * (got[i] == side)
    assert right / area > 0.9 and any(got.values()) and not all(got.values())


def test_islands_and_growth(spark):
    """A strip of squares in a row: labels, areas and normals are set by hand."""
    n = 12
    broken = [0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 1]
    labels = spark.createDataFrame([(1, i, 1.0, bool(b)) for i, b in enumerate(broken)], "frag long, vid long, area double, is_fracture boolean")
    adjacency = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "frag long, f0 long, f1 long")
    cleaned = segment.without_islands(labels, adjacency, True, 2.0)
    assert [r[0] for r in cleaned.orderBy("vid").select("is_fracture").collect()] == [i >= 6 for i in range(n)]
    kept = segment.without_islands(labels, adjacency, False, 2.5)
    assert [r[0] for r in kept.orderBy("vid").select("is_fracture").collect()] == [i < 3 or i >= 6 for i in range(n)]
    tilt = [0] * 8 + [20, 60, 0, 0]
    pts = spark.createDataFrame([(1, i, 0.1 * i, 0.0, 0.0, float(np.sin(np.radians(a))), 0.0, float(np.cos(np.radians(a))), 1.0) for i, a in enumerate(tilt)], "frag long, vid long, x double, y double, z double, nx double, ny double, nz double, area double")
    grown = segment.grown_shell(cleaned, pts, adjacency)
    # face 9 is turned too far, 10 and 11 lie behind it
    assert [r[0] for r in grown.orderBy("vid").select("is_fracture").collect()] == [i >= 9 for i in range(n)]
    assert mesh.face_adjacency(spark.createDataFrame([], "frag long, fid long, v0 long, v1 long, v2 long")).count() == 0
