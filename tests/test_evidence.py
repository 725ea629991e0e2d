"""Poses, assembly in rounds, exports, records and picks against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import poses as P
from terrafold.functions.columns import fixed
from terrafold.operators import assembly, evidence, exports, progress
from terrafold.sources import mesh, records


def walk(joins, tol):
    """The joins from the best to the worst: one between groups moves the smaller group, one inside is held against the places."""
    at, group = {}, {}
    for a, b, *_ in joins:
        for n in (a, b):
            at.setdefault(n, 0.0)
            group.setdefault(n, {n})
    status = {}
    for a, b, shift, score, order in sorted(joins, key=lambda j: (-j[3], j[4])):
        off = at[a] + shift - at[b]
        if group[a] is group[b]:
            status[a, b, order] = "used" if abs(off) <= tol else "rejected"
            continue
        for n in group[b]:
            at[n] += off
        whole = group[a] | group[b]
        for n in whole:
            group[n] = whole
        status[a, b, order] = "used"
    return status, {n: (min(g), round(at[n] - at[min(g)], 6)) for n, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_place_as_a_walk_does(spark, seed):
    rng = random.Random(seed)
    joins = [(a, b, float(rng.randrange(-9, 10)), float(rng.randrange(6)), i) for i, (a, b) in enumerate(sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60 if seed < 3 else 25)}))]
    df = spark.createDataFrame(joins, "a long, b long, shift double, score double, o long").withColumn("ord", F.struct("o")).drop("o")
    status, places = walk(joins, 2.0)
    got = assembly.assemble(df, 2.0).collect()
    assert {(r["a"], r["b"]): r["status"] for r in got} == {(a, b): s for (a, b, _), s in status.items()}
    assert {r["node"]: (r["grp"], round(r["at"], 6)) for r in assembly.placements(df).collect()} == places
    assert all((r["reason"] is None) == (r["status"] == "used") for r in got)


def test_long_chains_and_no_joins(spark):
    chain = [(i, i + 1, 1.0, float(200 - i), i) for i in range(150)]
    df = spark.createDataFrame(chain, "a long, b long, shift double, score double, o long").withColumn("ord", F.struct("o")).drop("o")
    assert {r["node"]: r["at"] for r in assembly.placements(df).collect()} == {i: float(i) for i in range(151)}
    assert assembly.assemble(df.limit(0), 1.0).count() == 0


def turn(axis, angle):
    x, y, z = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_poses_against_matrices(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(20):
        m = [np.vstack([np.hstack([turn(rng.normal(size=3), rng.uniform(0, 3)), rng.normal(size=(3, 1))]), [0, 0, 0, 1]]) for _ in range(2)]
        x = rng.normal(size=3)
        rows.append((m[0][:3].ravel().tolist(), m[1][:3].ravel().tolist(), *x.tolist()))
        both = m[0] @ m[1]
        c = (np.trace(m[0][:3, :3].T @ m[1][:3, :3]) - 1) / 2
        want.append((both[:3].ravel(), np.linalg.inv(m[0])[:3].ravel(), (m[0] @ [*x, 1])[:3], m[0][:3, :3] @ x, np.degrees(np.arccos(np.clip(c, -1, 1))), np.linalg.norm((m[0] - m[1]) @ [*x, 1])))
    df = spark.createDataFrame(rows, "p array<double>, q array<double>, x double, y double, z double").coalesce(1)
    xyz = ["x", "y", "z"]
    got = df.select(P.compose("p", "q"), P.inverse("p"), F.array(*P.apply("p", xyz)), F.array(*P.rotate("p", xyz)), P.trace_deg("p", "q"), P.gap_at("p", "q", xyz), P.frobenius_deg("p", "q"), P.rigid_fault("p")).collect()
    for r, w in zip(got, want):
        for a, b in zip(r[:6], w):
            assert np.allclose(a, b, atol=1e-6)
        assert r[6] == pytest.approx(w[4], abs=1e-4) and r[7] is None
    bad = spark.createDataFrame([([float("nan")] + [0.0] * 11,), ([None] + [0.0] * 11,), ([2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0],), ([-1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0],)], "p array<double>").coalesce(1)
    assert [r[0].split()[-1] for r in bad.select(P.rigid_fault("p")).collect()] == ["finite", "finite", "orthonormal", "reflection"]


def test_numbers_and_fields(spark):
    values = [0.0, -0.0, 1.0, -3.0, 0.1, 123456.0, 1e15, 1e16, 1.5e16, 123456789012345.6, 2.5, 1e-4, 1.25e-4, 1e-5, -2.5e-7, 0.001, 0.00123, 1e100, -3.25e-300, 12345678.0, 1e7, 9999999.5, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    assert [r[0] for r in df.select(exports.python_float("x")).collect()] == [str(x) for x in values]
    near = [6999.0305, 1300.1205, 0.0005, 0.0015, 0.0004, -0.0007, -0.0001, 0.9995, 2.5, -0.1, 1234567.8915, 0.0625, 2.0005, None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in near], "x double").coalesce(1).select(fixed("x", 3)).collect()] == [None if x is None else f"{x:.3f}" for x in near]
    t = spark.createDataFrame([("a",), ('b"c',), ("d,e",), ("f\ng",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in t.select(exports.csv_field("t")).collect()] == ["a", '"b""c"', '"d,e"', '"f\ng"', ""]
    assert t.select(exports.html_text(F.lit('<a & "b">'))).first()[0] == "&lt;a &amp; &quot;b&quot;&gt;"


def test_reasons_are_read_back(spark):
    from terrafold.operators import rules
    from terrafold.params import Acceptance

    df = spark.createDataFrame([(1, -0.1, float("nan"), 0.5, None, 0.9)], "id long, tight double, gap double, pen double, seam double, cont double")
    got = {r["test"]: r["value"] for r in rules.reason_parts(rules.refusal_reasons(df, Acceptance())).collect()}
    assert got["tight"] == -0.1 and np.isnan(got["gap"]) and got["pen"] == 0.5 and got["seam"] is None and len(got) >= 4


def test_transform_lines_and_files(spark, tmp_path):
    eye = [1.0, 0.0, 0.0, 0.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    n = spark.createDataFrame([(1, "x", "x.ply", 0, eye), (2, "y,z", "y.obj", None, eye)], "node long, name string, source string, grp long, pose array<double>")
    lines = exports.transform_lines(n)
    got = {r["node"]: r["line"] for r in lines.collect()}
    assert got[1] == "x,x.ply,0,1,1.0,0.0,0.0,0.5,0.0,1.0,0.0,0.0,0.0,0.0,1.0,0.0,0.0,0.0,0.0,1.0"
    assert got[2].startswith('"y,z",y.obj,,0,')
    exports.write_lines(lines.coalesce(1), "fragment", ["node"], f"{tmp_path}/t")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(tmp_path.glob("t/part-*")))
    assert text == exports.BOM + "fragment\n" + got[1] + "\n" + got[2] + "\n"


def test_constraints_and_ground_truth(spark, tmp_path):
    eye = np.eye(4).tolist()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text(json.dumps({"version": 1, "must_join": [["p", "q"], {"a": "p", "b": "r", "pose": eye}], "must_not_join": [["q", "r"]]}))
    (tmp_path / "c/b.json").write_text(json.dumps({"version": 7, "must_join": [["p", "q"]]}))
    (tmp_path / "c/c.json").write_text("no json")
    (tmp_path / "c/d.json").write_text(json.dumps({"version": 1, "must_join": [["p"]], "same_object": [["q"], ["p", "q", "r"], []]}))
    (tmp_path / "c/e.json").write_text(json.dumps({"version": 1, "must_joint": [["p", "q"]]}))
    got = records.read_constraints(spark, f"{tmp_path}/c").collect()
    assert sorted((r["list"], r["name_a"], r["name_b"]) for r in got if r["error"] is None) == [("must_join", "p", "q"), ("must_join", "p", "r"), ("must_not_join", "q", "r")]
    assert [r["pose"] for r in got if r["name_b"] == "r" and r["list"] == "must_join"] == [np.eye(4).ravel().tolist()]
    assert sorted(r["error"] for r in got if r["error"]) == [*["a pair has two names"] * 4, "not a constraints file", "unknown field must_joint", "version 7, not 1"]
    (tmp_path / "g.json").write_text(json.dumps({"fragments": {"p": {"matrix": eye}, "q": {"matrix": eye}}, "object_of": {"p": "pot"}, "adjacency": [["q", "p"]]}))
    poses, pairs = records.read_ground_truth(spark, f"{tmp_path}/g.json")
    assert sorted((r["name"], r["object"], len(r["pose"])) for r in poses.collect()) == [("p", "pot", 12), ("q", None, 12)]
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [("p", "q")]


def test_meshes_written_placed_and_merged(spark, tmp_path):
    v = spark.createDataFrame([("m", i, float(i), float(i * i), 0.0) for i in (0, 2, 5)] + [("n", i, 1.0, float(i), 2.0) for i in range(3)], "frag string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 2, 5), ("n", 0, 0, 1, 2)], "frag string, fid long, v0 int, v1 int, v2 int")
    for r in mesh.ply_contents(v, f).collect():
        (tmp_path / f"{r['frag']}.ply").write_bytes(bytes(r["content"]))
    v2, f2 = mesh.read_meshes(spark, str(tmp_path))
    assert sorted(tuple(r) for r in v2.collect()) == [("m", 0, 0.0, 0.0, 0.0), ("m", 1, 2.0, 4.0, 0.0), ("m", 2, 5.0, 25.0, 0.0), ("n", 0, 1.0, 0.0, 2.0), ("n", 1, 1.0, 1.0, 2.0), ("n", 2, 1.0, 2.0, 2.0)]
    assert sorted(tuple(r) for r in f2.collect()) == [("m", 0, 0, 1, 2), ("n", 0, 0, 1, 2)]
    assert sorted(r["file"] for r in records.input_snapshot(spark, str(tmp_path)).collect()) == ["m.ply", "n.ply"]
    pose = spark.createDataFrame([("m", [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "frag string, pose array<double>")
    assert sorted(r["x"] for r in mesh.placed_meshes(v, pose).collect()) == [1.0, 3.0, 6.0]
    gv, gf = mesh.merged_meshes(v2, f2, spark.createDataFrame([("m", 7), ("n", 7)], "frag string, grp long"))
    assert sorted(r["vid"] for r in gv.collect()) == list(range(6)) and sorted((r["v0"], r["v1"], r["v2"]) for r in gf.collect()) == [(0, 1, 2), (3, 4, 5)]


def test_picks_and_neighbours_against_loops(spark):
    rng = random.Random(5)
    items = [(i * 37, rng.randrange(0, 9)) for i in range(200)]
    total = sum(w for _, w in items)
    draws = [(d, rng.randrange(total)) for d in range(300)]
    got = progress.weighted_picks(spark.createDataFrame(items, "item long, w long"), "item", "w", spark.createDataFrame(draws, "draw long, at long"), per_band=100).collect()
    tape = [i for i, w in items for _ in range(w)]
    assert {r["draw"]: r["item"] for r in got} == {d: tape[at] for d, at in draws} and len(got) == len(draws)
    pts = [(1, i, rng.uniform(0, 50), rng.uniform(0, 1), 0.0) for i in range(40)]
    df = spark.createDataFrame(pts, "frag long, vid long, x double, y double, z double")
    near = evidence.nearest_any(df.where("vid % 2 = 0"), df.where("vid % 2 = 1"), "frag", "vid", 0.2).collect()
    want = {p[1]: min((np.hypot(p[2] - q[2], p[3] - q[3]), q[1]) for q in pts if q[1] % 2)[1] for p in pts if p[1] % 2 == 0}
    assert {r["vid"]: r["other"] for r in near} == want
