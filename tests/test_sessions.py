"""Objects and their demotions, what the operator's lists contradict, pinned and refined poses, stored matches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import assembly, objects, sessions
from terrafold.sources import state


def turned(deg, x=0.0):
    a = np.radians(deg)
    return [float(v) for v in (np.cos(a), -np.sin(a), 0, x, np.sin(a), np.cos(a), 0, 0, 0, 0, 1, 0)]


def plain_rejects(groups, value, k, least, floor):
    out = set()
    for g, members in groups.items():
        for x in members if len(members) > least else ():
            others = [value[y] for y in members if y != x and value[y] is not None]
            if value[x] is None or len(others) < least:
                continue
            med = np.median(others)
            spread = max(np.median(np.abs(np.array(others) - med)), floor)
            if spread > 0 and abs(value[x] - med) / spread > k:
                out.add((g, x))
    return out


def test_rejects_against_a_loop(spark):
    rng = np.random.default_rng(3)
    groups = {g: list(range(g * 20, g * 20 + n)) for g, n in enumerate([1, 3, 4, 9, 20])}
    value = {x: None if rng.random() < 0.1 else float(rng.choice([1, 1, 1.1, 0.9, 5])) for m in groups.values() for x in m}
    flat = {x: 2.0 for x in value} | {85: 9.0}
    nodes = spark.createDataFrame([(x, g) for g, m in groups.items() for x in m], "node long, grp long")
    features = spark.createDataFrame([(x, value[x], flat[x]) for x in value], "node long, t double, flat double")
    got = {}
    for r in objects.rejects(nodes, features, ["t", "flat"], floors={"t": 0.2}).collect():
        got.setdefault(r["feature"], set()).add((r["grp"], r["node"]))
    assert got == {"t": plain_rejects(groups, value, 3.0, 3, 0.2)} and got["t"]  # others without spread reject nobody
    assert objects.rejects(nodes.limit(0), features, ["t"]).count() == 0


def test_objects_count_joins_and_rims(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)], "node long, grp long")
    used = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (6, 6)], "a long, b long")
    features = spark.createDataFrame([(1, True, 10.0), (2, False, 12.0), (3, None, float("nan")), (4, False, 7.0)], "node long, rim boolean, rim_diameter double")
    got = {r["grp"]: (r["n_members"], r["n_joins"], r["rim_diameter"]) for r in objects.objects(nodes, used, features).collect()}
    assert got == {1: (3, 2, 11.0), 4: (2, 1, None), 6: (1, 0, None)}


def test_a_round_takes_the_stranger_out(spark):
    # 1 to 6 in a chain; 6 is of another wall, 5 too but the operator knows that it belongs to 4
    rows = [(i, i + 1, 1.0, float(100 - i), (i,)) for i in range(1, 6)] + [(7, 8, 1.0, 5.0, (9,))]
    joins = spark.createDataFrame(rows, "a long, b long, shift double, score double, ord struct<i:int>")
    wall = {1: 1.0, 2: 1.01, 3: 0.99, 4: 1.02, 5: 3.0, 6: 3.0, 7: 1.0, 8: 9.0}
    features = spark.createDataFrame(list(wall.items()), "node long, t double")
    same = spark.createDataFrame([(5, 4)], "a long, b long")
    first, demoted, last = objects.object_round(joins, lambda j: assembly.assemble(j, 0.1), features, ["t"], same, floors={"t": 0.05})
    pairs = {(r["a"], r["b"]): r["reason"] for r in demoted.collect()}
    assert set(pairs) == {(5, 6)} and pairs[5, 6].startswith("5 is ") and "MAD from object 1's t (3.0000 against 1.0" in pairs[5, 6]
    assert first.where("status = 'used'").count() == 6 and {(r["a"], r["b"]) for r in last.where("status = 'used'").collect()} == {(1, 2), (2, 3), (3, 4), (4, 5), (7, 8)}
    alone = objects.object_round(joins.where("a = 7"), lambda j: assembly.assemble(j, 0.1), features, ["t"], same)
    assert alone[1].count() == 0 and alone[2].count() == 1


def test_what_the_lists_contradict(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, grp long")
    rows = [("same_object", 2, 1), ("same_object", 1, 3), ("same_object", 3, 1), ("same_object", 8, 9), ("same_object", 1, 9), ("different_object", 2, 1), ("different_object", 1, 3), ("different_object", 8, 9), ("must_join", 1, 3)]
    got = sorted(tuple(r) for r in objects.operator_view(nodes, spark.createDataFrame(rows, "list string, a long, b long")).collect())
    assert got == [("split", 1, 3), ("split", 1, 9), ("together", 1, 2)]


def test_pinned_poses(spark):
    rows = [(1, 2, turned(0), False, 5.0, (1,)), (1, 2, turned(0), False, 6.0, (0,)), (1, 2, turned(9), True, 9.0, (2,)), (3, 4, turned(3), True, 1.0, (3,)), (5, 6, turned(4), False, 2.0, (4,))]
    cand = spark.createDataFrame(rows, "a long, b long, pose array<double>, accepted boolean, score double, ord struct<i:int>")
    forced = spark.createDataFrame([(1, 2, turned(0)), (4, 3, turned(3)), (5, 6, None), (7, 8, turned(1))], "a long, b long, pose array<double>")
    got = {(r["a"], r["b"]): (r["accepted"], r["score"], r["pinned"]) for r in sessions.pinned(cand, forced).collect()}
    # 4-3 is given the other way round, so no candidate has measured that pose
    assert got == {(1, 2): (True, 6.0, True), (4, 3): (True, None, True), (5, 6): (False, 2.0, False), (7, 8): (True, None, True)}


def test_refined_groups_keep_their_poses(spark):
    pose = lambda n, k: [float(100 * k + n)] * 12
    old = {1: [1, 2, 3], 4: [4, 5], 6: [6, 7], 8: [8], 9: [9, 10], 11: [11, 12, 13]}
    new = {1: [1, 2, 3], 4: [4, 5, 6], 7: [7], 8: [8], 9: [9, 10], 11: [11, 12, 13]}
    table = lambda groups, k: [(n, g, pose(n, k)) for g, m in groups.items() for n in m]
    base = spark.createDataFrame([(*r, r[1] != 9) for r in table(old, 1)], "node long, grp long, pose array<double>, refined boolean")
    fresh = spark.createDataFrame(table(new, 2), "node long, grp long, pose array<double>")
    j1 = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7), (9, 10), (11, 12), (12, 13)], "a long, b long")
    j2 = spark.createDataFrame([(2, 1), (3, 2), (2, 3), (4, 5), (5, 6), (9, 10), (11, 12), (11, 13)], "a long, b long")
    got = {r["node"]: (r["pose"][0], r["refined"]) for r in sessions.merge_refined(base, j1, fresh, j2).collect()}
    # 4 has another member, 8 is alone, 9 was not refined, 11 is held by another join
    assert got == {n: (100.0 + n, True) if n <= 3 else (200.0 + n, False) for n in range(1, 14)}


def match(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    cand = spark.createDataFrame([(1, 0, 1, turned(5)), (2, 1, 2, None)], "cid long, a long, b long, pose array<double>")
    return {"names": names, "candidates": cand, "evidence": cand.select("cid", F.lit(1.0).alias("margin"))}


def test_a_stored_match_comes_back(spark, tmp_path):
    tables, path = match(spark), str(tmp_path / "state")
    state.save_state(path, {k: tables[k] for k in ("names", "candidates")}, {"seed": "1"})
    state.save_state(path, tables, {"seed": "2"})
    got, settings = state.load_state(spark, path, tables["names"])
    assert settings == {"seed": "2"} and all(sorted(map(str, got[k].collect())) == sorted(map(str, tables[k].collect())) for k in tables)
    with pytest.raises(ValueError, match="other fragments"):
        state.load_state(spark, path, tables["names"].where("id < 2"))
    with pytest.raises(ValueError, match="no candidates"):
        state.save_state(path, {"names": tables["names"]})


def test_a_damaged_match_is_refused(spark, tmp_path):
    t = match(spark)
    bad = spark.createDataFrame([(1, 0, 1, turned(5)), (1, 0, 7, [1.0] * 12), (3, 2, 2, [1.0]), (4, None, 1, None)], "cid long, a long, b long, pose array<double>")
    faults = {(r["fault"], r["row"]) for r in state.state_faults({**t, "candidates": bad}).collect()}
    assert faults == {
        ("a candidate stands twice", "1"), ("a candidate of an unknown fragment", "1"), ("a candidate of an unknown fragment", "4"), ("a candidate of one fragment", "3"),
        ("a pose is no motion: the rotation is not orthonormal", "1"), ("a pose is no motion: not twelve numbers", "3"),
        ("evidence of no candidate", "2"), ("a candidate without evidence", "3"), ("a candidate without evidence", "4"),
    }
    path = str(tmp_path / "state")
    state.save_state(path, {**t, "candidates": bad})
    with pytest.raises(ValueError, match="stands twice|unknown|no motion"):
        state.load_state(spark, path)
    with pytest.raises(ValueError, match="not a stored match"):
        state.load_state(spark, str(tmp_path / "none"))
    later = str(tmp_path / "later")
    spark.createDataFrame([(state.FORMAT, 9, "x", None, ["names"], {})], state._HEAD).write.parquet(f"{later}/heads")
    with pytest.raises(ValueError, match="version 9"):
        state.load_state(spark, later)
