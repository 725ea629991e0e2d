"""Operators against plain loops on small inputs."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.operators import aggregates, assembly, evaluation, fits, graph, mesh, progress, ranking, rules, spatial
from terrafold.params import Acceptance, TierRule
from terrafold.plans.queries import QUERIES
from terrafold.plans.reassembly import classified_joins
from terrafold.sources.mesh import find_meshes, read_meshes, write_obj
from terrafold.sources.views import candidates
from terrafold.streaming import progress as stream

from .conftest import SF


def test_pair_scales_of_a_known_pair(spark):
    """Wall 30.128 and resolution 2.278: each scale is the larger of its two multiples."""
    r = spark.range(1).select(*[c.alias(k) for k, c in C.pair_scales(F.lit(30.127979278564453), F.lit(2.2784501327205304)).items()]).first()
    want = {"coarse": 5.240435, "stage1": 2.050605, "tight": 0.341768, "facing": 9.038394, "gap": 1.025303, "seam": 4.101210, "near": 15.063990, "pen": 2.050605, "icp": 1.367070, "nms": 15.063990}
    for k in ("coarse", "stage1", "tight", "facing", "gap", "seam", "near", "pen", "nms"):
        assert r[k] == pytest.approx(want[k], abs=1e-5)


def test_refusals_treat_unknown_values_as_failures(spark):
    rows = [(0.5, 0.01, 9.0, 0.0, 0.9), (None, 0.01, 9.0, 0.0, 0.9), (float("nan"), 0.5, 1.0, 0.0, 0.9), (0.5, 0.01, 9.0, 0.01, None)]
    df = spark.createDataFrame(rows, "tight double, gap double, seam double, pen double, cont double").coalesce(1)
    got = [r["reasons"] for r in rules.refusal_reasons(df, Acceptance()).collect()]
    assert [len(x) for x in got] == [0, 1, 3, 2]
    assert got[3] == ["pen 0.010 above 0.005", "cont unknown below 0.8"]


def test_a_margin_needs_a_second_placement_far_away_and_refused(spark):
    rows = [(0, None, None, None), (1, None, None, None), (0, 3.0, 9.0, False), (0, 3.0, 1.0, False), (0, 3.0, 9.0, True), (0, 1.0, 9.0, False)]
    df = spark.createDataFrame(rows, "support long, margin double, moved double, rival_accepted boolean").coalesce(1)
    df = df.select("*", *[F.lit(v).alias(k) for k, v in {"tight": 0.5, "gap": 0.01, "seam": 9.0, "cont": 0.95, "pen": 0.0, "slide": 0.1, "accepted": True}.items()])
    tiers = lambda rule: [r["tier"] == "confirmed" for r in rules.classify(df, rule).collect()]
    assert tiers(TierRule()) == [False, True, True, True, True, False]
    assert tiers(TierRule(min_moved=2.0, rival_refused=True)) == [False, True, True, False, False, False]
    assert rules.classify(df.withColumn("slide", F.lit(None).cast("double")), TierRule()).first()["failed"] == ["slide", "independent"]


def test_leave_one_out(spark):
    rng = random.Random(1)
    rows = [(g, i, float(rng.randint(0, 9))) for g in range(6) for i in range(g + 1)]
    got = {(r["g"], r["i"]): r for r in aggregates.leave_one_out_deviation(spark.createDataFrame(rows, "g long, i long, v double"), "g", "i", "v", 3.0, 1.0, 2).collect()}
    for g, i, v in rows:
        others = [x for h, j, x in rows if h == g and j != i]
        if len(others) < 2:
            assert (g, i) not in got
            continue
        med = statistics.median(others)
        mad = statistics.median(abs(x - med) for x in others)
        assert (got[g, i]["med"], got[g, i]["mad"]) == (med, mad)
        assert got[g, i]["times"] == pytest.approx(abs(v - med) / max(mad, 1.0))


def test_ball_join_is_strict_and_complete(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame(rng.uniform(-1, 1, (80, 3)), columns=list("xyz")).assign(vid=range(80), frag=0)
    p = pd.concat([p, pd.DataFrame({"x": [0.0, 0.25], "y": [0.0, 0.0], "z": [0.0, 0.0], "vid": [80, 81], "frag": 0})])
    df = spark.createDataFrame(p)
    got = {(r[0], r[1]) for r in spatial.ball_join(df, df, 0.25).select("l.vid", "r.vid").collect()}
    x = p[list("xyz")].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert got == {(i, j) for i in range(82) for j in range(82) if d[i, j] < 0.25}
    assert (80, 81) not in got


def test_components_and_support(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (8, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert {(r["a"], r["b"]): r["support"] for r in graph.support_counts(e).collect()} == {(1, 2): 1, (2, 3): 1, (1, 3): 1, (3, 4): 0, (8, 9): 0}
    assert graph.connected_components(e.limit(0)).count() == 0


def joins(spark, rows):
    return spark.createDataFrame([(a, b, float(s), float(w), (i,)) for i, (a, b, s, w) in enumerate(rows)], "a long, b long, shift double, score double, ord struct<i:long>")


def test_assembly_cases(spark):
    chain = assembly.assemble(joins(spark, [(0, 1, 10, 3), (1, 2, 10, 2), (2, 3, 10, 1)]), 0.5).collect()
    assert {r["status"] for r in chain} == {"used"} and {r["grp"] for r in chain} == {0}
    at = {r["a"]: r["at_a"] for r in chain} | {r["b"]: r["at_b"] for r in chain}
    assert [at[i] - at[0] for i in range(4)] == [0, 10, 20, 30]
    loop = {(r["a"], r["b"]): r for r in assembly.assemble(joins(spark, [(0, 1, 10, 3), (1, 2, 10, 2), (0, 2, 25, 1), (5, 6, 1, 1)]), 0.5).collect()}
    assert loop[0, 2]["status"] == "rejected" and loop[0, 2]["reason"] == "disagrees by 5.000"
    assert loop[5, 6]["grp"] == 5


def test_suppression(spark):
    rng = random.Random(3)
    rows = [(p, p + 10, rng.uniform(0, 50), float(rng.randint(0, 40)), (i,)) for i, p in enumerate(rng.choices(range(4), k=120))]
    df = spark.createDataFrame(rows, "a long, b long, seam double, score double, ord struct<i:long>")
    got = sorted((r["a"], r["rank"], r["seam"]) for r in assembly.suppress_near(df, 6.0, 10.0, 4).collect())
    want = []
    for p in range(4):
        kept = []
        for _, _, seam, score, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[4])):
            if score >= 10 and len(kept) < 4 and all(abs(seam - k) >= 6 for k in kept):
                kept.append(seam)
        want += [(p, i, s) for i, s in enumerate(kept)]
    assert got == sorted(want)


def test_fits(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(200, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    s = spark.createDataFrame(pd.DataFrame(d * 3 + [1, 2, 3], columns=list("xyz")).assign(k=1))
    r = fits.sphere_fit(s, "k").first()
    assert (r["cx"], r["cy"], r["cz"], r["radius"]) == pytest.approx((1, 2, 3, 3))
    line = pd.DataFrame(rng.normal(size=(300, 1)) * [[0.1, 4.0, 0.2]] + rng.normal(size=(300, 3)) * 0.01, columns=list("xyz")).assign(k=1)
    a = fits.principal_axes(spark.createDataFrame(line), "k").first()
    assert abs(a["ay"]) > 0.99 and a["l0"] > a["l1"] >= a["l2"]
    p = rng.normal(size=(40, 3))
    t = math.radians(30)
    rot = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    m = pd.DataFrame(np.hstack([p, p @ rot.T + [1, 2, 3]]), columns=["px", "py", "pz", "qx", "qy", "qz"]).assign(k=1)
    f = fits.rigid_fit(spark.createDataFrame(m), "k").first()
    assert [f[f"r{i}{j}"] for i in range(3) for j in range(3)] == pytest.approx(rot.ravel(), abs=1e-9) and f["rmse"] < 1e-6


def test_icp_brings_points_back(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame(rng.uniform(-1, 1, (150, 3)), columns=list("xyz")).assign(frag=1, vid=range(150))
    t = math.radians(2)
    q = p.assign(x=math.cos(t) * p.x - math.sin(t) * p.y + 0.01, y=math.sin(t) * p.x + math.cos(t) * p.y)
    f = fits.icp(spark.createDataFrame(q), spark.createDataFrame(p), 0.2, 4).first()
    assert f["rmse"] < 1e-3 and math.degrees(math.acos(min(1, (f["r00"] + f["r11"] + f["r22"] - 1) / 2))) == pytest.approx(2, abs=0.1)


def test_auc_and_threshold_search(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 9)), rng.random() < 0.5) for _ in range(80)]
    df = spark.createDataFrame(rows, "s double, p boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / len(pos) / len(neg)
    assert evaluation.auc(df, "s", F.col("p")).first()["auc"] == pytest.approx(want)


def test_trailing_rate(spark):
    rng = random.Random(4)
    rows = [("k", t) for t in sorted(rng.sample(range(5000), 60))]
    df = spark.createDataFrame(rows, "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = progress.trailing_rate(df, "k", "ts", 300, F.floor(F.col("ts").cast("long") / 400), extra=["t"]).collect()
    assert {r["t"]: r["n_recent"] for r in got} == {t: sum(t - 300 <= u <= t for _, u in rows) for _, t in rows}


TETRA = ["0 0 0", "1 0 0", "0 1 0", "0 0 1"]
FACES = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]


def mesh_folder(tmp_path):
    (tmp_path / "a.off").write_text("OFF # comment\n\n4 4 0\n" + "\n".join(TETRA) + "\n" + "\n".join(f"3 {a} {b} {c}" for a, b, c in FACES))
    (tmp_path / "b.OBJ").write_text("mtllib no\n" + "\n".join(f"v {v} 1 0 0" for v in TETRA) + "\n" + "\n".join(f"f {a + 1}/1/1 {b - 4} {c + 1}" for a, b, c in FACES))
    head = "ply\r\nformat ascii 1.0\r\ncomment x\r\nelement vertex 5\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nproperty uchar red\r\nelement face 1\r\nproperty list uchar int vertex_index\r\nend_header\r\n"
    (tmp_path / "c.ply").write_bytes((head + "0 0 0 1\r\n1 0 0 1\r\n1 1 0 1\r\n.5 2 0 1\r\n0 1 0 1\r\n5 0 1 2 3 4\r\n").encode())
    v = np.array([[float(x) for x in t.split()] for t in TETRA], "<f4")
    body = b"".join(b"\x03" + np.array(f, "<i4").tobytes() for f in FACES)
    (tmp_path / "d.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 4\nproperty list uchar int vertex_indices\nend_header\n" + v.tobytes() + body)
    facets = "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {TETRA[i]}\n" for i in f) + "endloop\nendfacet\n" for f in FACES)
    (tmp_path / "d.stl").write_text(f"solid t\n{facets}endsolid t\n")
    (tmp_path / "notes.txt").write_text("no mesh")
    return str(tmp_path)


def test_mesh_files(spark, tmp_path):
    folder = mesh_folder(tmp_path)
    names = {r["name"] for r in find_meshes(spark, folder).collect()}
    assert names == {"a", "b", "c", "d_ply", "d_stl"}
    v, f = read_meshes(spark, folder)
    nv, nf = ({r["frag"]: r["count"] for r in x.groupBy("frag").count().collect()} for x in (v, f))
    assert nv == {"a": 4, "b": 4, "c": 5, "d_ply": 4, "d_stl": 12} and nf == {"a": 4, "b": 4, "c": 3, "d_ply": 4, "d_stl": 4}
    cv, cf = mesh.clean(v, f)
    assert {r["frag"]: r["count"] for r in cv.groupBy("frag").count().collect()} == {**nv, "d_stl": 4}
    area = {r["frag"]: r["s"] for r in mesh.face_geometry(cv, cf).groupBy("frag").agg(F.sum("area").alias("s")).collect()}
    for k in ("a", "b", "d_ply", "d_stl"):
        assert area[k] == pytest.approx(1.5 + math.sqrt(3) / 2)
    top = {r["frag"]: r for r in mesh.topology(cv, cf).collect()}
    assert top["d_stl"]["watertight"] and top["d_stl"]["n_edges"] == 6 and top["c"]["n_boundary"] == 5
    assert mesh.face_components(cf).select("component").distinct().count() == 1
    out = str(tmp_path) + "-out"
    write_obj(cv.where("frag = 'a'"), cf.where("frag = 'a'"), out)
    assert sum(r["value"].startswith("v ") for r in spark.read.text(out).collect()) == 4


def test_mesh_smoothing_sampling_and_components(spark, tmp_path):
    v, f = read_meshes(spark, mesh_folder(tmp_path))
    v, f = v.where("frag = 'a'"), f.where("frag = 'a'")
    far_v = v.select("frag", (F.col("vid") + 10).alias("vid"), (F.col("x") + 9).alias("x"), "y", "z")
    far_f = f.where("fid < 2").select("frag", (F.col("fid") + 10).alias("fid"), *[(F.col(c) + 10).alias(c) for c in ("v0", "v1", "v2")])
    both_v, both_f = v.unionByName(far_v), f.unionByName(far_f)
    assert {r["fid"]: r["component"] for r in mesh.face_components(both_f).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10}
    assert mesh.largest_component(both_f).count() == 4
    s = mesh.sample_on_faces(v, f, 400.0).toPandas()
    assert abs(len(s) - 400 * (1.5 + math.sqrt(3) / 2)) <= 4
    assert ((s.x >= -1e-9) & (s.y >= -1e-9) & (s.z >= -1e-9) & (s.x + s.y + s.z <= 1 + 1e-9)).all()
    smooth = mesh.taubin(v, f, rounds=1).toPandas()
    assert len(smooth) == 4 and not np.allclose(sorted(smooth.x), [0, 0, 0, 1])
    cv, cf = mesh.cluster_decimation(v, f, 10.0)
    assert cv.count() == 1 and cf.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i * 600, f"t{i % 2}", i % 5, float(i)) for i in range(100)], "event_id long, s long, event_type string, user_id long, value double").withColumn("ts", F.timestamp_seconds("s"))
    e.repartition(5).write.parquet(f"{tmp_path}/e")
    q = stream.windowed_rates(stream.event_stream(spark, f"{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM rates").collect()))
    want = sorted(map(tuple, e.groupBy(F.window("ts", "6 hours").start.alias("start"), "event_type").count().collect()))
    assert got == want


def test_support_counts_every_partner_that_agrees(spark):
    """Against a loop over all third nodes; most nodes have far more than two partners."""
    rng = random.Random(4)
    seam = {(a, b): rng.randint(5, 20) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.8}
    rows = [(a, b, 1000.0 + i, True, float(s), 0.5, 0.01, 0.0, 0.95, 0.1, (i,)) for i, ((a, b), s) in enumerate(seam.items())]
    cand = spark.createDataFrame(rows, "a long, b long, score double, accepted boolean, seam double, tight double, gap double, pen double, cont double, slide double, ord struct<i: long>")
    leg = lambda p, q: seam.get((p, q), -seam[q, p] if (q, p) in seam else None)
    want = {(a, b): sum(x not in (a, b) and None not in (leg(a, x), leg(x, b)) and abs(leg(a, x) + leg(x, b) - s) <= 4 for x in range(12)) for (a, b), s in seam.items()}
    got = classified_joins(cand, TierRule(), 4.0).collect()
    assert {(r["a"], r["b"]): r["support"] for r in got} == want and len(set(want.values())) > 2
    assert all((r["tier"] == "confirmed") == (want[r["a"], r["b"]] > 0) for r in got)


def test_assembly_walks_every_pair(spark):
    pairs = candidates(spark, SF).where("accepted").select("a", "b").distinct().count()
    assert QUERIES["greedy_assembly"](spark, SF).count() == pairs


def test_support_counts_in_many_small_blocks(spark):
    """Bands of a few edges each, turned edges, a hub: as a loop over third nodes; rows that meet grow with the bands, not with their square."""
    rng = random.Random(7)
    way = {(a, b) if rng.random() < 0.5 else (b, a): rng.choice([float(rng.randint(-6, 6)), rng.uniform(-4, 4)]) for a in range(40) for b in range(a + 1, 40) if a == 0 or rng.random() < 0.2}
    leg = lambda p, q: way.get((p, q), -way[q, p] if (q, p) in way else None)
    e = spark.createDataFrame([(a, b, s) for (a, b), s in way.items()] + [(100, 101, None)], "a long, b long, shift double")
    for tol in (None, 3.0):
        agree = lambda a, x, b: None not in (leg(a, x), leg(x, b)) and (tol is None or abs(leg(a, x) + leg(x, b) - leg(a, b)) <= tol)  # noqa: E731,B023
        want = {(a, b): sum(x not in (a, b) and agree(a, x, b) for x in range(40)) for a, b in way} | {(100, 101): 0}
        got = {(r["a"], r["b"]): r["support"] for r in graph.support_counts(e, tol, most=16).collect()}
        assert got == want and sum(want.values()) > 50


def test_margins_are_those_of_rival_margin(spark):
    cand = candidates(spark, SF)
    best = ranking.best_per_pair(cand)
    want = {(r["a"], r["b"]): r["margin"] for r in ranking.rival_margin(cand, 5.0).collect() if r["margin"] is not None}
    assert {(r["a"], r["b"]): r["margin"] for r in ranking.margins(cand, best, 5.0).collect()} == want and want


def test_trailing_rate_grows_with_the_events_and_keeps_those_without_a_time(spark):
    """Only frames that grow, which are counted once for each event; repeated and missing times as a loop counts them."""
    rng = random.Random(3)
    at = [rng.randrange(2000) for _ in range(300)] + [None] * 3
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(at)], "k string, i int, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = progress.trailing_rate(df, "k", "ts", 300, F.floor(F.col("t") / 400), extra=["i"])
    frames = out._jdf.queryExecution().optimizedPlan().toString().split("specifiedwindowframe(")[1:]
    assert len(frames) >= 2 and all(f.startswith("RangeFrame, unboundedpreceding$()") for f in frames)
    want = {i: sum(u is None for u in at) if t is None else sum(u is not None and t - 300 <= u <= t for u in at) for i, t in enumerate(at)}
    assert {r["i"]: r["n_recent"] for r in out.collect()} == want


def test_coarse_nn_agree_sends_no_points_on(spark):
    """What stands for a pair of a point and a fragment is a distance, a number and an agreement, not both points."""
    plan = QUERIES["coarse_nn_agree"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(l" not in plan and "min_by(r" not in plan
