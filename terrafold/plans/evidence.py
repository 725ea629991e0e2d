"""Queries over poses, evidence, exports and records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import poses as P
from terrafold.operators import assembly, evidence, exports, graph, progress, ranking, rules
from terrafold.plans import queries as Q
from terrafold.plans.queries import _BEST, _NAME, _ORD, _RIVAL, _SUPPORT, _TIERED, query, rounded
from terrafold.sources.views import CANDIDATES_SQL, FRAGMENTS_SQL, POINTS_SQL, candidates, fragments, points, table


def _pose(angle: str, x: str, y: str):
    """A turn about z by ``angle`` radians and a shift."""
    c, s = F.cos(angle), F.sin(angle)
    return P.pose([[c, -s, 0, F.col(x).cast("double")], [s, c, 0, F.col(y).cast("double")], [0, 0, 1, 0]])


_SECOND = f"r2 AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, {_ORD}) AS r FROM cand WHERE accepted), two AS (SELECT x.a, x.b, x.tight AS p, x.seam AS px, x.gap AS py, y.tight AS q, y.seam AS qx, y.gap AS qy FROM r2 x JOIN r2 y USING (a, b) WHERE x.r = 1 AND y.r = 2)"


@query(
    "pose_gaps",
    f"""WITH {CANDIDATES_SQL}, {_SECOND}, g AS (SELECT a, b, degrees(abs(p - q)) AS deg, sqrt((px-qx)*(px-qx) + (py-qy)*(py-qy)) AS origin, px-qx AS dx, py-qy AS dy, p, q FROM two)
    SELECT a, b, round(deg, 4) AS trace_deg, round(deg, 4) AS frobenius_deg, round(origin, 6) AS origin_gap, round(cos(q)*dx + sin(q)*dy, 6) AS back_x, round(-sin(q)*dx + cos(q)*dy, 6) AS back_y, deg <= 10 AND origin / 2 <= 5 AS agrees FROM g""",
)
def pose_gaps(spark, sf_dir):
    """Each pair's best and second accepted placements: angles, distance, and the way back from the one to the other."""
    k = ranking.keep_best(candidates(spark, sf_dir).where("accepted"), 2).withColumn("pose", _pose("tight", "seam", "gap"))
    of = lambda r, c: k.where(F.col("rank") == r).select("a", "b", F.col("pose").alias(c))
    j = of(0, "p").join(of(1, "q"), ["a", "b"])
    zero = [F.lit(0.0)] * 3
    back = P.compose(P.inverse("q"), "p")
    out = j.select("a", "b", F.round(P.trace_deg("p", "q"), 4).alias("trace_deg"), F.round(P.frobenius_deg("p", "q"), 4).alias("frobenius_deg"), P.gap_at("p", "q", zero).alias("origin_gap"), F.element_at(back, 4).alias("back_x"), F.element_at(back, 8).alias("back_y"), P.agrees("p", "q", zero, F.lit(2.0), 10.0, 5.0).alias("agrees"))
    return rounded(out, "origin_gap", "back_x", "back_y")


@query(
    "rigid_poses",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_tax > 0 THEN 'the rotation is not orthonormal' WHEN l_returnflag = 'R' THEN 'the rotation is a reflection' END AS fault FROM lineitem",
)
def rigid_poses(spark, sf_dir):
    c, s = F.cos("l_discount"), F.sin("l_discount")
    stretch = F.when(F.col("l_linestatus") == "O", 1 + F.col("l_tax")).otherwise(1.0)
    up = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    p = P.pose([[c * stretch, -s, 0, F.col("l_quantity")], [s * stretch, c, 0, 0], [0, 0, up, 0]])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.rigid_fault(p).alias("fault"))


@query(
    "cone_rays",
    f"""WITH {POINTS_SQL}, u AS (SELECT vid, nx, ny, nz, unnest(range(7)) AS ray FROM pts)
    SELECT vid, ray::INTEGER AS ray, round(CASE WHEN ray = 0 THEN 1 ELSE cos(radians(15)) END, 6) AS along FROM u""",
)
def cone_rays(spark, sf_dir):
    """Seven directions of each point's normal, and how much of each goes along it."""
    from terrafold.functions.columns import cross, dot, unit

    p = points(spark, sf_dir)
    axis = [F.when(F.abs("nx") < 0.9, 1.0).otherwise(0.0), F.when(F.abs("nx") < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    rays = p.select("vid", "nx", "ny", "nz", F.posexplode(P.cone_rays(["nx", "ny", "nz"], unit(cross(["nx", "ny", "nz"], axis)))).alias("ray", "d"))
    return rounded(rays.select("vid", "ray", dot([F.col("d")[0], F.col("d")[1], F.col("d")[2]], ["nx", "ny", "nz"]).alias("along")), "along")


@query(
    "nearest_fracture",
    f"""WITH {POINTS_SQL}, j AS (SELECT a.frag, a.vid, b.vid AS other, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pts a JOIN pts b ON a.frag = b.frag AND NOT a.is_fracture AND b.is_fracture),
    r AS (SELECT *, row_number() OVER (PARTITION BY frag, vid ORDER BY d, other) AS r FROM j) SELECT frag, vid, other, round(d, 6) AS d FROM r WHERE r = 1""",
)
def nearest_fracture(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(evidence.nearest_any(p.where("not is_fracture"), p.where("is_fracture"), "frag", "vid", 0.1), "d")


@query(
    "shell_margin",
    f"""WITH {FRAGMENTS_SQL}, j AS (SELECT a.frag, a.vid, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d FROM pts a JOIN pts b ON a.frag = b.frag AND NOT a.is_fracture AND b.is_fracture GROUP BY 1, 2)
    SELECT j.frag, vid, round(d, 6) AS d FROM j JOIN frags USING (frag) WHERE d > 0.12 * t AND d < 1.5 * t""",
)
def shell_margin(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(evidence.shell_margin(evidence.nearest_any(p.where("not is_fracture"), p.where("is_fracture"), "frag", "vid", 0.1), fragments(p)), "d")


@query(
    "penetration_sides",
    f"""WITH {CANDIDATES_SQL}, s AS (SELECT a, b, o4 = a AS side, avg(CASE WHEN pen > 0.005 THEN 1.0 ELSE 0.0 END) AS share, avg(tight) AS tight, avg(gap) AS gap, max(CASE WHEN pen > 0.005 THEN pen END) AS depth FROM cand GROUP BY 1, 2, 3)
    SELECT a, b, round(max(share), 6) AS share, round(min(tight), 6) AS tight, round(max(gap), 6) AS gap, round(max(depth), 6) AS depth FROM s GROUP BY 1, 2""",
)
def penetration_sides(spark, sf_dir):
    s = evidence.two_sided(candidates(spark, sf_dir), ["a", "b"], F.col("ord.l_suppkey") == F.col("a"), F.col("pen") > 0.005)
    return rounded(s, "share", "tight", "gap", "depth")


@query("thickness_flags", f"WITH {FRAGMENTS_SQL}, m AS (SELECT median(t) AS med FROM frags) SELECT frag, round(t, 6) AS t, abs(t / med - 1) > 0.02 AS outlier FROM frags, m")
def thickness_flags(spark, sf_dir):
    return rounded(evidence.thickness_flags(fragments(points(spark, sf_dir)), 0.02), "t")


_box = ", ".join(f"{f}({c}) AS {k}_{c}" for k, f in (("lo", "min"), ("hi", "max")) for c in "xyz")


@query("extents", f"WITH {POINTS_SQL}, g AS (SELECT frag, count(*) AS n, {_box} FROM pts GROUP BY 1) SELECT *, round(sqrt((hi_x-lo_x)*(hi_x-lo_x) + (hi_y-lo_y)*(hi_y-lo_y) + (hi_z-lo_z)*(hi_z-lo_z)), 6) AS diagonal FROM g")
def extents(spark, sf_dir):
    return rounded(evidence.extents(points(spark, sf_dir), "frag"), "diagonal")


@query("recentred", f"WITH {POINTS_SQL}, c AS (SELECT frag, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts WHERE vid % 10 = 0 GROUP BY 1) SELECT frag, vid, round(x - coalesce(cx, 0), 6) AS x, round(y - coalesce(cy, 0), 6) AS y, round(z - coalesce(cz, 0), 6) AS z FROM pts LEFT JOIN c USING (frag)")
def recentred(spark, sf_dir):
    return rounded(evidence.recentred(points(spark, sf_dir).select("frag", "vid", "x", "y", "z"), "frag"), "x", "y", "z")


@query(
    "sample_counts",
    f"WITH {FRAGMENTS_SQL} SELECT frag, CAST(least(12000, greatest(5000, floor(150 * (area * 100) / (t * t)))) AS BIGINT) AS n, CAST(round_even(least(12000, greatest(5000, floor(150 * (area * 100) / (t * t)))) * 0.25, 0) AS BIGINT) AS n_reg FROM frags",
)
def sample_counts(spark, sf_dir):
    n = evidence.fracture_samples(F.col("area") * 100, F.col("t"))
    return fragments(points(spark, sf_dir)).select("frag", n.alias("n"), evidence.split_half_even(n, 0.25).alias("n_reg"))


_LIMITS = {"tight": (0.35, 1), "gap": (0.025, -1), "seam": (5.0, 1), "cont": (0.75, 1)}
_short = {k: f"({limit} - {k}) * {sign} / {limit}" for k, (limit, sign) in _LIMITS.items()}


@query(
    "rejection_margins",
    f"""WITH {CANDIDATES_SQL}, m AS (SELECT *, greatest(0, {", ".join(_short.values())}) AS margin FROM cand WHERE NOT accepted)
    SELECT {_ORD}, round(margin, 6) AS margin FROM m""",
)
def rejection_margins(spark, sf_dir):
    """For each false join, how far the test that throws it out most does so."""
    r = evidence.rejection_margins(candidates(spark, sf_dir).where("not accepted"), _LIMITS)
    return rounded(Q._o(r.select("ord", "margin")), "margin")


@query(
    "boundary_distances",
    f"WITH {CANDIDATES_SQL}, f AS (SELECT * FROM cand WHERE NOT accepted) " + " UNION ALL ".join(f"SELECT '{k}' AS test, round(min(CASE WHEN ({limit} - {k}) * {sign} > 0 THEN ({limit} - {k}) * {sign} END), 6) AS nearest FROM f" for k, (limit, sign) in _LIMITS.items()),
)
def boundary_distances(spark, sf_dir):
    return rounded(evidence.boundary_distances(candidates(spark, sf_dir).where("not accepted"), _LIMITS), "nearest")


_ADJ = "adj AS (SELECT DISTINCT least(c_nationkey, c_custkey % 100) AS a, greatest(c_nationkey, c_custkey % 100) AS b FROM customer)"


@query(
    "missed_pairs",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_ADJ}, u AS (SELECT a, b FROM best WHERE score > 5000), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, {_ORD}) AS r FROM cand SEMI JOIN adj USING (a, b))
    SELECT a, b, round(score, 6) AS score, accepted FROM (SELECT * FROM r WHERE r = 1) ANTI JOIN u USING (a, b)""",
)
def missed_pairs(spark, sf_dir):
    c = candidates(spark, sf_dir)
    adj = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return rounded(evidence.missed_pairs(c, adj, ranking.best_per_pair(c).where("score > 5000")), "score")


@query(
    "object_rollup",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_ADJ}, ok AS (SELECT best.a, best.b FROM best JOIN nation x ON best.a = x.n_nationkey JOIN nation y ON best.b = y.n_nationkey JOIN adj USING (a, b) WHERE x.n_regionkey = y.n_regionkey),
    p AS (SELECT a AS n FROM ok UNION SELECT b FROM ok)
    SELECT n_regionkey AS object, count(*) AS fragments, count(p.n) AS correct_fragments, (SELECT count(*) FROM adj JOIN nation x ON adj.a = x.n_nationkey WHERE x.n_regionkey = o.n_regionkey) AS gt_pairs,
      (SELECT count(*) FROM ok JOIN nation x ON ok.a = x.n_nationkey WHERE x.n_regionkey = o.n_regionkey) AS correct_joins FROM nation o LEFT JOIN p ON p.n = o.n_nationkey GROUP BY 1""",
)
def object_rollup(spark, sf_dir):
    v, adj = Q._verdicts(spark, sf_dir)
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("object"))
    return evidence.object_rollup(v, objects, adj)


_KNOWN = ["email", "ship", "urgent", "large"]


@query(
    "feature_sets",
    """SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 4 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 8 ELSE 0 END)::INTEGER AS bits,
    concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'ship' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END, CASE WHEN o_totalprice > 100000 THEN 'large' END) AS names FROM orders""",
)
def feature_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.array(F.when(F.col("o_orderstatus") == "F", "ship"), F.when(F.col("o_orderpriority").like("1%"), "urgent"), F.when(F.col("o_totalprice") > 100000, "large"))
    bits = o.select("o_orderkey", evidence.feature_set(F.array_compact(names), _KNOWN).alias("bits"))
    return bits.withColumn("names", F.array_join(evidence.features_of(F.col("bits"), _KNOWN), ","))


@query(
    "reason_parts",
    f"""WITH {CANDIDATES_SQL}, r AS (SELECT unnest(['tight', 'gap', 'pen', 'seam', 'cont']) AS test, unnest([tight, gap, pen, seam, cont]) AS v, unnest([0.25, 0.05, 0.005, 3.0, 0.8]::DOUBLE[]) AS bound, unnest([true, false, false, true, true]) AS floor FROM cand)
    SELECT test, CASE WHEN floor THEN 'below' ELSE 'above' END AS side, bound, count(*) AS n, round(sum(round(v, 3)), 3) AS total FROM r WHERE NOT CASE WHEN floor THEN v >= bound ELSE v <= bound END GROUP BY 1, 2, 3""",
)
def reason_parts(spark, sf_dir):
    """Sentences read back into test, side, value and limit."""
    p = rules.reason_parts(rules.refusal_reasons(candidates(spark, sf_dir), Q.RULE).select("a", "b", "reasons"))
    return p.groupBy("test", "side", "bound").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(
    "joins_csv",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}, {_TIERED}, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, score DESC, {_ORD}) AS r FROM tiered)
    SELECT a, b, rank AS band_rank, concat_ws(',', chr(34) || 'no ' || chr(34) || chr(34) || a || chr(34) || chr(34) || chr(34), 'f' || b, {_NAME}, CASE WHEN rank = 0 THEN '1' ELSE '0' END, '', format('{{:.3f}}', score), format('{{:.2f}}', seam), format('{{:.3f}}', tight), format('{{:.4f}}', gap), format('{{:.3f}}', cont), format('{{:.4f}}', pen)) AS line FROM r WHERE r = 1 AND rank < 2""",
)
def joins_csv(spark, sf_dir):
    r = ranking.pair_representatives(Q._tiered(spark, sf_dir), rules.tier_rank(F.col("tier")))
    r = r.withColumn("name_a", F.format_string('no "%d"', "a")).withColumn("name_b", F.format_string("f%d", "b")).withColumn("in_assembly", F.col("tier") == "confirmed").withColumn("grp", F.lit(None).cast("long"))
    return exports.join_lines(r).drop("score")


@query("python_numbers", "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(p_retailprice AS VARCHAR) END AS price, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS large FROM part")
def python_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", exports.python_float("p_retailprice").alias("price"), exports.python_bool(F.col("p_size") > 25).alias("large"))


@query("carried_decisions", "SELECT c_custkey, c_nationkey AS a, c_custkey % 40 AS b, c_custkey % 40 IN (SELECT n_nationkey FROM nation) AS kept FROM customer")
def carried_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 40).alias("b"))
    return progress.carried_decisions(d, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("name"))).select("c_custkey", "a", "b", "kept")


@query(
    "replaced_rows",
    f"WITH {CANDIDATES_SQL}, f AS (SELECT * FROM cand WHERE o2 = 1) SELECT a, b, {_ORD} FROM cand ANTI JOIN f USING (a, b) UNION ALL SELECT a, b, {_ORD} FROM f",
)
def replaced_rows(spark, sf_dir):
    """Pairs that have a first line keep only those lines."""
    c = candidates(spark, sf_dir).select("a", "b", "ord")
    return Q._o(progress.replaced(c, c.where("ord.l_linenumber = 1"), ["a", "b"]))


@query(
    "interrupted_runs",
    """SELECT user_id, max(ts) AS last, max(ts) FILTER (event_type = 'view') IS NOT NULL AND (max(ts) FILTER (event_type = 'purchase') IS NULL OR max(ts) FILTER (event_type = 'purchase') < max(ts) FILTER (event_type = 'view')) AS interrupted FROM events GROUP BY 1""",
)
def interrupted_runs(spark, sf_dir):
    return progress.interrupted(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "view", ["purchase"])


@query(
    "must_join_promotion",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}, {_TIERED}, p AS (SELECT a, b, score, rank, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, {_ORD}) AS r FROM tiered WHERE accepted),
    f AS (SELECT DISTINCT least(s_nationkey, s_suppkey) AS a, greatest(s_nationkey, s_suppkey) AS b FROM supplier)
    SELECT f.a, f.b, p.a IS NOT NULL AS satisfied, CASE WHEN p.a IS NOT NULL THEN 'confirmed' END AS tier, CASE WHEN p.a IS NULL THEN 'unsatisfiable: no candidate is accepted' WHEN rank = 0 THEN 'already confirmed at score ' || format('{{:.2f}}', score) ELSE 'promoted from probable to confirmed at score ' || format('{{:.2f}}', score) END AS said
    FROM f LEFT JOIN (SELECT * FROM p WHERE r = 1) p USING (a, b)""",
)
def must_join_promotion(spark, sf_dir):
    best = ranking.best_per_pair(Q._tiered(spark, sf_dir))
    forced = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"))
    return rules.promoted(best, forced)


@query(
    "resolved_constraints",
    """SELECT s_suppkey, a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN b.n_nationkey IS NULL THEN 'no fragment named ' || s_name WHEN a.n_nationkey = b.n_nationkey THEN 'one fragment twice' END AS error
    FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE (SELECT n_name FROM nation WHERE n_nationkey = s_suppkey % 25) END AS s_name FROM supplier) s JOIN nation a ON a.n_nationkey = s_nationkey LEFT JOIN nation b ON b.n_name = s_name""",
)
def resolved_constraints(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    s = table(spark, sf_dir, "supplier").withColumn("k", (F.col("s_suppkey") % 25).cast("int"))
    s = s.join(n.select(F.col("id").alias("s_nationkey"), F.col("name").alias("name_a")), "s_nationkey").join(n.select(F.col("id").cast("int").alias("k"), F.col("name").alias("n2")), "k")
    named = s.select("s_suppkey", "name_a", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.col("n2")).alias("name_b"))
    return rules.resolved(named, n).select("s_suppkey", "a", "b", "error")


@query(
    "groups_by_size",
    """WITH g AS (SELECT c_nationkey AS grp, count(*) AS n_nodes FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey ELSE 1000 + c_custkey END AS c_nationkey FROM customer) GROUP BY 1)
    SELECT grp, n_nodes, row_number() OVER (ORDER BY n_nodes DESC, grp) AS place FROM g""",
)
def groups_by_size(spark, sf_dir):
    """Groups with singletons, by size."""
    c = table(spark, sf_dir, "customer")
    nodes = c.where("c_custkey % 7 > 0").select((F.col("c_custkey") + 1000).alias("node"), F.col("c_nationkey").cast("long").alias("grp"))
    return assembly.groups_by_size(assembly.with_singletons(nodes, c.select((F.col("c_custkey") + 1000).alias("node"))))


@query("placements")
def placements(spark, sf_dir):
    """Where every node of the best joins is placed; no SQL, held against a walk from the best join to the worst in the tests."""
    best = ranking.best_per_pair(candidates(spark, sf_dir)).withColumn("shift", F.col("seam").cast("double"))
    return assembly.placements(graph.written(best))
