"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.operators import aggregates, assembly, evaluation, fits, graph, pairs, progress, ranking, rules, spatial
from terrafold.params import Acceptance, TierRule
from terrafold.plans.reassembly import classified_joins, reassembly, with_evidence
from terrafold.sources.views import CANDIDATES_SQL, FRAGMENTS_SQL, POINTS_SQL, candidates, fragments, points, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df, *cols: str, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


RATIO = 1.03


@query(
    "pairs_wall_ratio",
    f"WITH {FRAGMENTS_SQL} SELECT a.frag AS a, b.frag AS b, round(a.t / b.t, 6) AS ratio FROM frags a JOIN frags b ON a.frag < b.frag WHERE a.t / b.t >= 1 / {RATIO} AND a.t / b.t <= {RATIO}",
)
def pairs_wall_ratio(spark, sf_dir):
    return rounded(pairs.wall_ratio_pairs(fragments(points(spark, sf_dir)), RATIO).select("a", "b", "ratio"), "ratio")


_scale_sql = ", ".join(f"round(greatest({m} * least(a.t, b.t), {r} * greatest(a.res, b.res)), 6) AS {k}" for k, (m, r) in C.SCALE_FACTORS.items())


@query("pair_scales", f"WITH {FRAGMENTS_SQL} SELECT a.frag AS a, b.frag AS b, {_scale_sql} FROM frags a JOIN frags b ON a.frag < b.frag WHERE a.t / b.t >= 1 / {RATIO} AND a.t / b.t <= {RATIO}")
def pair_scales(spark, sf_dir):
    f = fragments(points(spark, sf_dir))
    return rounded(pairs.scales_of_pairs(pairs.wall_ratio_pairs(f, RATIO), f), *C.SCALE_FACTORS)


_dih = "degrees(acos(greatest(-1, least(1, nx*fx + ny*fy + nz*fz))))"


@query(
    "hypotheses_dihedral",
    f"""WITH {FRAGMENTS_SQL}, d AS (SELECT frag, vid, t, {_dih} AS dih FROM pts JOIN frags USING (frag))
    SELECT a.frag AS a, b.frag AS b, count(*) AS n_hypotheses, round(avg(abs(a.dih + b.dih - 180)), 6) AS mean_off
    FROM d a JOIN d b ON a.frag < b.frag AND a.t / b.t BETWEEN 1 / {RATIO} AND {RATIO} AND abs(a.dih + b.dih - 180) < 2.0 GROUP BY 1, 2""",
)
def hypotheses_dihedral(spark, sf_dir):
    p = points(spark, sf_dir)
    h = pairs.dihedral_hypotheses(p, pairs.wall_ratio_pairs(fragments(p), RATIO), 2.0)
    return rounded(h.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_hypotheses"), F.avg(F.abs("off")).alias("mean_off")), "mean_off")


_near = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query(
    "coarse_nn_agree",
    f"""WITH {POINTS_SQL}, n AS (SELECT a.frag AS a, b.frag AS b, a.vid, a.nx*b.nx + a.ny*b.ny + a.nz*b.nz AS agree,
      row_number() OVER (PARTITION BY a.frag, a.vid, b.frag ORDER BY {_near}, b.vid) AS r
      FROM pts a JOIN pts b ON a.frag <> b.frag AND {_near} < 0.05 * 0.05)
    SELECT a, b, count(*) AS n_hit, count(*) FILTER (agree < -0.7) AS n_agree FROM n WHERE r = 1 GROUP BY 1, 2""",
)
def coarse_nn_agree(spark, sf_dir):
    p = points(spark, sf_dir).select("frag", "vid", "x", "y", "z", "nx", "ny", "nz")
    near = spatial.ball_join(p, p, 0.05).where("l.frag != r.frag")
    # of each pair only what decides and what is asked for is sent on, not the points
    agree = C.dot(["l.nx", "l.ny", "l.nz"], ["r.nx", "r.ny", "r.nz"]).alias("agree")
    of = near.select(F.col("l.frag").alias("a"), F.col("l.vid").alias("vid"), F.col("r.frag").alias("b"), F.struct("d", F.col("r.vid").alias("vid"), agree).alias("m"))
    n = of.groupBy("a", "vid", "b").agg(F.min("m").alias("m"))
    return n.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_hit"), F.count_if(F.col("m.agree") < -0.7).alias("n_agree"))


@query(
    "ball_normals",
    f"""WITH {POINTS_SQL} SELECT a.frag, a.vid, count(*) AS n_near, round(sum(b.area*b.nx)/sum(b.area), 6) AS nx, round(sum(b.area*b.ny)/sum(b.area), 6) AS ny, round(sum(b.area*b.nz)/sum(b.area), 6) AS nz
    FROM pts a JOIN pts b ON a.frag = b.frag AND {_near} < 0.1 * 0.1 GROUP BY 1, 2""",
)
def ball_normals(spark, sf_dir):
    return rounded(spatial.smoothed_normals(points(spark, sf_dir), 0.1), "nx", "ny", "nz")


@query(
    "majority_vote",
    f"""WITH {POINTS_SQL} SELECT a.frag, a.vid, sum(CASE WHEN b.is_fracture THEN b.area ELSE 0 END) > 0.5 * sum(b.area) AS majority
    FROM pts a JOIN pts b ON a.frag = b.frag AND {_near} < 0.1 * 0.1 GROUP BY 1, 2""",
)
def majority_vote(spark, sf_dir):
    return spatial.majority_labels(points(spark, sf_dir), 0.1)


@query(
    "voxel_representatives",
    f"""WITH {POINTS_SQL}, low AS (SELECT frag, min(x)-1 AS lx, min(y)-1 AS ly, min(z)-1 AS lz FROM pts GROUP BY 1)
    SELECT frag, min(vid) AS vid FROM pts JOIN low USING (frag) GROUP BY frag, floor((x-lx)/0.1), floor((y-ly)/0.1), floor((z-lz)/0.1)""",
)
def voxel_representatives(spark, sf_dir):
    return spatial.voxel_representatives(points(spark, sf_dir), 0.1)


@query(
    "seam_voxels",
    f"""WITH {FRAGMENTS_SQL}, v AS (SELECT DISTINCT frag, floor(x/(t/3)) AS i, floor(y/(t/3)) AS j, floor(z/(t/3)) AS k FROM pts JOIN frags USING (frag) WHERE is_fracture)
    SELECT frag, round(count(*) / 3, 6) AS seam FROM v GROUP BY 1""",
)
def seam_voxels(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(spatial.seam_length(p, fragments(p)), "seam")


@query(
    "hist_mode",
    """WITH t AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.9) AS top FROM lineitem GROUP BY 1),
    b AS (SELECT l_suppkey, top, least(59, floor(l_extendedprice / top * 60)) AS bin, count(*) AS c FROM lineitem JOIN t USING (l_suppkey) WHERE l_extendedprice BETWEEN 0 AND top AND top > 0 GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, bin) AS r FROM b)
    SELECT l_suppkey, round((bin + 0.5) * top / 60, 6) AS mode FROM r WHERE r = 1""",
)
def hist_mode(spark, sf_dir):
    return rounded(aggregates.histogram_mode(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice"), "mode")


@query(
    "median_mad_consensus",
    """WITH l AS (SELECT p_brand, 'p_retailprice' AS feature, p_retailprice AS v FROM part UNION ALL SELECT p_brand, 'p_size', CAST(p_size AS DOUBLE) FROM part),
    m AS (SELECT p_brand, feature, median(v) AS med, count(v) AS n FROM l GROUP BY 1, 2)
    SELECT p_brand, feature, n, round(med, 6) AS med, round(median(abs(v - med)), 6) AS mad FROM l JOIN m USING (p_brand, feature) GROUP BY 1, 2, 3, med""",
)
def median_mad_consensus(spark, sf_dir):
    return rounded(aggregates.consensus(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice", "p_size"]), "med", "mad")


@query(
    "loo_deviation",
    """WITH o AS (SELECT x.s_nationkey, x.s_suppkey, x.s_acctbal AS v, median(y.s_acctbal) AS med, count(*) AS others FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey GROUP BY 1, 2, 3),
    d AS (SELECT o.s_nationkey, o.s_suppkey, v, med, others, median(abs(y.s_acctbal - med)) AS mad FROM o JOIN supplier y ON o.s_nationkey = y.s_nationkey AND o.s_suppkey <> y.s_suppkey GROUP BY 1, 2, 3, 4, 5)
    SELECT s_nationkey, s_suppkey, round(med, 6) AS med, round(mad, 6) AS mad, round(abs(v - med) / greatest(mad, 3.0), 6) AS times, abs(v - med) / greatest(mad, 3.0) > 3.0 AS deviates FROM d WHERE others >= 3""",
)
def loo_deviation(spark, sf_dir):
    d = aggregates.leave_one_out_deviation(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", 3.0, 3.0)
    return rounded(d, "med", "mad", "times")


@query("watertight_edges", "WITH e AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT count(*) AS n_edges, count(*) FILTER (c <> 2) AS n_boundary, count(*) FILTER (c <> 2) <= 0.002 * count(*) AS watertight FROM e")
def watertight_edges(spark, sf_dir):
    return aggregates.edge_use(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "face_adjacency_lead",
    """WITH n AS (SELECT l_partkey, l_suppkey, l_orderkey AS o0, l_linenumber AS n0, lead(l_orderkey) OVER w AS o1, lead(l_linenumber) OVER w AS n1 FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber))
    SELECT * FROM n WHERE o1 IS NOT NULL""",
)
def face_adjacency_lead(spark, sf_dir):
    f = aggregates.consecutive_faces(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    return f.select("l_partkey", "l_suppkey", F.col("f0.l_orderkey").alias("o0"), F.col("f0.l_linenumber").alias("n0"), F.col("f1.l_orderkey").alias("o1"), F.col("f1.l_linenumber").alias("n1"))


# candidate view

RULE = Acceptance(min_tight=0.25, max_gap=0.05, max_pen=0.005, min_seam=3.0, min_cont=0.8)
TIER = TierRule(min_tight=0.35, max_gap=0.025, min_seam=5.0, min_cont=0.75, max_pen=0.004, max_slide=0.25)
#: Support counts where the way over a third fragment leads to within this of the join itself.
AGREE = 5.0
_ORD = "o1, o2, o3, o4"
_o = lambda df: df.select(*[c for c in df.columns if c != "ord"], *[F.col(f"ord.{f}").alias(k) for k, f in (("o1", "l_orderkey"), ("o2", "l_linenumber"), ("o3", "l_partkey"), ("o4", "l_suppkey"))])


def _all_tests():
    t = rules.acceptance_tests(RULE)
    return t["tight"] & t["gap"] & t["pen"] & t["seam"] & t["cont"]


@query("accept_filter", f"WITH {CANDIDATES_SQL} SELECT a, b, round(score, 6) AS score, {_ORD} FROM cand WHERE tight >= 0.25 AND gap <= 0.05 AND pen <= 0.005 AND seam >= 3.0 AND cont >= 0.8")
def accept_filter(spark, sf_dir):
    return rounded(_o(candidates(spark, sf_dir).where(_all_tests()).select("a", "b", "score", "ord")), "score")


@query(
    "refusal_reasons",
    f"""WITH {CANDIDATES_SQL} SELECT a, b, {_ORD}, concat_ws('; ', CASE WHEN NOT tight >= 0.25 THEN 'tight ' || format('{{:.3f}}', tight) || ' below 0.25' END,
    CASE WHEN NOT gap <= 0.05 THEN 'gap ' || format('{{:.3f}}', gap) || ' above 0.05' END, CASE WHEN NOT pen <= 0.005 THEN 'pen ' || format('{{:.3f}}', pen) || ' above 0.005' END,
    CASE WHEN NOT seam >= 3.0 THEN 'seam ' || format('{{:.3f}}', seam) || ' below 3.0' END, CASE WHEN NOT cont >= 0.8 THEN 'cont ' || format('{{:.3f}}', cont) || ' below 0.8' END) AS reasons FROM cand""",
)
def refusal_reasons(spark, sf_dir):
    r = rules.refusal_reasons(candidates(spark, sf_dir), RULE)
    return _o(r.select("a", "b", "ord", F.array_join("reasons", "; ").alias("reasons")))


_BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, {_ORD}) AS r FROM cand WHERE accepted) WHERE r = 1)"


@query("best_per_pair", f"WITH {CANDIDATES_SQL}, {_BEST} SELECT a, b, round(score, 6) AS score, seam, round(tight, 6) AS tight, gap, {_ORD} FROM best")
def best_per_pair(spark, sf_dir):
    return rounded(_o(ranking.best_per_pair(candidates(spark, sf_dir)).select("a", "b", "score", "seam", "tight", "gap", "ord")), "score", "tight")


_TOP = f"top AS (SELECT DISTINCT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY node ORDER BY score DESC, partner) AS r FROM (SELECT a, b, score, a AS node, b AS partner FROM best UNION ALL SELECT a, b, score, b, a FROM best)) WHERE r <= 2)"


@query("top_partners", f"WITH {CANDIDATES_SQL}, {_BEST}, {_TOP} SELECT a, b FROM top")
def top_partners(spark, sf_dir):
    return ranking.top_partners(ranking.best_per_pair(candidates(spark, sf_dir)), 2)


_SUPPORT = f"""ed AS (SELECT a, b, seam AS s FROM best UNION ALL SELECT b, a, -seam FROM best),
sup AS (SELECT x.a, y.b, count(*) AS support FROM ed x JOIN ed y ON x.b = y.a JOIN best e ON e.a = x.a AND e.b = y.b WHERE abs(x.s + y.s - e.seam) <= {AGREE} GROUP BY 1, 2)"""
_RIVAL = f"""rv AS (SELECT a, b, best - score AS margin, score AS rival, moved, rival_accepted FROM (SELECT best.a, best.b, best.score AS best, c.score, abs(c.seam - best.seam) AS moved, c.accepted AS rival_accepted,
  row_number() OVER (PARTITION BY best.a, best.b ORDER BY c.score DESC, c.o1, c.o2, c.o3, c.o4) AS r FROM best JOIN cand c ON c.a = best.a AND c.b = best.b AND abs(c.seam - best.seam) > 5) WHERE r = 1)"""
_STRICT = {"tight": "tight >= 0.35", "gap": "gap <= 0.025", "seam": "seam >= 5", "cont": "cont >= 0.75", "pen": "pen <= 0.004", "slide": "coalesce(slide <= 0.25, false)", "independent": "(coalesce(support, 0) >= 1 OR coalesce(margin >= 2.0, false))"}
_CONFIRMED = " AND ".join(_STRICT.values())
_TIERED = f"tiered AS (SELECT cand.*, support, margin, CASE WHEN accepted AND {_CONFIRMED} THEN 0 WHEN accepted THEN 1 ELSE 2 END AS rank FROM cand LEFT JOIN sup USING (a, b) LEFT JOIN rv USING (a, b))"
_NAME = "CASE rank WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' ELSE 'rejected' END"


def _support(best):
    return graph.support_counts(best.withColumn("shift", F.col("seam").cast("double")), AGREE)


def _tiered(spark, sf_dir):
    """All candidates with their tier; support and margin are those of the pair."""
    c = candidates(spark, sf_dir)
    best = ranking.best_per_pair(c.select("a", "b", "score", "accepted", "seam", "ord")).select("a", "b", "score", "seam")
    return with_evidence(c, c, graph.written(best), TIER, AGREE)


@query(
    "pair_representative",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}, {_TIERED},
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, score DESC, {_ORD}) AS r, count(*) OVER (PARTITION BY a, b) AS n_candidates FROM tiered)
    SELECT a, b, n_candidates, {_NAME} AS tier, round(score, 6) AS score, {_ORD} FROM r WHERE r = 1""",
)
def pair_representative(spark, sf_dir):
    r = ranking.pair_representatives(_tiered(spark, sf_dir), rules.tier_rank(F.col("tier")))
    return rounded(_o(r.select("a", "b", "n_candidates", "tier", "score", "ord")), "score")


@query("support_count", f"WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT} SELECT a, b, coalesce(support, 0) AS support FROM best LEFT JOIN sup USING (a, b)")
def support_count(spark, sf_dir):
    best = ranking.best_per_pair(candidates(spark, sf_dir).select("a", "b", "score", "accepted", "seam", "ord"))
    return _support(graph.written(best.select("a", "b", "seam")))


@query("rival_margin", f"WITH {CANDIDATES_SQL}, {_BEST}, {_RIVAL} SELECT a, b, round(best.score, 6) AS score, round(rival, 6) AS rival, round(margin, 6) AS margin, moved, rival_accepted FROM best LEFT JOIN rv USING (a, b)")
def rival_margin(spark, sf_dir):
    return rounded(ranking.rival_margin(candidates(spark, sf_dir), 5.0), "score", "rival", "margin")


@query(
    "tier_classify_r1",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}
    SELECT a, b, concat_ws(',', {", ".join(f"CASE WHEN NOT {v} THEN '{k}' END" for k, v in _STRICT.items())}) AS failed, CASE WHEN {_CONFIRMED} THEN 'confirmed' ELSE 'probable' END AS tier
    FROM best LEFT JOIN sup USING (a, b) LEFT JOIN rv USING (a, b)""",
)
def tier_classify_r1(spark, sf_dir):
    t = classified_joins(candidates(spark, sf_dir), TIER, AGREE)
    return t.select("a", "b", F.array_join("failed", ",").alias("failed"), "tier")


@query("tier_counts", f"WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}, {_TIERED} SELECT {_NAME} AS tier, count(*) AS n FROM tiered GROUP BY 1")
def tier_counts(spark, sf_dir):
    return _tiered(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probable_list",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_SUPPORT}, {_RIVAL}, {_TIERED}, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY rank, score DESC, {_ORD}) AS r FROM tiered),
    p AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY score DESC, {_ORD}) AS place FROM r WHERE r = 1 AND rank = 1) SELECT a, b, round(score, 6) AS score, total FROM p WHERE place <= 20""",
)
def probable_list(spark, sf_dir):
    """The twenty best probable pairs (a top-k report) and how many there are."""
    r = ranking.pair_representatives(_tiered(spark, sf_dir), rules.tier_rank(F.col("tier")))
    return rounded(ranking.best_of_tier(r, "probable", 20).select("a", "b", "score", "total"), "score")


@query("keep_top5", f"WITH {CANDIDATES_SQL}, r AS (SELECT a, b, {_ORD}, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, {_ORD}) - 1 AS rank, count(*) OVER (PARTITION BY a, b) AS pair_size FROM cand) SELECT * FROM r WHERE rank < 5")
def keep_top5(spark, sf_dir):
    return _o(ranking.keep_best(candidates(spark, sf_dir), 5).select("a", "b", "ord", "rank", "pair_size"))


@query(
    "second_pass_pairs",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, p AS (SELECT a, b, max(score) AS score FROM cand GROUP BY 1, 2), j AS (SELECT a, b FROM best WHERE score > 9500),
    n AS (SELECT a AS node FROM j UNION SELECT b FROM j), e AS (SELECT a AS node, b AS partner, score FROM p UNION ALL SELECT b, a, score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, partner) AS r FROM e ANTI JOIN n USING (node))
    SELECT DISTINCT least(node, partner) AS a, greatest(node, partner) AS b FROM r WHERE r <= 3""",
)
def second_pass_pairs(spark, sf_dir):
    c = candidates(spark, sf_dir)
    joined = ranking.best_per_pair(c).where("score > 9500").select("a", "b")
    return ranking.second_pass(c.groupBy("a", "b").agg(F.max("score").alias("score")), joined, 3)


@query(
    "candidate_index",
    f"""WITH {CANDIDATES_SQL}, e AS (SELECT a AS node, a, b, score, {_ORD} FROM cand WHERE NOT accepted UNION ALL SELECT b, a, b, score, {_ORD} FROM cand WHERE NOT accepted),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, {_ORD}) AS r FROM e), k AS (SELECT DISTINCT a, b, score, {_ORD} FROM r WHERE r <= 10)
    SELECT a, b, round(score, 6) AS score, {_ORD}, true AS accepted FROM cand WHERE accepted UNION ALL SELECT a, b, round(score, 6), {_ORD}, false FROM k""",
)
def candidate_index(spark, sf_dir):
    return rounded(_o(ranking.candidate_index(candidates(spark, sf_dir), 10)), "score")


@query(
    "disagreement_pairs",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, {_TOP}, e AS (SELECT a AS n, b AS m, seam FROM best JOIN top USING (a, b) UNION ALL SELECT b, a, seam FROM best JOIN top USING (a, b))
    SELECT x.n AS node, x.m AS p, y.m AS q, round(abs(x.seam - y.seam), 6) AS gap FROM e x JOIN e y ON x.n = y.n AND x.m < y.m AND abs(x.seam - y.seam) > 10""",
)
def disagreement_pairs(spark, sf_dir):
    best = ranking.best_per_pair(candidates(spark, sf_dir))
    return rounded(graph.disagreeing_edges(best.join(ranking.top_partners(best, 2), ["a", "b"]), 10.0), "gap")


@query(
    "constraint_veto",
    f"WITH {CANDIDATES_SQL}, {_BEST}, v AS (SELECT DISTINCT least(c_nationkey, c_custkey % 100) AS a, greatest(c_nationkey, c_custkey % 100) AS b FROM customer) SELECT a, b, round(score, 6) AS score FROM best ANTI JOIN v USING (a, b)",
)
def constraint_veto(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return rounded(rules.without_vetoed(ranking.best_per_pair(candidates(spark, sf_dir)), v).select("a", "b", "score"), "score")


@query(
    "agree_across_runs",
    f"""WITH {CANDIDATES_SQL}, r AS (SELECT a, b, o2 % 2 AS run, seam, row_number() OVER (PARTITION BY a, b, o2 % 2 ORDER BY score DESC, seam DESC) AS r FROM cand WHERE accepted)
    SELECT a, b, round(max(seam) - min(seam), 6) AS spread FROM r WHERE r = 1 GROUP BY 1, 2 HAVING count(*) = 2 AND max(seam) - min(seam) <= 5""",
)
def agree_across_runs(spark, sf_dir):
    return rounded(evaluation.agreeing_pairs(candidates(spark, sf_dir), F.col("ord.l_linenumber") % 2, 2, 5.0), "spread")


@query(
    "connected_components",
    f"""WITH RECURSIVE {CANDIDATES_SQL.strip()}, {_BEST},
    e AS (SELECT a, b FROM best UNION SELECT b, a FROM best), w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a)
    SELECT node, min(seen) AS component FROM w GROUP BY 1""",
)
def connected_components(spark, sf_dir):
    return graph.connected_components(ranking.best_per_pair(candidates(spark, sf_dir)).select("a", "b"))


@query(
    "drop_small_components",
    f"""WITH RECURSIVE {CANDIDATES_SQL.strip()}, {_BEST},
    e AS (SELECT a, b FROM best UNION SELECT b, a FROM best), w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a), c AS (SELECT node, min(seen) AS component FROM w GROUP BY 1)
    SELECT component, count(*) AS n_nodes, round(sum(abs(s_acctbal)), 2) AS area, sum(abs(s_acctbal)) >= 20000 AS kept FROM c JOIN supplier ON node = s_suppkey GROUP BY 1""",
)
def drop_small_components(spark, sf_dir):
    areas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.abs("s_acctbal").alias("area"))
    return rounded(graph.component_areas(connected_components(spark, sf_dir), areas, 20000.0), "area", digits=2)


@query("transforms_export", f"WITH {CANDIDATES_SQL}, {_BEST} SELECT a, b, format('{{:.3f}}', seam) AS m03, format('{{:.3f}}', tight) AS m13, format('{{:.3f}}', gap) AS m23, CAST(1 AS INTEGER) AS m33 FROM best")
def transforms_export(spark, sf_dir):
    b = ranking.best_per_pair(candidates(spark, sf_dir))
    return b.select("a", "b", *[F.format_string("%.3f", c).alias(k) for c, k in (("seam", "m03"), ("tight", "m13"), ("gap", "m23"))], F.lit(1).alias("m33"))


@query(
    "join_verdicts",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, adj AS (SELECT DISTINCT least(c_nationkey, c_custkey % 100) AS a, greatest(c_nationkey, c_custkey % 100) AS b FROM customer)
    SELECT a, b, CASE WHEN x.n_regionkey IS NULL OR y.n_regionkey IS NULL THEN 'unscorable' WHEN x.n_regionkey <> y.n_regionkey THEN 'cross_object' WHEN adj.a IS NULL THEN 'non_adjacent' ELSE 'correct' END AS verdict
    FROM best LEFT JOIN nation x ON best.a = x.n_nationkey LEFT JOIN nation y ON best.b = y.n_nationkey LEFT JOIN adj USING (a, b)""",
)
def join_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)[0].select("a", "b", "verdict")


def _verdicts(spark, sf_dir):
    best = ranking.best_per_pair(candidates(spark, sf_dir))
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("object"))
    adj = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return evaluation.join_verdicts(best, objects, adj), adj


@query(
    "precision_recall",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, adj AS (SELECT DISTINCT least(c_nationkey, c_custkey % 100) AS a, greatest(c_nationkey, c_custkey % 100) AS b FROM customer),
    v AS (SELECT x.n_regionkey = y.n_regionkey AND adj.a IS NOT NULL AS ok FROM best JOIN nation x ON best.a = x.n_nationkey JOIN nation y ON best.b = y.n_nationkey LEFT JOIN adj USING (a, b))
    SELECT count(*) AS n_joins, count(*) FILTER (ok) AS n_correct, (SELECT count(*) FROM adj) AS n_truth, round(count(*) FILTER (ok) / nullif(count(*), 0), 6) AS precision, round(count(*) FILTER (ok) / nullif((SELECT count(*) FROM adj), 0), 6) AS recall FROM v""",
)
def precision_recall(spark, sf_dir):
    v, adj = _verdicts(spark, sf_dir)
    return rounded(evaluation.precision_recall(v, adj), "precision", "recall")


@query(
    "group_purity",
    """WITH c AS (SELECT c_mktsegment AS grp, n_regionkey AS object, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, object) AS r, sum(c) OVER (PARTITION BY grp) AS n FROM c)
    SELECT grp, CAST(n AS BIGINT) AS n_members, object AS main_object, round(c / n, 6) AS purity FROM r WHERE r = 1""",
)
def group_purity(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("grp"))
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("object"))
    return rounded(evaluation.group_purity(groups, objects), "purity")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")


@query(
    "auc",
    """WITH l AS (SELECT n_chars AS s, quality = 1 AS p FROM labels JOIN documents USING (doc_id)), g AS (SELECT s, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS n FROM l GROUP BY 1),
    c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM c""",
)
def auc(spark, sf_dir):
    return rounded(evaluation.auc(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1), "auc")


_G1, _G2 = [0.0, 0.25, 0.5, 0.75], [1.0, 10.0, 25.0, 40.0]


@query(
    "threshold_search",
    f"""WITH {CANDIDATES_SQL}, g AS (SELECT unnest([{", ".join(map(str, _G1))}]::DOUBLE[]) AS low1), h AS (SELECT unnest([{", ".join(map(str, _G2))}]::DOUBLE[]) AS low2)
    SELECT low1, low2, count(*) FILTER (accepted AND tight >= low1 AND seam >= low2) AS ok, count(*) FILTER (NOT accepted AND tight >= low1 AND seam >= low2) AS bad FROM cand, g, h GROUP BY 1, 2""",
)
def threshold_search(spark, sf_dir):
    return evaluation.threshold_search(candidates(spark, sf_dir), {"tight": _G1, "seam": _G2}, F.col("accepted"))


@query(
    "mad_veto",
    """WITH l AS (SELECT CAST(n_chars AS DOUBLE) AS v, quality = 1 AS pos FROM labels JOIN documents USING (doc_id)), m AS (SELECT median(v) AS med FROM l), d AS (SELECT abs(v - med) AS dev, pos FROM l, m), s AS (SELECT median(dev) AS mad FROM d)
    SELECT CAST(k AS DOUBLE) AS k, count(*) FILTER (dev > k * mad AND pos) AS lost, count(*) FILTER (dev > k * mad AND NOT pos) AS caught FROM d, s, (SELECT unnest([2, 3, 5]) AS k) GROUP BY 1""",
)
def mad_veto(spark, sf_dir):
    return evaluation.veto_cost(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, [2, 3, 5])


@query(
    "ratio_gate",
    """WITH m AS (SELECT p_brand, median(p_retailprice) AS med FROM part GROUP BY 1)
    SELECT ratio, count(*) FILTER (p_retailprice / med <= ratio AND p_retailprice / med >= 1 / ratio) AS kept, count(*) AS n FROM part JOIN m USING (p_brand), (SELECT unnest([1.05, 1.25, 2.5]::DOUBLE[]) AS ratio) GROUP BY 1""",
)
def ratio_gate(spark, sf_dir):
    return evaluation.ratio_gate(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", [1.05, 1.25, 2.5])


# files, decisions and progress


@query("snapshot_diff", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 'added' WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 5 = 0 AND doc_id % 7 <> 0) OR (doc_id % 5 <> 0 AND doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0)")
def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    new = d.where("doc_id % 7 != 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0))
    return progress.snapshot_diff(d.where("doc_id % 5 != 0"), new, "doc_id", "n_chars")


@query(
    "fragment_names",
    r"""WITH s AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS last FROM pages), t AS (SELECT *, regexp_replace(last, '\.[^.]*$', '') AS stem FROM s)
    SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN replace(last, '.', '_') ELSE stem END AS name, right(regexp_replace(stem, '\D', '', 'g'), 3) AS label FROM t""",
)
def fragment_names(spark, sf_dir):
    last = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/*$", 1)
    p = table(spark, sf_dir, "pages").select("page_id", last.alias("last"), C.file_stem("url").alias("stem"))
    many = p.groupBy("stem").agg(F.count(F.lit(1)).alias("c"))
    return p.join(many, "stem").select("page_id", F.when(F.col("c") > 1, F.replace(F.col("last"), F.lit("."), F.lit("_"))).otherwise(F.col("stem")).alias("name"), C.digits_label("stem").alias("label"))


@query("decision_upsert", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n_decisions FROM events) SELECT user_id, n_decisions, ts, event_type, round(value, 6) AS value FROM r WHERE r = 1")
def decision_upsert(spark, sf_dir):
    return rounded(progress.last_decisions(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_type", "value"]), "value")


@query(
    "review_queue",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, d AS (SELECT least(s_nationkey, s_suppkey) AS a, greatest(s_nationkey, s_suppkey) AS b, CASE WHEN s_acctbal > 0 THEN 'accept' ELSE 'reject' END AS verdict FROM supplier)
    SELECT a, b, round(score, 6) AS score, verdict, verdict IS NULL AS open FROM best LEFT JOIN d USING (a, b)""",
)
def review_queue(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"), F.when(F.col("s_acctbal") > 0, "accept").otherwise("reject").alias("verdict"))
    return rounded(progress.review_queue(ranking.best_per_pair(candidates(spark, sf_dir)), d).select("a", "b", "score", "verdict", "open"), "score")


@query(
    "eta_trailing_rate",
    "SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS n_recent FROM events",
)
def eta_trailing_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bucket = F.floor(F.col("ts").cast("timestamp").cast("long") / 86_400)
    r = progress.trailing_rate(e.select("event_type", "ts", "event_id"), "event_type", "ts", 21_600, bucket, extra=["event_id"])
    return r.select("event_type", "event_id", "n_recent")


@query(
    "calibration_fold",
    """WITH r AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events WHERE value IS NOT NULL)
    SELECT user_id, count(*) AS n, round(sum(value * CASE WHEN back = n - 1 THEN pow(0.5, back) ELSE pow(0.5, back + 1) END), 6) AS calibrated FROM r GROUP BY 1""",
)
def calibration_fold(spark, sf_dir):
    return rounded(progress.calibration_fold(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value"), "calibrated")


@query("status_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice > 100000 THEN 'large' ELSE 'waiting' END AS status FROM orders")
def status_case(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rules_ = [(F.col("o_orderstatus") == "F", "done"), (F.col("o_orderpriority").like("1%"), "urgent"), (F.col("o_totalprice") > 100000, "large")]
    return o.select("o_orderkey", progress.derived_status(o, rules_, "waiting").alias("status"))


# colour


_RGB = "rgb AS (SELECT vec_id, label, floor(255 * least(1, greatest(0, CAST(embedding[1] AS DOUBLE) + 0.5))) AS r, floor(255 * least(1, greatest(0, CAST(embedding[2] AS DOUBLE) + 0.5))) AS g, floor(255 * least(1, greatest(0, CAST(embedding[3] AS DOUBLE) + 0.5))) AS b FROM embeddings)"
_lin = lambda c: f"CASE WHEN {c}/255.0 <= 0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0 + 0.055)/1.055, 2.4) END"
_LAB = f"""{_RGB}, lin AS (SELECT vec_id, label, {_lin("r")} AS r, {_lin("g")} AS g, {_lin("b")} AS b FROM rgb),
xyz AS (SELECT vec_id, label, (0.4124564*r + 0.3575761*g + 0.1804375*b)/0.95047 AS x, 0.2126729*r + 0.7151522*g + 0.0721750*b AS y, (0.0193339*r + 0.1191920*g + 0.9503041*b)/1.08883 AS z FROM lin),
f AS (SELECT vec_id, label, {", ".join(f"CASE WHEN {c} > 216.0/24389 THEN cbrt({c}) ELSE (24389.0/27*{c} + 16)/116 END AS {c}" for c in "xyz")} FROM xyz),
lab AS (SELECT vec_id, label, 116*y - 16 AS l, 500*(x - y) AS a, 200*(y - z) AS b FROM f)"""


def _lab(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = lambda i: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.element_at("embedding", i).cast("double") + 0.5)))
    rgb = e.select("vec_id", "label", d(1).alias("r"), d(2).alias("g"), d(3).alias("b"))
    lo, a, b = C.srgb_to_lab("r", "g", "b")
    return rgb.select("vec_id", "label", lo.alias("l"), a.alias("a"), b.alias("b"))


@query("colour_lab_hist", f"WITH {_LAB} SELECT label, greatest(0, least(63, floor(l / 100 * 64)))::INTEGER AS bin, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM lab GROUP BY 1, 2")
def colour_lab_hist(spark, sf_dir):
    g = _lab(spark, sf_dir).groupBy("label", C.bin_index("l", 0, 100, 64).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return rounded(g, "mean_a", "mean_b")


@query("delta_e", f"WITH {FRAGMENTS_SQL}, {_LAB}, m AS (SELECT label, avg(l) AS l, avg(a) AS a, avg(b) AS b FROM lab GROUP BY 1) SELECT x.label AS p, y.label AS q, round(sqrt((x.l-y.l)*(x.l-y.l) + (x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b)), 6) AS delta_e FROM m x JOIN m y ON x.label < y.label JOIN frags f ON f.frag = x.label JOIN frags g ON g.frag = y.label WHERE f.t / g.t BETWEEN 1 / {RATIO} AND {RATIO}")
def delta_e(spark, sf_dir):
    m = _lab(spark, sf_dir).groupBy("label").agg(*[F.avg(c).alias(c) for c in ("l", "a", "b")]).select("label", F.struct("l", "a", "b").alias("c"))
    d = C.delta_e(["x.l", "x.a", "x.b"], ["y.l", "y.a", "y.b"])
    return rounded(_of_pairs(spark, sf_dir, m).select("p", "q", d.alias("delta_e")), "delta_e")


def _of_pairs(spark, sf_dir, values):
    """p, q, x, y: values(label, c) of both ends of each pair that the wall ratio leaves."""
    kept = pairs.wall_ratio_pairs(fragments(points(spark, sf_dir)), RATIO).select(F.col("a").alias("p"), F.col("b").alias("q"))
    of = lambda k, c: values.select(F.col("label").alias(k), F.col("c").alias(c))
    return kept.join(of("p", "x"), "p").join(of("q", "y"), "q")


@query(
    "hist_tv",
    f"""WITH {FRAGMENTS_SQL}, {_LAB}, h AS (SELECT label, greatest(0, least(63, floor(l / 100 * 64))) AS bin, count(*) AS c FROM lab GROUP BY 1, 2), s AS (SELECT label, bin, c / sum(c) OVER (PARTITION BY label) AS p FROM h),
    k AS (SELECT f.frag AS p, g.frag AS q FROM frags f JOIN frags g ON f.frag < g.frag WHERE f.t / g.t BETWEEN 1 / {RATIO} AND {RATIO})
    SELECT k.p, k.q, round(sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) / 2, 6) AS tv FROM k, (SELECT unnest(range(64)) AS i) LEFT JOIN s x ON x.label = k.p AND x.bin = i LEFT JOIN s y ON y.label = k.q AND y.bin = i GROUP BY 1, 2""",
)
def hist_tv(spark, sf_dir):
    bins = _lab(spark, sf_dir).select("label", C.bin_index("l", 0, 100, 64).alias("bin"))
    h = bins.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(64)])
    s = h.select("label", F.array(*[F.col(f"b{i}") / F.col("n") for i in range(64)]).alias("h"))
    return rounded(_of_pairs(spark, sf_dir, s.withColumnRenamed("h", "c")).select("p", "q", C.array_variation("x", "y").alias("tv")), "tv")


# greedy and numeric operators: no SQL, tests hold them against plain loops


@query("nms_greedy")
def nms_greedy(spark, sf_dir):
    return rounded(assembly.suppress_near(candidates(spark, sf_dir).where("accepted"), 5.0, 500.0, 3), "score")


@query("greedy_assembly")
def greedy_assembly(spark, sf_dir):
    joins = ranking.best_per_pair(candidates(spark, sf_dir)).withColumn("shift", F.col("seam").cast("double"))
    return assembly.assemble(joins, 5.0)


@query("reassembly_plan")
def reassembly_plan(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return rounded(reassembly(candidates(spark, sf_dir), v, TIER, 5.0), "score")


@query("pca_axis")
def pca_axis(spark, sf_dir):
    return fits.principal_axes(points(spark, sf_dir), "frag")


@query("sphere_fit")
def sphere_fit(spark, sf_dir):
    return fits.sphere_fit(points(spark, sf_dir), "frag")


@query("icp_align")
def icp_align(spark, sf_dir):
    """Each fragment's points, turned by 4 degrees and moved a little, brought back to themselves."""
    p = points(spark, sf_dir).select("frag", "vid", "x", "y", "z")
    c, s = 0.9975640502598242, 0.0697564737441253  # cosine and sine of 4 degrees
    moved = p.select("frag", "vid", (c * F.col("x") - s * F.col("y") + 0.004).alias("x"), (s * F.col("x") + c * F.col("y") - 0.003).alias("y"), (F.col("z") + 0.002).alias("z"))
    return fits.icp(moved, p, 0.05, 3)


@query(
    "weighted_picks",
    """WITH i AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS w FROM part), r AS (SELECT p_partkey, w, sum(w) OVER (ORDER BY p_partkey) AS upto FROM i), t AS (SELECT sum(w) AS n FROM i)
    SELECT o_orderkey AS draw, p_partkey FROM orders, t JOIN r ON (o_orderkey * 7919 + CAST(round(o_totalprice * 100) AS BIGINT)) % n >= upto - w AND (o_orderkey * 7919 + CAST(round(o_totalprice * 100) AS BIGINT)) % n < upto""",
)
def weighted_picks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("w"))
    total = parts.agg(F.sum("w").alias("n"))  # one row
    at = (F.col("o_orderkey") * 7919 + F.round(F.col("o_totalprice") * 100).cast("long")) % F.col("n")
    draws = table(spark, sf_dir, "orders").crossJoin(F.broadcast(total)).select(F.col("o_orderkey").alias("draw"), at.alias("at"))
    return progress.weighted_picks(parts, "p_partkey", "w", draws)


@query(
    "walk_order",
    f"""WITH {CANDIDATES_SQL}, {_BEST}, f AS (SELECT DISTINCT 1 AS g, least(s_nationkey, s_suppkey) AS a, greatest(s_nationkey, s_suppkey) AS b FROM supplier)
    SELECT a, b, g IS NOT NULL AS forced, round(score, 6) AS score, row_number() OVER (ORDER BY g IS NOT NULL DESC, score DESC, {_ORD}) AS place FROM best LEFT JOIN f USING (a, b)""",
)
def walk_order(spark, sf_dir):
    forced = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"))
    return rounded(rules.walk_order(ranking.best_per_pair(candidates(spark, sf_dir)), forced).select("a", "b", "forced", "score", "place"), "score")


@query(
    "constraint_contradictions",
    """WITH c AS (SELECT 'must_join' AS list, least(s_nationkey, s_suppkey) AS a, greatest(s_nationkey, s_suppkey) AS b FROM supplier UNION SELECT 'must_not_join', least(c_nationkey, c_custkey % 100), greatest(c_nationkey, c_custkey % 100) FROM customer)
    SELECT a, b, string_agg(list, ',' ORDER BY list) AS lists FROM c GROUP BY 1, 2 HAVING count(DISTINCT list) > 1""",
)
def constraint_contradictions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("must_join").alias("list"), F.col("s_nationkey").cast("long").alias("a"), F.col("s_suppkey").alias("b"))
    c = table(spark, sf_dir, "customer").select(F.lit("must_not_join").alias("list"), F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 100).alias("b"))
    return rules.contradictions(s.unionByName(c)).select("a", "b", F.array_join("lists", ",").alias("lists"))
