"""Best, top-k and representative rows of pairs. Every ranking ends in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accepted_candidates(cand: DataFrame) -> DataFrame:
    return cand.where("accepted")


def best_per_pair(cand: DataFrame) -> DataFrame:
    """The accepted candidate with the highest score of each pair; the first in order on ties.

    An aggregate, not a window: a pair with very many candidates is reduced
    before it is shuffled.
    """
    rest = [c for c in cand.columns if c not in ("a", "b", "score", "ord")]
    # the largest of (score, smallest ord, turned around field by field) brings the other columns with it, so each is held once
    fields = cand.schema["ord"].dataType.names
    first = F.struct("score", *[(-F.col(f"ord.{f}")).alias(f"_{i}") for i, f in enumerate(fields)], *rest)
    g = cand.where("accepted").groupBy("a", "b").agg(F.max(first).alias("m"))
    kept = {"score": F.col("m.score"), "ord": F.struct(*[(-F.col(f"m._{i}")).alias(f) for i, f in enumerate(fields)])}
    return g.select("a", "b", *[kept.get(c, F.col(f"m.{c}")).alias(c) for c in cand.columns if c not in ("a", "b")])


def pair_representatives(cand: DataFrame, tier_rank: Column) -> DataFrame:
    """One candidate for each pair: the lowest tier rank, then the highest score, then the first."""
    rest = [c for c in cand.columns if c not in ("a", "b")]
    fields = cand.schema["ord"].dataType.names
    key = F.struct((-tier_rank).alias("t"), F.col("score"), *[(-F.col(f"ord.{f}")).alias(f) for f in fields])
    g = cand.groupBy("a", "b").agg(F.max_by(F.struct(*rest), key).alias("m"), F.count(F.lit(1)).alias("n_candidates"))
    return g.select("a", "b", "n_candidates", *[F.col(f"m.{c}").alias(c) for c in rest])


def both_ends(pairs: DataFrame, *columns: str) -> DataFrame:
    """Each pair from either end: node, partner and the columns."""
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("partner"), *columns).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("partner"), *columns))


def top_partners(pairs: DataFrame, k: int) -> DataFrame:
    """a, b: pairs among the k best (by score, then partner) of either end."""
    w = Window.partitionBy("node").orderBy(F.desc("score"), "partner")
    top = both_ends(pairs, "score").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def keep_best(cand: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each pair, with rank (from 0) and the pair's number of candidates."""
    w = Window.partitionBy("a", "b")
    r = cand.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "ord")) - 1).withColumn("pair_size", F.count(F.lit(1)).over(w))
    return r.where(F.col("rank") < k)


def second_pass(pairs: DataFrame, joined: DataFrame, k: int) -> DataFrame:
    """a, b: for each node that no joined pair has, its k best pairs."""
    nodes = both_ends(joined).select("node").distinct()
    ends = both_ends(pairs, "score").join(nodes, "node", "left_anti")
    w = Window.partitionBy("node").orderBy(F.desc("score"), "partner")
    top = ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct()


def candidate_index(cand: DataFrame, k: int) -> DataFrame:
    """Accepted candidates, and for each node its k best others."""
    refused = cand.where("not accepted")
    w = Window.partitionBy("node").orderBy(F.desc("score"), "ord")
    ends = both_ends(refused, "score", "ord").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    keep = ends.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b"), "score", "ord").distinct()
    return cand.where("accepted").select("a", "b", "score", "ord", F.lit(True).alias("accepted")).unionByName(keep.withColumn("accepted", F.lit(False)))


def rival_margin(cand: DataFrame, gap: float) -> DataFrame:
    """a, b, score, rival, margin, moved, rival_accepted: each pair's best accepted candidate and the best other whose placement (seam) is over ``gap`` away.

    moved is how far away that one is, rival_accepted whether it is accepted itself.
    """
    fields = cand.schema["ord"].dataType.names
    cand = cand.select("a", "b", "score", "seam", "accepted", "ord")  # what is shuffled
    best = best_per_pair(cand).select("a", "b", F.col("score").alias("best"), F.col("seam").alias("at"))
    far = cand.join(best, ["a", "b"]).withColumn("moved", F.abs(F.col("seam") - F.col("at"))).where(F.col("moved") > gap)
    first = F.struct("score", *[(-F.col(f"ord.{f}")).alias(f) for f in fields])
    r = far.groupBy("a", "b").agg(F.max_by(F.struct("score", "moved", "accepted"), first).alias("m"))
    j = best.join(r, ["a", "b"], "left")
    return j.select("a", "b", F.col("best").alias("score"), F.col("m.score").alias("rival"), (F.col("best") - F.col("m.score")).alias("margin"), F.col("m.moved").alias("moved"), F.col("m.accepted").alias("rival_accepted"))


def margins(cand: DataFrame, best: DataFrame, gap: float) -> DataFrame:
    """a, b, margin of rival_margin for the pairs that have a rival, given best(a, b, score, seam); no order is needed for it."""
    at = best.select("a", "b", F.col("score").alias("best"), F.col("seam").alias("at"))
    far = cand.select("a", "b", "score", "seam").join(at, ["a", "b"]).where(F.abs(F.col("seam") - F.col("at")) > gap)
    return far.groupBy("a", "b").agg((F.max("best") - F.max("score")).alias("margin"))


def best_of_tier(cand: DataFrame, tier: str, top: int) -> DataFrame:
    """The ``top`` best rows of a tier by score, then order (all with 0), each with the number of the tier's rows before the cut."""
    band = cand.where(F.col("tier") == tier)
    total = band.agg(F.count(F.lit(1)).alias("total"))  # one row
    ordered = band.orderBy(F.desc("score"), "ord").limit(top) if top else band
    return ordered.crossJoin(F.broadcast(total))
