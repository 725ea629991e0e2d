"""Placements of one pair: those that stay when near ones are suppressed, how many differ, and the best that lies elsewhere.

All take candidates(a, b, pose, score, ord) with ord a struct that orders all rows;
higher scores go first, then smaller ord. Candidates without a score are last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import poses
from terrafold.operators.graph import written

#: Trace of the turn between two poses over which they are turned alike, and walls within which a placement is the same; fixed values.
ALIKE, SAME = 2.9, 1.0


def _first(cand: DataFrame) -> DataFrame:
    """a, b, best_ord, best_pose: each pair's first candidate."""
    key = F.struct("score", *[(-F.col(f"ord.{f}")).alias(f) for f in cand.schema["ord"].dataType.names])
    return cand.groupBy("a", "b").agg(F.max_by(F.struct("ord", "pose", "score"), key).alias("m")).select("a", "b", F.col("m.ord").alias("best_ord"), F.col("m.pose").alias("best_pose"), F.col("m.score").alias("best_score"))


def _at(p: str, i: int, j: int) -> Column:
    return F.element_at(p, 4 * i + j + 1)


def alike(p: str, q: str, tol: Column) -> Column:
    """Whether two poses shift by less than tol apart and turn by less than what ALIKE says."""
    off = F.sqrt(sum(((_at(p, i, 3) - _at(q, i, 3)) ** 2 for i in range(1, 3)), (_at(p, 0, 3) - _at(q, 0, 3)) ** 2))
    return (off < tol) & (sum((_at(p, i, j) * _at(q, i, j) for i in range(3) for j in range(3)), F.lit(0.0)) > ALIKE)


def suppress_alike(cand: DataFrame, tol: float, floor: float, keep: int) -> DataFrame:
    """a, b, rank, ord, pose, score: each pair's candidates from the first on that are like none kept before.

    The walk ends at a score under floor and after keep kept ones. In a round the
    best of every pair is kept and what is like it goes, so rounds are ``keep`` at
    most, however many candidates a pair has.
    """
    left, kept = written(cand.where(F.col("score") >= floor).select("a", "b", "pose", "score", "ord")), None
    for k in range(keep):
        best = written(_first(left))
        if kept is not None and best.isEmpty():
            break
        row = best.select("a", "b", F.lit(k).alias("rank"), F.col("best_ord").alias("ord"), F.col("best_pose").alias("pose"), F.col("best_score").alias("score"))
        kept = row if kept is None else kept.unionByName(row)
        if k + 1 < keep:
            left = written(left.join(best, ["a", "b"]).where((F.col("ord") != F.col("best_ord")) & ~alike("pose", "best_pose", F.lit(tol))).select("a", "b", "pose", "score", "ord"))
    return kept


def placement_gaps(cand: DataFrame, best: DataFrame, probes: DataFrame) -> DataFrame:
    """cand with moved: the farthest that any of b's probes(node, x, y, z) lies from where the pair's best(a, b, best_ord, best_pose) puts it, in walls (t); null without probes."""
    j = cand.join(best, ["a", "b"])
    p = probes.select(F.col("node").alias("b"), "x", "y", "z")
    far = j.join(p, "b").groupBy("a", "b", "ord").agg((F.max(poses.gap_at("pose", "best_pose", ["x", "y", "z"])) / F.first("t")).alias("moved"))
    return j.join(far, ["a", "b", "ord"], "left")


def distinct_placements(cand: DataFrame, probes: DataFrame, same: float = SAME) -> DataFrame:
    """a, b, placements: how many of a pair's candidates(.., t) lie farther than ``same`` walls from all that count before them.

    A round counts the first of every pair and takes away what is within reach of
    it, so rounds are as many as the most placements that a pair has. Candidates
    whose distance is unknown are the same placement.
    """
    left, counted = written(cand.select("a", "b", "pose", "score", "ord", "t")), None
    while True:
        best = written(_first(left))
        if best.isEmpty():
            break
        row = best.select("a", "b")
        counted = row if counted is None else counted.unionByName(row)
        left = written(placement_gaps(left, best, probes).where((F.col("ord") != F.col("best_ord")) & (F.col("moved") > same)).select("a", "b", "pose", "score", "ord", "t"))
    counted = cand.select("a", "b").limit(0) if counted is None else counted
    return counted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("placements"))


def wide_rivals(cand: DataFrame, probes: DataFrame, same: float = SAME) -> DataFrame:
    """a, b, ord, score, moved, accepted: the best of a pair's candidates(.., t, accepted) that lies farther than ``same`` walls from its first one; pairs of which none is accepted have none."""
    some = cand.groupBy("a", "b").agg(F.max("accepted").alias("any")).where("any").select("a", "b")
    mine = written(cand.select("a", "b", "pose", "score", "ord", "t", "accepted").join(some, ["a", "b"]))
    far = placement_gaps(mine, _first(mine), probes).where((F.col("moved") > same) & (F.col("moved") < float("inf")))
    key = F.struct("score", *[(-F.col(f"ord.{f}")).alias(f) for f in cand.schema["ord"].dataType.names])
    return far.groupBy("a", "b").agg(F.max_by(F.struct("ord", "score", "moved", "accepted"), key).alias("m")).select("a", "b", "m.*")
