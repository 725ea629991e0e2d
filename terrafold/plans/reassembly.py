"""The end-to-end plan over candidates: accept, support, classify, veto, assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import assembly, graph, ranking, rules
from terrafold.operators.graph import written
from terrafold.params import TierRule


def with_evidence(rows: DataFrame, cand: DataFrame, best: DataFrame, rule: TierRule, tol: float, far: float = 5.0) -> DataFrame:
    """rows(a, b, ..) classified, with support and margin of their pairs; best has each pair's best accepted candidate (a, b, score, seam).

    All pairs' best candidates count as support, where their seams place b within tol.
    """
    support = graph.support_counts(best.withColumn("shift", F.col("seam").cast("double")), tol)
    if rule.min_moved or rule.rival_refused:
        margin = ranking.rival_margin(cand, far).select("a", "b", "margin", "moved", "rival_accepted")
    else:
        margin = ranking.margins(cand, best, far)
    return rules.classify(rules.tested(rows, rule).join(support, ["a", "b"], "left").join(margin, ["a", "b"], "left"), rule)


def classified_joins(cand: DataFrame, rule: TierRule, tol: float, far: float = 5.0) -> DataFrame:
    """Each pair's best accepted candidate with support, margin, failed and tier."""
    best = written(ranking.best_per_pair(cand))
    return with_evidence(best, cand, best, rule, tol, far)


def reassembly(cand: DataFrame, vetoes: DataFrame, rule: TierRule, tol: float) -> DataFrame:
    """a, b, tier, status, reason, grp: confirmed joins without vetoed ones, grown into groups."""
    joins = written(rules.without_vetoed(classified_joins(cand, rule, tol).where("tier = 'confirmed'"), vetoes))
    placed = assembly.assemble(joins.withColumn("shift", F.col("seam").cast("double")), tol)
    return placed.join(joins.select("a", "b", "tier", "score"), ["a", "b"])
