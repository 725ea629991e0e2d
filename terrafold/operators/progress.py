"""Decisions, snapshots and progress over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_decisions(log: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """The latest row of each key: the last decision wins."""
    return log.groupBy(*keys).agg(F.max(F.struct(ts, *values)).alias("m"), F.count(F.lit(1)).alias("n_decisions")).select(*keys, "n_decisions", f"m.{ts}", *[F.col(f"m.{v}").alias(v) for v in values])


def review_queue(best: DataFrame, decisions: DataFrame) -> DataFrame:
    """best with the verdict on each pair, if any, and open, whether it has none."""
    d = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "verdict")
    return best.join(d, ["a", "b"], "left").withColumn("open", F.col("verdict").isNull())


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """key, change (added, removed or changed) for files whose state differs between two snapshots."""
    o, n = old.select(key, F.col(state).alias("was")).withColumn("_o", F.lit(1)), new.select(key, F.col(state).alias("is")).withColumn("_n", F.lit(1))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return j.withColumn("change", change).where("change is not null").select(key, "change")


def trailing_rate(events: DataFrame, key: str, ts: str, seconds: int, bucket: Column, extra: list[str] | None = None) -> DataFrame:
    """key, ts, n_recent: how many events of the key fell in the last ``seconds`` up to each event.

    Windows run inside (key, bucket); each event is also given to the next
    bucket, so a bucket of at least ``seconds`` sees all that it needs. The count is
    that of all events so far in the bucket without those that are too old: both
    only grow along the window, where a sliding one is counted anew for each event.
    """
    at = F.col(ts).cast("timestamp").cast("long")
    extra = extra or []
    e = events.select(key, ts, *extra, at.alias("_s"), bucket.alias("_b"))
    shared = e.withColumn("_own", F.lit(True)).unionByName(e.where("_b is not null").withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(key, "_b").orderBy("_s")
    upto = lambda end: F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, end))
    # events without a time are in a bucket of their own, where none is too old
    recent = upto(0) - F.when(F.col("_s").isNull(), 0).otherwise(upto(-seconds - 1))
    return shared.withColumn("n_recent", recent).where("_own").select(key, ts, *extra, "n_recent")


def calibration_fold(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, n, calibrated: half of what was known and half of each new value, in order.

    The fold is a weighted sum with powers of two, so it is an aggregate over
    ranks from the end; values over 60 places back weigh less than 2^-60 and are
    not ranked.
    """
    known = rows.where(F.col(value).isNotNull())
    n = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the limit on the rank is kept before and after the shuffle, so a long history is never sorted whole in one task
    last = known.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_rank <= 61").withColumn("_back", F.col("_rank") - 1)
    weight = F.when(F.col("_back") == F.col("n") - 1, F.pow(F.lit(0.5), F.col("_back"))).otherwise(F.pow(F.lit(0.5), F.col("_back") + 1))
    return last.join(n, key).groupBy(key).agg(F.first("n").alias("n"), F.sum(F.col(value) * weight).alias("calibrated"))


def derived_status(rows: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds names the status."""
    out = F.when(rules[0][0], rules[0][1])
    for cond, name in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


def weighted_picks(items: DataFrame, ident: str, weight: str, draws: DataFrame, per_band: int = 1_024) -> DataFrame:
    """draw, ident: for each draw(draw, at) the item in whose share of the running weight it falls.

    Items stand in the order of ident, a long, and weights are whole numbers, so
    sums are exact. Running sums are taken inside bands of ``per_band`` ids, with
    the bands before added; the scale of weights is cut into cells, and an item
    is listed in those that it covers, so a draw finds it by its cell.
    """
    i = items.select(F.col(ident).alias("item"), F.col(weight).cast("long").alias("w")).where("w > 0").withColumn("band", F.floor(F.col("item") / per_band))
    b = i.groupBy("band").agg(F.sum("w").alias("bw"))
    b = b.select("band", F.coalesce(F.sum("bw").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each band
    cell = int(i.agg(F.coalesce(F.avg("w"), F.lit(1.0))).first()[0] * 16) + 1
    run = F.sum("w").over(Window.partitionBy("band").orderBy("item").rowsBetween(Window.unboundedPreceding, 0))
    r = i.withColumn("inside", run).join(b, "band").withColumn("to", F.col("before") + F.col("inside")).withColumn("from", F.col("to") - F.col("w"))
    r = r.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))))
    d = draws.select("draw", "at", F.floor(F.col("at") / cell).alias("cell"))
    return d.join(r, "cell").where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))).select("draw", F.col("item").alias(ident))


def carried_decisions(decisions: DataFrame, names: DataFrame) -> DataFrame:
    """decisions(a, b, verdict) with kept: whether both names are still in names(name)."""
    n = names.select("name").distinct()
    d = decisions.join(n.select(F.col("name").alias("a"), F.lit(True).alias("_a")), "a", "left").join(n.select(F.col("name").alias("b"), F.lit(True).alias("_b")), "b", "left")
    return d.withColumn("kept", F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")


def replaced(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """rows, with all of a key's rows replaced by those of fresh, where that has any."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def interrupted(runs: DataFrame, key: str, ts: str, kind: str, started: str, ended: list[str]) -> DataFrame:
    """key, last, interrupted: runs whose latest start has no end at or after it."""
    g = runs.groupBy(key).agg(F.max(F.when(F.col(kind) == started, F.col(ts))).alias("began"), F.max(F.when(F.col(kind).isin(ended), F.col(ts))).alias("over"), F.max(ts).alias("last"))
    return g.select(key, "last", (F.col("began").isNotNull() & (F.col("over").isNull() | (F.col("over") < F.col("began")))).alias("interrupted"))
