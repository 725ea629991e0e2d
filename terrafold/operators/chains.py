"""Chains of linked items: their heads and positions by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.graph import written


def ranked_chains(links: DataFrame) -> DataFrame:
    """item, head, pos, closed for links(item, prev), where prev is null at a head.

    Items are unique, and no two have the same prev; each prev is an item. A
    chain's pos counts from 0 at its head. A closed chain (a ring) is cut before
    its smallest item, which is its head. In a round each item looks twice as far
    back as before, so rounds grow with the logarithm of the longest chain. An
    item that finds itself as the smallest behind it closes a ring, and when all
    items left see such a one, only rings are left.
    """
    first = F.col("prev").isNull()
    links = written(links.select("item", "prev"))
    # low is the smallest item behind, and null for items whose way has ended at their head
    state = links.select("item", F.coalesce("prev", "item").alias("up"), F.when(first, 0).otherwise(1).cast("long").alias("dist"), F.col("prev").alias("low"))
    rings = None
    while True:
        state = written(state)
        left = state.agg(F.count("low").alias("open"), F.count_if(F.col("low") == F.col("item")).alias("ends")).first()
        if not left["open"]:
            break
        todo = state.where("low is not null")
        if left["ends"]:
            ends = todo.where("low = item").select(F.col("item").alias("low"))
            if todo.join(ends, "low", "left_anti").isEmpty():
                cut = ends.select(F.col("low").alias("item"), F.lit(True).alias("cut"))
                rings = links.join(todo.select("item"), "item").join(cut, "item", "left").select("item", F.when(F.col("cut").isNull(), F.col("prev")).alias("prev"))
                break
        back = state.select(F.col("item").alias("up"), F.col("up").alias("far"), F.col("dist").alias("more"), F.col("low").alias("behind"))
        step = todo.join(back, "up").select("item", F.col("far").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.when(F.col("behind").isNotNull(), F.least("low", "behind")).alias("low"))
        state = step.unionByName(state.where("low is null"))
    out = state.where("low is null").select("item", F.col("up").alias("head"), F.col("dist").alias("pos"), F.lit(False).alias("closed"))
    if rings is not None:
        out = out.unionByName(ranked_chains(rings).withColumn("closed", F.lit(True)))
    return out
