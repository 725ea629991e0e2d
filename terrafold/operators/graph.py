"""Graph operators over edge tables: components, support, disagreement."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.ranking import both_ends
from terrafold.session import checkpoint_folder

#: Edges between two bands of nodes, and paths of two edges that are looked at together, about.
EDGES, _AT_ONCE = 1 << 20, 1 << 20


def written(df: DataFrame) -> DataFrame:
    """df through Parquet in the folder that the cluster shares (spark.checkpoint.dir), which cuts its lineage."""
    path = f"{checkpoint_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for edges(a, b).

    In each round a node takes the smallest label around it and then that
    label's own label, so the number of rounds grows with the logarithm of the
    longest path. Rounds end when no label changes.
    """
    both = written(both_ends(edges.where("a != b")).select(F.col("node").alias("a"), F.col("partner").alias("b")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    changed = True
    while changed:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = low.join(labels.select(F.col("node").alias("low"), F.col("component").alias("next")), "low", "left")
        new = written(jump.select("node", F.least("low", F.coalesce("next", "low")).alias("new"), "component"))
        changed = new.where("new != component").limit(1).count() > 0
        labels = new.select("node", F.col("new").alias("component"))
    return labels


def component_areas(components: DataFrame, areas: DataFrame, least: float) -> DataFrame:
    """component, n_nodes, area, kept: areas(node, area) summed; components under ``least`` are dropped (kept is false)."""
    g = components.join(areas, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("area").alias("area"))
    return g.withColumn("kept", F.col("area") >= least)


def _packed(x: np.ndarray) -> tuple[bytes, bytes, int]:
    """Distinct values, each row's number among them, and that number's width."""
    values, code = np.unique(x, return_inverse=True)
    width = next(w for w in (1, 2, 4, 8) if len(values) <= 256**w)
    return values.tobytes(), code.astype(f"u{width}").tobytes(), width


@dataclass(frozen=True)
class _Block:
    """The edges between two bands, sorted by their ends: distinct ends, numbers among them, and shifts."""

    ps: np.ndarray
    p: np.ndarray
    qs: np.ndarray
    q: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, r: dict) -> _Block:
        numbers = lambda k: np.frombuffer(r[k], f"u{int(r[f'{k}_width'])}")
        return cls(np.frombuffer(r["ps"], np.int64), numbers("p").astype(np.int64), np.frombuffer(r["qs"], np.int64), numbers("q").astype(np.int64), np.frombuffer(r["ss"], float)[numbers("s")])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each value's place among the sorted known ones, or -1."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _closed(pq: _Block, pr: _Block, qr: _Block, tol: float | None) -> list[np.ndarray]:
    """For each edge of three blocks, in how many triangles p < q < r of an edge of each it stands; with ``tol``, those whose shifts meet."""
    counts = [np.zeros(len(b.p), np.int64) for b in (pq, pr, qr)]
    r_of = _among(pr.qs, qr.qs)[pr.q]
    second = np.flatnonzero(r_of >= 0)  # edges p, r whose r some q has too; sorted by p
    first = np.searchsorted(pr.p[second], np.arange(len(pr.ps) + 1))
    begins = np.searchsorted(qr.p, np.arange(len(qr.ps) + 1))
    p, q = _among(pq.ps, pr.ps)[pq.p], _among(pq.qs, qr.ps)[pq.q]
    edge = np.flatnonzero((p >= 0) & (q >= 0))
    edge = edge[np.argsort(q[edge], kind="stable")]
    p, q = p[edge], q[edge]
    many = first[p + 1] - first[p]
    heads = np.flatnonzero(np.diff(q, prepend=-1))  # where another q begins
    ends = np.append(heads[1:], len(q))
    paths = np.concatenate([[0], np.cumsum(many)])
    upto, rows = paths[ends], max(1, _AT_ONCE // len(qr.qs))
    seen = np.zeros((rows, len(qr.qs)), np.int32)  # the edge from q to r, counted from 1
    at = 0
    while at < len(heads):
        to = int(np.searchsorted(upto, paths[heads[at]] + _AT_ONCE, "right"))
        to = min(max(to, at + 1), at + rows, len(heads))
        lo, hi = heads[at], ends[to - 1]
        known = np.arange(begins[q[lo]], begins[q[hi - 1] + 1])
        row = np.repeat(np.arange(to - at), ends[at:to] - heads[at:to])
        row_of = np.full(q[hi - 1] - q[lo] + 1, -1)
        row_of[q[heads[at:to]] - q[lo]] = np.arange(to - at)
        known = known[row_of[qr.p[known] - q[lo]] >= 0]
        cell = row_of[qr.p[known] - q[lo]], qr.q[known]
        seen[cell] = known + 1
        n = many[lo:hi]
        j = second[np.repeat(first[p[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        k = seen[np.repeat(row, n), r_of[j]]
        hit = np.flatnonzero(k)
        i, j, k = np.repeat(edge[lo:hi], n)[hit], j[hit], k[hit] - 1
        seen[cell] = 0
        met = [np.ones(len(hit), bool)] * 3
        if tol is not None:
            a, b, c = pq.s[i], pr.s[j], qr.s[k]
            met = [np.abs(b - c - a) <= tol, np.abs(a + c - b) <= tol, np.abs(b - a - c) <= tol]
        for count, which, ok in zip(counts, (i, j, k), met):
            np.add.at(count, which[ok], 1)
        at = to
    return counts


def support_counts(best: DataFrame, tol: float | None = None, most: int = EDGES) -> DataFrame:
    """a, b, support: nodes x for which (a, x) and (x, b) are edges too.

    With ``tol``, x counts only where the path over x places b within tol of
    where the edge does (its shift, from a to b with a < b). Edges are distinct, and read twice.

    Nodes are dealt to bands, so that about ``most`` edges lie between two of them;
    those are one packed row. The edges of a triangle lie in the rows of three bands,
    so three rows meet for each three bands. Every triangle is found once, and counts
    for all its edges. What is shuffled grows with the edges and the number of bands,
    which grows with the square root of the edges: never with paths of two edges.
    """
    kind = dict(best.dtypes)["a"]
    shift = F.col("shift").cast("double") if tol is not None else F.lit(0.0)
    e = best.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), shift.alias("s"))
    degree = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    ends, hub = degree.agg(F.sum("c"), F.max("c")).first()  # one row
    # a node's edges to one band are bounded too
    bands = math.ceil(max(1, math.sqrt((ends or 0) / most), (hub or 0) / most))
    band = lambda c: F.pmod(F.xxhash64(c), F.lit(bands)).cast("int")
    turned = F.struct(band("b"), "b") < F.struct(band("a"), "a")
    low, high = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    dealt = e.select(low.alias("p"), high.alias("q"), F.when(turned, -F.col("s")).otherwise(F.col("s")).alias("s"), turned.alias("turned")).withColumns({"i": band("p"), "j": band("q")})

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["p", "q"])
        row = {"i": key[0], "j": key[1], "turned": np.packbits(g.turned.to_numpy()).tobytes()}
        for c in "pqs":
            row[f"{c}s"], row[c], row[f"{c}_width"] = _packed(g[c].to_numpy())
        return pd.DataFrame([row])

    fields = "i int, j int, turned binary, ps binary, p binary, p_width int, qs binary, q binary, q_width int, ss binary, s binary, s_width int"
    blocks = written(dealt.groupBy("i", "j").applyInPandas(pack, fields))
    third = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("k")
    trios = blocks.drop("turned").select("*", third).withColumn("trio", F.array_sort(F.array("i", "j", "k"))).drop("k")

    def count(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        of = {(r["i"], r["j"]): _Block.of(r) for r in g.to_dict("records")}
        i, j, k = (int(x) for x in key[0])
        names, out = ((i, j), (i, k), (j, k)), []
        if set(names) <= set(of):
            for (x, y), n in zip(names, _closed(*[of[b] for b in names], tol)):
                if n.any():
                    width = next(w for w in (1, 2, 4, 8) if n.max() < 256**w)
                    out.append((x, y, n.astype(f"u{width}").tobytes(), width))
        return pd.DataFrame(out, columns=["i", "j", "n", "n_width"])

    parts = trios.repartition(min(bands * (bands + 1) * (bands + 2) // 6, 4096), "trio").groupBy("trio").applyInPandas(count, "i int, j int, n binary, n_width int")

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        rows = g.to_dict("records")
        whole = next(r for r in rows if r["n"] is None)
        b = _Block.of(whole)
        n = np.zeros(len(b.p), np.int64)
        for r in rows:
            if r["n"] is not None:
                n += np.frombuffer(r["n"], f"u{int(r['n_width'])}")
        turned = np.unpackbits(np.frombuffer(whole["turned"], np.uint8), count=len(n)).astype(bool)
        p, q = b.ps[b.p], b.qs[b.q]
        return pd.DataFrame({"a": np.where(turned, q, p), "b": np.where(turned, p, q), "support": n})

    both = blocks.unionByName(parts, allowMissingColumns=True)
    out = both.groupBy("i", "j").applyInPandas(summed, "a long, b long, support long")
    return out.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "support")


def disagreeing_edges(best: DataFrame, limit: float) -> DataFrame:
    """node, p, q, gap: two edges of a node whose values (seam) differ by more than ``limit``."""
    e = both_ends(best, "seam")
    x, y = e.alias("x"), e.alias("y")
    gap = F.abs(F.col("x.seam") - F.col("y.seam"))
    j = x.join(y, F.col("x.node") == F.col("y.node")).where((F.col("x.partner") < F.col("y.partner")) & (gap > limit))
    return j.select(F.col("x.node").alias("node"), F.col("x.partner").alias("p"), F.col("y.partner").alias("q"), gap.alias("gap"))
