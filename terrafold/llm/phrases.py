"""Phrases that occur together: collocations from a weighted de Bruijn graph.

Texts are cut into pieces and words. A node is a pair of words, an edge a run of
three: from its first pair to its second. Edges are aggregated over the corpus;
pairs are not counted, but derived from the flow out of their node, with a
correction for pairs at which a piece ends. Edges that occur often enough form a
graph, whose unary paths (nodes with one way in and one way out) are compacted,
so that a pair inside a path is measured by its neighbours in the path, and only
the ends of paths are aggregated by node.

Batches of texts keep their tokens, numbered in the batch, in the shared folder
and send their words; words that occur often enough get numbers for the whole
corpus, by falling frequency, and each batch gets the numbers of its own words.
A rarer word is in no phrase that counts, and ends a piece. Batches send their
edges packed, to a bucket by the edge's first pair, or by the whole edge where
both words of that pair are so frequent that a bucket might not hold its edges.

Inside a batch words are told apart by a 64-bit hash, elsewhere by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.chains import ranked_chains

from .common import stored, table
from .shingles import joined_arrays, mixed, pack, parts_of, unpack

MIN_COUNT, TOP, SHARE = 10, 2000, 50
#: Bytes of a batch, and edges in a bucket, about.
BATCH_BYTES, BUCKET_EDGES = 1 << 23, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[list(b" \t")] = True


def words_in_pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts with A-Z in lower case, each word's start, end and hash, and the number of its piece (never falling)."""
    data = b"\n".join(texts).translate(_LOWER)
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_OUTSIDE[b]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if not len(starts):
        return data, starts, ends, np.empty(0, np.uint64), starts
    lengths = ends - starts
    letters = b[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _PRIME)]).astype(np.uint64))
    hashes = mixed(np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(first, lengths)], first) + lengths.astype(np.uint64))
    return data, starts, ends, hashes, np.cumsum(_ENDS[b])[starts]


def _squeezed(a: np.ndarray, kind: type) -> np.ndarray:
    """Integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return np.frombuffer(zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1), np.uint8)


def _restored(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def token_batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """batch, lang, words, counts, tokens of docs(lang, text), for each batch its distinct words, how often each occurs, and all tokens in order."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[list[bytes], int]] = {}

        def one(lang: str, texts: list[bytes]) -> pd.DataFrame:
            nonlocal number
            number += 1
            data, starts, ends, hashes, piece = words_in_pieces(texts)
            _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            new = np.diff(piece, prepend=-1) > 0
            tokens = joined_arrays(_squeezed(back, np.uint32), _squeezed(new, np.uint8))
            return pd.DataFrame({"batch": [number], "lang": [lang], "words": [words], "counts": [n.tolist()], "tokens": [tokens]})

        for f in frames:
            for lang, text in zip(f.lang, f.text):
                texts, size = held.setdefault(lang, ([], 0))
                texts.append(text.encode("utf-8", "replace"))
                held[lang] = texts, size + len(texts[-1])
                if held[lang][1] >= batch_bytes:
                    yield one(lang, held.pop(lang)[0])
                elif sum(s for _, s in held.values()) >= 4 * batch_bytes:  # many languages: the largest goes
                    most = max(held, key=lambda x: held[x][1])
                    yield one(most, held.pop(most)[0])
        for lang, (texts, _) in held.items():
            yield one(lang, texts)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "batch long, lang string, words array<string>, counts array<long>, tokens binary")


def numbered_words(counted: DataFrame) -> DataFrame:
    """counted(lang, word, n) with id: from 0, by falling n. The order is Spark's range partitioning, written once."""
    order = [F.col("n").desc(), F.col("lang"), F.col("word")]
    rows = stored(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "words")
    parts = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = parts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, F.shiftright("at", 33) == F.col("part")).select("lang", "word", "n", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys, sorted by the first, then the next, and the sum of n for each."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(n), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n[order], at)


def phrase_counts(batches: DataFrame, words: DataFrame, least: int = MIN_COUNT, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """a, b, c, n: how often pairs (c is -1) and runs of three numbered words occur in the pieces of stored batches, where that is ``least`` times."""
    sizes = words.agg(F.count(F.lit(1)).alias("known"), F.count(F.when(F.col("n") >= bucket_edges, 1)).alias("hot"), F.sum("n").alias("all")).first()
    known, hot, buckets = max(1, sizes["known"]), sizes["hot"], max(1, (sizes["all"] or 0) // bucket_edges)
    own = batches.select("batch", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    told = own.groupBy("batch").agg(F.collect_list(F.struct("at", "id")).alias("t")).select("batch", F.col("t.at").alias("at"), F.col("t.id").alias("id"))
    v = np.uint64(known)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob, at, number in zip(f.tokens, f["at"], f["id"]):
                parts = parts_of(bytes(blob))
                tokens, new = _restored(parts[0], np.uint32), _restored(parts[1], np.uint8).astype(bool)
                if len(tokens) < 2:
                    continue
                ids = np.full(int(tokens.max()) + 1, -1, np.int64)
                ids[np.asarray(at, np.int64)] = np.asarray(number, np.int64)
                w = ids[tokens]
                pair = (w[:-1] >= 0) & (w[1:] >= 0) & ~new[1:]
                run = np.append(pair[:-1] & pair[1:], False)
                node = w[:-1].astype(np.uint64) * v + w[1:].astype(np.uint64)
                third = np.append(w[2:], -1)
                # an edge for each run, and a correction for each pair that nothing follows in its piece
                node, third, hot_node = node[pair], np.where(run, third, -1)[pair], ((w[:-1] < hot) & (w[1:] < hot))[pair]
                spread = np.where(hot_node & (third >= 0), mixed(third.astype(np.uint64) + np.uint64(1)), np.uint64(0))
                bucket = mixed(mixed(node) ^ spread) % np.uint64(buckets)
                (bucket, node, third), n = _summed([bucket, node, third], np.ones(len(node), np.int64))
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
                rows = [(int(bucket[i]), joined_arrays(np.frombuffer(pack(node[i:j]), np.uint8), _squeezed(third[i:j] + 1, np.uint64), _squeezed(n[i:j], np.uint32))) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])]
                yield pd.DataFrame(rows, columns=["bucket", "blob"])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        got = [parts_of(bytes(b)) for b in g.blob]
        node, third, n = np.concatenate([unpack(p[0]) for p in got]), np.concatenate([_restored(p[1], np.uint64) for p in got]).astype(np.int64) - 1, np.concatenate([_restored(p[2], np.uint32) for p in got]).astype(np.int64)
        (node, third), n = _summed([node, third], n)
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        flow, of = np.add.reduceat(n, at), node[at]
        often = (flow >= least) | ((of // v < np.uint64(hot)) & (of % v < np.uint64(hot)))  # parts of a hot node's flow are in other buckets
        edge = (third >= 0) & (n >= least)
        nodes = np.concatenate([node[edge], of[often]])
        return pd.DataFrame({"a": (nodes // v).astype(np.int64), "b": (nodes % v).astype(np.int64), "c": np.concatenate([third[edge], np.full(int(often.sum()), -1)]), "n": np.concatenate([n[edge], flow[often]])})

    sent = batches.select("batch", "tokens").join(told, "batch").select("tokens", "at", "id").mapInPandas(send, "bucket long, blob binary")
    met = stored(sent.groupBy("bucket").applyInPandas(meet, "a long, b long, c long, n long"), "phrases")
    pairs = met.where("c < 0").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return met.where("c >= 0").unionByName(pairs)


def compact_paths(edges: DataFrame) -> DataFrame:
    """edges(a, b, c, n) with e, path, pos and last: the unary path of each, its place in it, and whether it ends it.

    A node with one edge in and one out is inside a path; a path that comes back
    to itself is cut at one node.
    """
    edges = stored(edges.withColumn("e", F.monotonically_increasing_id()), "edges")
    into = edges.groupBy(F.col("b").alias("x"), F.col("c").alias("y")).agg(F.count(F.lit(1)).alias("in"), F.max("e").alias("prev"))
    out = edges.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count(F.lit(1)).alias("out"), F.max("e").alias("item"))
    inner = into.where("in = 1").join(out.where("out = 1"), ["x", "y"]).select("item", "prev")
    chains = stored(ranked_chains(edges.select(F.col("e").alias("item")).join(inner, "item", "left")), "chains")
    ends = chains.groupBy("head").agg(F.max("pos").alias("end"))
    return edges.join(chains.join(ends, "head").select(F.col("item").alias("e"), F.col("head").alias("path"), "pos", (F.col("pos") == F.col("end")).alias("last")), "e")


def heaviest_edges(paths: DataFrame) -> DataFrame:
    """a, b, most: for each node of compacted paths its largest edge; pairs inside a path from their two neighbours, others from the ends of paths."""
    after = paths.select("path", (F.col("pos") - 1).alias("pos"), F.col("n").alias("next"))
    inside = paths.join(after, ["path", "pos"]).select(F.col("b").alias("a"), F.col("c").alias("b"), F.greatest("n", "next").alias("most"))
    ends = paths.where("pos = 0").select("a", "b", "n").unionByName(paths.where("last").select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    return inside.unionByName(ends.groupBy("a", "b").agg(F.max("n").alias("most")))


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, share: int = SHARE, batch_bytes: int = BATCH_BYTES, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two and three words of each lang of docs(lang, text).

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n
    all words of the lang. Pairs of which ``share`` % lie in one longer phrase that occurs
    ``least`` times are dropped. Null texts are empty, a null lang is und; rows
    count each, repeated ones too; an empty table gives no rows.
    """
    batches = stored(token_batches(docs, batch_bytes), "batches")
    counted = batches.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    counted = stored(counted, "counted")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = stored(numbered_words(counted.where(F.col("n") >= least)), "numbered")
    phrases = stored(phrase_counts(batches, words, least, bucket_edges), "counts")
    pairs, edges = phrases.where("c < 0").select("a", "b", "n"), phrases.where("c >= 0")
    heavy = heaviest_edges(stored(compact_paths(edges), "paths"))

    word = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"w{c}"), F.col("n").alias(f"n{c}"), *([F.col("lang")] if c == "a" else []))
    part = lambda x, y: pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n{x}{y}"))
    cut = lambda left, right: F.struct(_score("n", left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    left = pairs.join(heavy, ["a", "b"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("n")))
    twos = left.join(word("a"), "a").join(word("b"), "b").select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("n").alias("a"), cut("na", "nb").alias("k"))
    threes = edges.join(part("a", "b"), ["a", "b"]).join(part("b", "c"), ["b", "c"]).join(word("a"), "a").join(word("b").drop("nb"), "b").join(word("c"), "c")
    first, second = cut("na", "nbc"), cut("nab", "nc")
    threes = threes.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("n").alias("a"), F.when(first["score"] <= second["score"], first).otherwise(second).alias("k"))
    found = twos.unionByName(threes).select("lang", "phrase", "a", "k.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact: products of up to 38 digits, of counts with up to 15. It is 1000000 at most."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def op12_phrases(spark, sf_dir):
    """The collocations of each lang of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g1 AS (
  SELECT lang, unnest(ws) AS w1 FROM w
), f1 AS (
  SELECT lang, w1 AS phrase, count(*) AS f FROM g1 GROUP BY ALL
), g AS (
  SELECT lang, k, unnest([ws[i:i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS q FROM w, (SELECT unnest([2, 3]) AS k) WHERE len(ws) >= k
), c AS (
  SELECT lang, q, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10
), f AS (
  SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, array_to_string(q, ' '), a FROM c
), cuts AS (
  SELECT lang, q, k, a, j, array_to_string(q[1:j], ' ') AS lp, array_to_string(q[j + 1:k], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k
), s AS (
  SELECT cuts.lang, q, k, a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, q ORDER BY score, j) = 1
), inside AS (
  SELECT lang, x AS q, max(a) AS most FROM (SELECT lang, unnest([q[1:2], q[2:3]]) AS x, a FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM b LEFT JOIN inside USING (lang, q) WHERE b.k = 3 OR most IS NULL OR 100 * most < 50 * b.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(q, ' ')) AS rank, array_to_string(q, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
