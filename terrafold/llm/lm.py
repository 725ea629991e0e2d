"""Language-model scoring by online logistic context mixing.

A first pass over the training documents counts words, bytes and pieces; the most
frequent pieces become symbols of the code. A second pass counts bits: those of
each node of the code tree, and those in hashed contexts, in tables whose size
follows the training text up to SLOT_BITS. They go to all tasks.

Guesses at whole symbols grow with the corpus: every training document tells what
followed each of its contexts (known by a hash of the pieces before).
Batches of documents send these, packed, to buckets by hash, together with the
contexts that only held-out documents have, and get back what most often came
after each. A training document's own occurrence is taken off wherever it is
scored, so documents are scored apart by what the rest of the corpus knows.

The weights that documents begin with are fitted by Newton's method on a tally of
the bits of all training documents, each predicted without its own occurrence.
Word counts grow with the corpus too: the most frequent words, whose number is bounded, are looked up while a
document is scored, and its other words are joined with their counts by a
shuffle. Words, pieces and contexts are known by hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bitmix import END, CELLS, GUESS_BITS, HASHED, Code, _WORD, count_bits, fitted_weights, piece_hashes, pieces, plain_odds, score_texts, squeezed, tally
from .common import stored, table
from .shingles import joined_arrays, pack, parts_of, unpack, word_hashes

#: Words that all tasks get with their counts, and slots of the table that holds them.
FREQUENT, FREQUENT_BITS = 131_072, 20
#: The end of a text, among the hashes of words.
END_WORD = np.uint64(0x5BD1E9955BD1E995)
#: Pieces that are symbols of the code, and bits of the hashed tables' slots, at most; both are broadcast.
PIECES, SLOT_BITS = 131_072, 22
#: Bytes of a batch that sends contexts, and contexts in a bucket, about.
BATCH_BYTES, BUCKET_CONTEXTS = 1 << 22, 1_000_000
#: Words or pieces in a bucket, and those that a task gathers before it sends them, about.
BUCKET_TOKENS, TOKENS_AT_ONCE = 2_000_000, 1_500_000
#: While documents are read and scored. Rows come to Python in small batches. Workers are told apart by their
#: environment, which the form of tracebacks is part of: with it off, functions on DataFrames and on RDDs run in the
#: same workers. Else each core has two of them, of which the idle one keeps what it last held.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "false"}
_RANGE = 1 << 16
_COUNT_BYTES, _SCORE_BYTES, _TALLY_BYTES = 1 << 20, 1 << 18, 1 << 20
_SUMMED_AT_ONCE, _MERGED_AT_ONCE = 64, 8


@contextmanager
def one_kind_of_worker(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold; then those that the session had before. Stages that an RDD's action runs see a thread's properties only."""
    context = spark.sparkContext
    before, local = spark.conf.getAll, {k: context.getLocalProperty(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
        context.setLocalProperty(k, v)
    try:
        yield
    finally:
        for k in SETTINGS:
            context.setLocalProperty(k, local[k])
            if k in before:
                spark.conf.set(k, before[k])
            else:
                spark.conf.unset(k)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id counts as an empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _batches(texts, most: int) -> Iterator[list[bytes]]:
    """The texts, which are strings, bytes or absent, as bytes in lists of about ``most`` bytes."""
    out, size = [], 0
    for t in texts:
        out.append(t if isinstance(t, bytes) else t.encode() if t else b"")
        size += len(out[-1])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def token_counts(train: DataFrame) -> DataFrame:
    """kind, id, n, size: how often each byte (kind 0; END for the end), word (kind 1; END_WORD for the end) and piece of several bytes (kind 2; size bytes long; those that occur twice) occurs.

    What a task has gathered is sent packed, to buckets by hash.
    """
    size = train.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // 5 // BUCKET_TOKENS)
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, gathered = np.zeros(257, np.int64), {1: [], 2: []}
        for texts in _batches((t for f in frames for t in f.text), _COUNT_BYTES):
            data, starts, lengths, _ = pieces(texts)
            total[:256] += np.bincount(data, minlength=256)
            total[END] += len(texts)
            gathered[1].append((*np.unique(word_hashes(texts)[0], return_counts=True), None))
            long = lengths > 1
            gathered[2].append(_summed(piece_hashes(data, starts, lengths)[long], np.ones(int(long.sum()), np.int64), lengths[long]))
            for kind, got in gathered.items():
                if len(got) >= _MERGED_AT_ONCE:
                    got[:] = [_merged(got)]
                    if len(got[0][0]) >= TOKENS_AT_ONCE:
                        yield sent(kind, got)
        gathered[1].append((np.array([END_WORD]), total[END:], None))
        yield pd.DataFrame([(0, 0, joined_arrays(total))], columns=["kind", "bucket", "blob"])
        for kind, got in gathered.items():
            if got:
                yield sent(kind, got)

    def sent(kind: int, got: list) -> pd.DataFrame:
        """What has been gathered, which is empty then."""
        h, n, size = _merged(got)
        got.clear()
        at, rows = np.searchsorted(h, cuts), []
        for k, parts in enumerate(zip(*(np.split(x, at) for x in ((h, n) if kind == 1 else (h, n, size))))):
            if len(parts[0]):
                rows.append((kind, k, joined_arrays(np.frombuffer(pack(parts[0]), np.uint8), *(np.frombuffer(_squash(x), np.uint8) for x in parts[1:]))))
        return pd.DataFrame(rows, columns=["kind", "bucket", "blob"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        kind, got = int(g.kind.iloc[0]), [parts_of(bytes(b)) for b in g.blob]
        if kind == 0:
            n = sum(np.frombuffer(p[0], np.int64) for p in got)
            at = np.flatnonzero(n)
            return pd.DataFrame({"kind": 0, "id": at, "n": n[at], "size": 0})
        h, n = np.concatenate([unpack(p[0]) for p in got]), np.concatenate([_unsquash(p[1]) for p in got])
        h, n, size = _summed(h, n, np.concatenate([_unsquash(p[2]) for p in got]) if kind == 2 else None)
        use = n > kind - 1
        return pd.DataFrame({"kind": kind, "id": h[use].view(np.int64), "n": n[use], "size": 0 if size is None else size[use]})

    rows = train.select("text").mapInPandas(count, "kind int, bucket long, blob binary")
    return rows.groupBy("kind", "bucket").applyInPandas(add, "kind int, id long, n long, size long")


def _summed(h: np.ndarray, n: np.ndarray, size: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct hashes in order, the sums of their numbers, and the size of each."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(n[order], new).astype(np.int64) if len(new) else np.empty(0, np.int64), None if size is None else size[order][new]


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """_summed() of several."""
    return _summed(*(np.concatenate([p[k] for p in parts]) if parts[0][k] is not None else None for k in range(3)))


def symbol_code(counts: DataFrame, most: int = PIECES) -> tuple[Code, int]:
    """The code, and the number of training bytes: 257 byte counts and the ``most`` most frequent pieces that occur twice come to the driver.

    Bytes of words count for the share of them that no such piece covers.
    """
    n = np.zeros(257, np.float64)
    for r in counts.where("kind = 0").select("id", "n").collect():
        n[r["id"]] = r["n"]
    total = int(n[:256].sum())
    p = counts.where("kind = 2 and n > 1").orderBy(F.desc("n"), "id").limit(most).select("id", "n", "size").toPandas()
    words = np.append(_WORD, False)
    words[32] = True
    n[words] *= max(0.001, 1 - float((p["n"] * p["size"]).sum()) / max(1.0, n[words].sum()))
    weights = np.concatenate([n, p["n"].to_numpy(float)])
    weights = weights * min(1.0, 2.0**40 / max(1.0, weights.sum()))  # keeps codes under 64 bits long
    return Code(weights.astype(np.int64), p["id"].to_numpy(np.int64).view(np.uint64)), total


def frequent_words(counts: DataFrame, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, and log10(count + 0.1)."""
    rows = counts.where("kind = 1").orderBy(F.desc("n"), "id").limit(frequent).select("id", "n").toPandas()
    return rows["id"].to_numpy(np.int64).view(np.uint64), np.log10(rows["n"].to_numpy(float) + 0.1)


def word_table(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of both by the hash's first bits; a word whose slot is taken is left out."""
    slot, first = np.unique(h >> np.uint64(64 - FREQUENT_BITS), return_index=True)
    hashes, logs = np.zeros(1 << FREQUENT_BITS, np.uint64), np.zeros(1 << FREQUENT_BITS)
    hashes[slot.astype(np.int64)], logs[slot.astype(np.int64)] = h[first], known[first]
    return hashes, logs


def slot_bits(train_bytes: int, most: int = SLOT_BITS) -> int:
    return min(most, max(16, math.ceil(math.log2(max(1, 2 * train_bytes)))))


class Model:
    """The code, the log odds of its nodes and the tables; the tables are sent compressed."""

    def __init__(self, code: Code, plain: np.ndarray, tables: list[np.ndarray]):
        self.parts = code, plain, tables

    def __getstate__(self) -> tuple:
        code, plain, tables = self.parts
        return code, plain, [zstandard.compress(t.view(np.uint8).reshape(-1, 2).T.tobytes(), 3) for t in tables]

    def __setstate__(self, state: tuple):
        code, plain, tables = state
        self.parts = code, plain, [np.ascontiguousarray(np.frombuffer(zstandard.decompress(t), np.uint8).reshape(2, -1).T).view(np.uint16).ravel() for t in tables]


def bit_tables(train: DataFrame, shared, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of the tree's nodes, and squeezed counts of the hashed tables' slots, from all training documents; shared is the code, broadcast.

    Each task counts into full tables and sends them in compressed ranges. What
    sums a range gets it from a bounded number of tasks, and passes it on.
    """
    nodes = shared.value.nodes

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = shared.value
        plain, hashed = np.zeros((2, nodes), np.int64), np.zeros((HASHED, 2, 1 << bits), np.uint32)
        for texts in _batches((t for f in frames for t in f.text), _COUNT_BYTES):
            count_bits(texts, code, plain, hashed)
        part = TaskContext.get().partitionId() // _SUMMED_AT_ONCE
        yield pd.DataFrame({"k": [-1], "r": [0], "part": [part], "blob": [_squash(plain)]})
        for k in range(HASHED):
            for r in range(0, 1 << bits, _RANGE):
                piece = hashed[k, :, r : r + _RANGE]
                if piece.any():
                    yield pd.DataFrame({"k": [k], "r": [r], "part": [part], "blob": [_squash(piece.astype(np.int64))]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int, int], np.ndarray] = {}
        for f in frames:
            for k, r, part, blob in zip(f.k, f.r, f.part, f.blob):
                t = _unsquash(blob)
                totals[k, r, part] = totals[k, r, part] + t if (k, r, part) in totals else t
        for (k, r, part), t in totals.items():
            yield pd.DataFrame({"k": [k], "r": [r], "part": [part // _SUMMED_AT_ONCE], "blob": [_squash(t)]})

    schema = "k int, r int, part long, blob binary"
    n = HASHED * max(1, (1 << bits) // _RANGE) + 1
    texts = train.select("text")
    tasks = texts.rdd.getNumPartitions()
    sent = texts.mapInPandas(count, schema)
    while True:
        sent = sent.repartition(n, "k", "r", "part").mapInPandas(add, schema)
        tasks = -(-tasks // _SUMMED_AT_ONCE)
        if tasks <= 1:
            break
    plain, tables = np.zeros((2, nodes), np.int64), [np.zeros(1 << bits, np.uint16) for _ in range(HASHED)]
    for row in sent.select("k", "r", "blob").collect():  # a range each: tables whose size is bounded
        t = _unsquash(row["blob"]).reshape(2, -1)
        if row["k"] < 0:
            plain = t
        else:
            tables[row["k"]][row["r"] : row["r"] + t.shape[1]] = squeezed(t[0], t[1])
    return plain_odds(plain), tables


def _squash(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _unsquash(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def guessed_batches(docs: DataFrame, code) -> DataFrame:
    """batch, blob: all that a batch of docs(doc_id, held_out, text) is scored from: its documents, and guesses for its contexts.

    code is broadcast. A context that only one batch has, once, comes back without
    a guess. Batches that send equal contexts send them once each.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // 5 // BUCKET_CONTEXTS)
    width = -(-(1 << GUESS_BITS) // buckets)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = code.value
        for number, _, _, train, texts in _document_batches(frames, BATCH_BYTES):
            c, said, owner = _of_batch(model, texts)
            key = (c << np.uint64(20)) | said.astype(np.uint64)
            learnt = train[owner]
            (key, n), new = np.unique(key[learnt], return_counts=True), np.unique(key[~learnt])
            key, n, _ = _summed(np.concatenate([key, new]), np.concatenate([n, np.zeros(len(new), np.int64)]), None)
            n = np.minimum(n, 65_535).astype(np.uint16)
            rows = []
            cuts = np.searchsorted(key >> np.uint64(20), np.arange(1, buckets, dtype=np.uint64) * np.uint64(width))
            for k, (t, m) in enumerate(zip(np.split(key, cuts), np.split(n, cuts))):
                if len(t):
                    rows.append((k, number, joined_arrays(np.frombuffer(pack(t >> np.uint64(20)), np.uint8), np.frombuffer(_squash((t & np.uint64((1 << 20) - 1)).astype(np.int64)), np.uint8), np.frombuffer(zstandard.compress(m.tobytes(), 1), np.uint8))))
            yield pd.DataFrame(rows, columns=["bucket", "batch", "blob"])

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The documents of each batch: the same rows in the same tasks make the same batches."""
        for number, numbers, known, train, texts in _document_batches(frames, BATCH_BYTES):
            blob = joined_arrays(np.frombuffer(b"d", np.uint8), numbers, known, train, np.array([len(t) for t in texts], np.int64), np.frombuffer(zstandard.compress(b"".join(texts), 3), np.uint8))
            yield pd.DataFrame({"batch": [number], "blob": [blob]})

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        got = [parts_of(bytes(b)) for b in g.blob]
        ctx = [unpack(p[0]) for p in got]
        counts = [np.frombuffer(zstandard.decompress(p[2]), np.uint16).astype(np.int64) for p in got]
        key = np.concatenate([(c << np.uint64(20)) | _unsquash(p[1]).view(np.uint64) for c, p in zip(ctx, got)])
        key, n, _ = _summed(key, np.concatenate(counts), None)
        of = key >> np.uint64(20)
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        total, top = np.add.reduceat(n, new), np.maximum.reduceat(n, new)
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(of))))
        best = np.flatnonzero(n == top[group])  # the most frequent successor, the smallest of equals
        best = best[np.diff(group[best], prepend=-1) > 0]
        names, guess = of[new], (key[best] & np.uint64((1 << 20) - 1)).astype(np.int64)
        top, total = np.minimum(top, 65_535), np.minimum(total, 65_535)
        rows = []
        for c, m, batch in zip(ctx, counts, g.batch):
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            own = np.add.reduceat(m, first)
            i = np.searchsorted(names, c[first])
            keep = (total[i] > 0) & ((total[i] > 1) | (own == 0))
            if keep.any():
                i = i[keep]
                rows.append((batch, joined_arrays(np.frombuffer(b"g", np.uint8), np.frombuffer(pack(names[i]), np.uint8), *(np.frombuffer(_squash(x[i]), np.uint8) for x in (guess, top, total)))))
        return pd.DataFrame(rows, columns=["batch", "blob"])

    number = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNotNull().alias("known"), "held_out", "text")
    met = rows.mapInPandas(send, "bucket long, batch long, blob binary").groupBy("bucket").applyInPandas(meet, "batch long, blob binary")
    # the documents come first: a task of the first part of a union has the number that it has alone
    return rows.mapInPandas(keep, "batch long, blob binary").unionByName(met)


def _document_batches(frames: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Number, ids, which ids are known, which documents are trained on, and texts of batches of about ``most`` bytes; how the rows came in frames doesn't matter."""
    columns: dict[str, np.ndarray] = {}

    def texts() -> Iterator:
        for f in frames:
            for c, kind in (("doc_id", np.int64), ("known", bool), ("held_out", bool)):
                columns[c] = np.concatenate([columns.get(c, np.empty(0, kind)), f[c].to_numpy(kind)])
            yield from f.text

    for number, own in enumerate(_batches(texts(), most), TaskContext.get().partitionId() << 30):
        ids, known, held = (c[: len(own)] for c in columns.values())
        columns.update({k: c[len(own) :] for k, c in columns.items()})
        yield number, ids, known, ~held, own


def _of_batch(code: Code, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of all pieces and ends, the symbols that follow, and the numbers of their texts."""
    out, base = [], 0
    i = 0
    while i < len(texts):  # about a megabyte at once
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _COUNT_BYTES):
            size += len(texts[j])
            j += 1
        part = texts[i:j]
        cut = code.cut(part)
        c, said, _ = code.guessed(part, cut)
        out.append((c, said, np.concatenate([cut[3], np.arange(len(part))]) + i))
        i = j
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def batches_of(rows: Iterator) -> Iterator[tuple[int, list, np.ndarray, list[bytes], tuple[np.ndarray, ...]]]:
    """Of rows in order of batch, each batch's number and contents."""
    for number, own in groupby(rows, key=lambda r: r["batch"]):
        yield number, *batch_contents(pd.DataFrame({"blob": [r["blob"] for r in own]}))


def batch_contents(g: pd.DataFrame) -> tuple[list, np.ndarray, list[bytes], tuple[np.ndarray, ...]]:
    """Ids (None where unknown), which documents were trained on, texts, and guesses: as in known_guesses()."""
    got = [parts_of(bytes(b)) for b in g.blob]
    d = [p for p in got if p[0] == b"d"]
    if not d:
        return [], np.empty(0, bool), [], ()
    numbers, known, train, sizes = (np.frombuffer(x, t) for x, t in zip(d[0][1:5], (np.int64, bool, bool, np.int64)))
    whole, ends = zstandard.decompress(d[0][5]), np.cumsum(sizes)
    texts = [whole[e - n : e] for e, n in zip(ends, sizes)]
    q = [p for p in got if p[0] == b"g"]
    ctx = np.concatenate([unpack(p[1]) for p in q]) if q else np.empty(0, np.uint64)
    rest = [np.concatenate([_unsquash(p[k]) for p in q]) if q else np.empty(0, np.int64) for k in (2, 3, 4)]
    return [int(x) if ok else None for x, ok in zip(numbers, known)], train, texts, known_guesses(ctx, *rest)


def known_guesses(ctx: np.ndarray, symbol: np.ndarray, top: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts in order, with one more than any; of each the symbol, how often and of how many, as one number; and where the contexts begin that share their first bits."""
    order = np.argsort(ctx, kind="stable")
    bits = min(GUESS_BITS, max(1, 2 * len(ctx)).bit_length())
    begin = np.cumsum(np.bincount((ctx >> np.uint64(GUESS_BITS - bits)).astype(np.int64), minlength=1 << bits))
    begin = np.concatenate([np.zeros(1, np.int32), begin[:-1].astype(np.int32)])
    said = (symbol[order] << 32) | (top[order] << 16) | total[order]
    return np.append(ctx[order], np.uint64(1 << GUESS_BITS)), np.append(said, 0), begin


def places_of(c: np.ndarray, ctx: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where ctx, as in known_guesses(), has c or the next one."""
    at = begin.take((c >> np.uint64(GUESS_BITS + 1 - len(begin).bit_length())).view(np.int64), mode="clip")
    below = np.flatnonzero(ctx.take(at, mode="clip") < c)
    while len(below):
        at[below] += 1
        below = below[ctx[at[below]] < c[below]]
    return at


def guesses_of(code: Code, texts: list[bytes], known: tuple[np.ndarray, ...], own: bool, cut: tuple | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """For all symbols of the texts, the guesses (own occurrences taken off, if asked for), and which symbols have a context."""
    ctx, packed, begin = known
    c, said, number = code.guessed(texts, cut)
    at = places_of(c, ctx, begin)
    hit = ctx.take(at, mode="clip") == c
    got = packed.take(at, mode="clip") * hit
    g, n, of = got >> 32, (got >> 16) & 65_535, got & 65_535
    if own:
        n, of = n - (hit & (g == said)), of - hit
    many = int(number.max()) + 1 if len(number) else 0
    out = tuple(np.zeros(many, np.int64) for _ in range(3))
    for a, x in zip(out, (g, n, of)):
        a[number] = x
    inside = np.zeros(many, bool)
    inside[number] = True
    return out, inside


def start_weights(batches: RDD, shared) -> np.ndarray:
    """Weights with the least cost on the bits of all training documents, each predicted without its own occurrence.

    The tally has a bounded number of cells, and whole numbers in them: its sum doesn't depend on the order of rows.
    """

    def count(rows: Iterator) -> Iterator[tuple[int, int]]:
        cells = np.zeros(CELLS, np.int64)
        for _, _, train, texts, known in batches_of(rows):
            code, plain, tables = shared.value.parts
            for part in _batches([texts[i] for i in np.flatnonzero(train)], _TALLY_BYTES):
                cut = code.cut(part)
                cells += tally(part, code, plain, tables, guesses_of(code, part, known, True, cut)[0], cut)
        at = np.flatnonzero(cells)
        return zip(at.tolist(), cells[at].tolist())

    cells = np.zeros(CELLS, np.int64)
    for at, n in batches.mapPartitions(count).reduceByKey(int.__add__).collect():
        cells[at] = n
    return fitted_weights(cells)


def document_scores(batches: RDD, shared, weights: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each document: row (a number of its own), doc_id, held_out, n_bytes, score (log10 probability of the
    text and its end), n_tokens, logs and known of its frequent words, and the other words.
    """
    spark = SparkSession.active()
    words_of = spark.sparkContext.broadcast(frequent)

    def run(rows: Iterator) -> Iterator[tuple]:
        hashes, logs = word_table(*words_of.value)
        for batch, ids, train, texts, guesses in batches_of(rows):
            code, plain, tables = shared.value.parts
            number = batch << 24
            for own in (True, False):
                mine = np.flatnonzero(train == own).tolist()
                at = 0
                for part in _batches([texts[i] for i in mine], _SCORE_BYTES):
                    m = len(part)
                    words, owner = word_hashes(part)
                    words, owner = np.concatenate([words, np.full(m, END_WORD)]), np.concatenate([owner, np.arange(m)])
                    slot = (words >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
                    hit = hashes[slot] == words
                    rare, whose = words[~hit].view(np.int64), owner[~hit]
                    order = np.argsort(whose, kind="stable")
                    rare = [x.tolist() for x in np.split(rare[order], np.cumsum(np.bincount(whose, minlength=m))[:-1])]
                    cut = code.cut(part)
                    scores = score_texts(part, code, plain, tables, weights, guesses_of(code, part, guesses, own, cut)[0], own=own, cut=cut) / np.log(10)
                    yield from zip(
                        [ids[i] for i in mine[at : at + m]], [not own] * m, range(number, number + m), [len(t) for t in part], scores.tolist(), np.bincount(owner, minlength=m).tolist(),
                        np.bincount(owner, np.where(hit, logs[slot], 0), m).tolist(), np.bincount(owner[hit], minlength=m).tolist(), rare,
                    )
                    at += m
                    number += m

    schema = StructType.fromDDL("doc_id long, held_out boolean, row long, n_bytes long, score double, n_tokens long, logs double, known long, rare array<long>")
    return spark.createDataFrame(batches.mapPartitions(run), schema, verifySchema=False)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    Null texts are empty: they have the end as their only token. bits_per_byte
    counts the end as a byte. Held-out rows are scored by what all training rows
    have; of a training row's score, its own occurrences are taken off. Without
    training rows every count is 0, and all bits cost one bit. Rows that repeat
    count each, and get equal scores; a null doc_id is held out. An empty table
    gives no rows. Other columns of docs are ignored. A text has to fit a task,
    at some 100 times its bytes.
    """
    d = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    train = d.where("not held_out")
    context = docs.sparkSession.sparkContext
    with one_kind_of_worker(docs.sparkSession):
        counts = stored(token_counts(train), "token-counts")
        code, train_bytes = symbol_code(counts)
        own_code = context.broadcast(code)
        shared = context.broadcast(Model(code, *bit_tables(train, own_code, slot_bits(train_bytes))))
        # rows of a batch stand together; the weights and the scores read the same shuffle
        batches = guessed_batches(d, own_code).repartition("batch").sortWithinPartitions("batch").rdd
        weights = start_weights(batches, shared)
        s = stored(document_scores(batches, shared, weights, frequent_words(counts)), "document-scores")
    words = counts.where("kind = 1")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(totals[0]), int(totals[1])
    rare = s.select("row", F.explode("rare").alias("id")).join(words.select("id", "n"), "id", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_logs"), F.count("n").alias("rare_known"))
    j = s.drop("rare").join(rare, "row", "left")
    bottom = float(np.log10(n + 0.1 * (v + 1)))
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * bottom
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return j.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op8_lm(spark, sf_dir):
    """The scores of all rows of documents; odd rows as in lm_scores()."""
    return lm_scores(table(spark, sf_dir, "documents"))
