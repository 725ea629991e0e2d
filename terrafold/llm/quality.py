"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Filters over WIDTH bytes slide over each chunk; rectified responses are
max-pooled inside the chunk and go, with the filled share of the chunk, through a
small dense layer, and the chunks' mean and maximum are combined into one probability by a logistic layer. As the input is one byte out of 256, a
filter is a table for each of its places, and its response is a sum of lookups.

Training is on the driver, on a bounded sample of labelled rows; scoring runs in
the tasks that read the documents, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

CHUNK, OVERLAP, WIDTH, FILTERS, HIDDEN = 512, 64, 6, 16, 16
PAD = 256
#: Training takes this many labelled rows of each class at most, with texts of TRAIN_CHARS at most.
TRAIN_ROWS, TRAIN_CHARS, EPOCHS = 2_000, 50_000, 8
_AT_ONCE = 64


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n, CHUNK) byte values with PAD behind the end, and the number of the text of each row.

    Chunks begin every CHUNK - OVERLAP bytes; an empty text is one chunk of PAD.
    """
    step = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.full((len(owner), CHUNK), PAD, np.int16)
    row = 0
    for t, n in zip(texts, counts):
        b = np.frombuffer(t, np.uint8)
        for k in range(n):
            part = b[k * step : k * step + CHUNK]
            out[row, : len(part)] = part
            row += 1
    return out, owner


class ByteConv:
    """filters[k, byte, f], filter biases, the dense layer, and the weights of the chunks' mean and maximum."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = (rng.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = (rng.standard_normal((FILTERS + 2, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32)
        self.dense_bias = np.zeros(HIDDEN, np.float32)
        self.weights = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Per chunk and filter the largest rectified response, then two functions of the filled share; and the positions if asked for."""
        n, places = len(chunks), CHUNK - WIDTH + 1
        out, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        tmp = np.empty((_AT_ONCE * places, FILTERS), np.float32)
        total = np.empty_like(tmp)
        for i in range(0, n, _AT_ONCE):
            c = chunks[i : i + _AT_ONCE]
            m = len(c) * places
            z, t = total[:m], tmp[:m]
            for k in range(WIDTH):
                np.take(self.filters[k], c[:, k : k + places].ravel(), axis=0, out=t if k else z, mode="clip")
                if k:
                    z += t
            z3 = z.reshape(len(c), places, FILTERS)
            if where:
                at[i : i + len(c)] = z3.argmax(1)
            out[i : i + len(c)] = z3.max(1)
        out += self.bias
        filled = (chunks != PAD).mean(1, dtype=np.float32)[:, None]
        return np.hstack([np.maximum(out, 0, out=out), 4 * np.exp(-8 * filled), np.sqrt(filled)]), at

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.dense + self.dense_bias, 0)

    @staticmethod
    def combined(pooled: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Mean and maximum over the chunks of each text; owner is sorted and has each text."""
        starts = np.searchsorted(owner, np.arange(n))
        counts = np.diff(np.append(starts, len(owner)))[:, None]
        return np.hstack([np.add.reduceat(pooled, starts, axis=0) / counts, np.maximum.reduceat(pooled, starts, axis=0)])

    def probability(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        chunks, owner = chunks_of(texts)
        x = self.combined(self.hidden(self.pooled(chunks)[0]), owner, len(texts)) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.02, seed: int = 6) -> "ByteConv":
        """Adam on the log loss; only the places that won the pooling get a gradient."""
        rng = np.random.default_rng(seed)
        ready = [chunks_of([t])[0] for t in texts]
        params = [self.filters, self.bias, self.dense, self.dense_bias, self.weights, self.shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                ids = order[i : i + batch]
                chunks = np.concatenate([ready[j] for j in ids])
                owner = np.repeat(np.arange(len(ids)), [len(ready[j]) for j in ids])
                p, at = self.pooled(chunks, where=True)
                h = self.hidden(p)
                feats = self.combined(h, owner, len(ids))
                out = feats @ self.weights + self.shift
                err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[ids]) / len(ids)
                counts = np.bincount(owner, minlength=len(ids))[:, None]
                mean_part = (err[:, None] * self.weights[:HIDDEN] / counts)[owner]
                top = feats[:, HIDDEN:][owner] == h
                ties = np.add.reduceat(top, np.searchsorted(owner, np.arange(len(ids))), axis=0)[owner]
                max_part = (err[:, None] * self.weights[HIDDEN:])[owner] * top / np.maximum(ties, 1)
                gh = ((mean_part + max_part) * (h > 0)).astype(np.float32)
                g = (gh @ self.dense[:FILTERS].T) * (p[:, :FILTERS] > 0)
                gf = np.zeros_like(self.filters)
                rows, cols = np.arange(len(chunks))[:, None], np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(WIDTH):
                    np.add.at(gf[k], (chunks[rows, at + k], cols), g)
                grads = [gf + 1e-5 * self.filters, g.sum(0), p.T @ gh + 1e-4 * self.dense, gh.sum(0), feats.T @ err + 1e-4 * self.weights, np.array([err.sum()])]
                step += 1
                lr = rate * min(1.0, step / 10) * (1 - 0.9 * step / steps)
                for q, d, a, b in zip(params, grads, m, v):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    q -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS, epochs: int = EPOCHS) -> ByteConv:
    """A network from labels(doc_id, quality) outside the held-out third.

    Of each class, the ``rows_per_class`` labelled rows with the smallest hashes
    are taken, and their texts if they have at most ``max_chars``; classes get
    even say in training, and the shift is then set to their true shares. Labels
    with a null in them are passed over; where a doc_id has several, the lowest
    counts. With a class missing, the network says the share of label 1
    everywhere (0.5 without labels).
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    shares = {r["quality"]: r["n"] for r in known.groupBy(F.when(F.col("quality") > 0, 1).otherwise(0).alias("quality")).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ByteConv()
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    model.shift[0] = np.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        model.weights[:] = 0
        return model
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") > 0 if k else F.col("quality") <= 0).orderBy(order, "doc_id").limit(rows_per_class).select("doc_id", F.lit(k).alias("y")) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # 2 * rows_per_class rows at most
    got = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars).join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").limit(4 * rows_per_class).collect()
    y = np.array([r["y"] for r in got], np.float32)
    model.shift[0] = 0
    if 0 < y.sum() < len(y):
        model.fit([(r["text"] or "").encode() for r in got], y, epochs)
    taken1, taken0 = float(y.sum()), float(len(y) - y.sum())
    model.shift[0] += np.log(n1 / n0) - np.log((taken1 + 0.5) / (taken0 + 0.5))
    return model


def quality_score(model: ByteConv):
    """A column function: the probability that the text has label 1; null counts as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = np.empty(len(s))
            texts, size, first = [], 0, 0
            for i, t in enumerate(s):
                texts.append(t.encode() if t else b"")
                size += len(texts[-1])
                if size > 1 << 20 or i + 1 == len(s):  # about a megabyte at once
                    out[first : i + 1] = model.probability(texts)
                    texts, size, first = [], 0, i + 1
            yield pd.Series(out)

    return score


def classify_quality(docs: DataFrame, model: ByteConv) -> DataFrame:
    """doc_id, score, predicted for each row of docs (predicted is 1 from 0.5 on)."""
    s = docs.select("doc_id", quality_score(model)(F.col("text")).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the network doesn't reject, with their columns."""
    score = quality_score(fit_quality(docs, labels, **options))
    return docs.where(score(F.col("text")) >= 0.5)


def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return classify_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
