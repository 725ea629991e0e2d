import itertools
import random
from collections import defaultdict

from terrafold.llm.packing import optimal_boundaries, pack

from .helpers import DOCS, doc_rows, words


def padded(hist, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in hist)


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        hist = [(n, rng.randint(1, 30)) for n in rng.sample(range(1, 60), rng.randint(1, 8))]
        k = rng.randint(1, 4)
        got = optimal_boundaries(hist, k)
        lengths = [n for n, _ in hist]
        best = min(padded(hist, b) for r in range(1, k + 1) for b in itertools.combinations(lengths, min(r, len(lengths))) if max(b) == max(lengths))
        assert len(got) <= k and padded(hist, got) == best


def test_batches_keep_to_the_budget(spark):
    rows = [(i, "w " * (i * i % 97), "en", "s", 0) for i in range(300)] + doc_rows()
    got = pack(spark.createDataFrame(rows, DOCS), buckets=5, token_budget=200, part_rows=40).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in got) == sorted(str((r[0], len(words(r[1])))) for r in rows)
    assert len({r["bucket"] for r in got}) <= 5
    batches = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["pad_to"]
        batches[r["bucket"], r["part"], r["batch"]].append((r["slot"], r["pad_to"]))
    for b in batches.values():
        assert sorted(s for s, _ in b) == list(range(len(b)))
        assert len(b) == 1 or sum(p for _, p in b) <= 200


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], DOCS)).count() == 0
