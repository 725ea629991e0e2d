import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import set_join
from terrafold.operators.graph import connected_components
from terrafold.llm.set_join import keep_one_of_each, set_relation_join
from terrafold.llm.shingles import common, pack, shingle_sets, unpack

from .helpers import DOCS, components, doc_rows, shingles


def test_shingle_sets_have_the_sizes_and_overlaps_of_real_sets():
    texts = [r[1] or "" for r in doc_rows()]
    values, counts = shingle_sets([t.encode() for t in texts])
    sets = [set(v.tolist()) for v in np.split(values, np.cumsum(counts)[:-1])]
    real = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in real]
    assert all(len(sets[i] & sets[j]) == len(real[i] & real[j]) for i in range(len(sets)) for j in range(i))


def test_packed_arrays_come_back():
    a = np.unique(np.random.default_rng(1).integers(0, 2**62, 1000)).astype(np.uint64)
    assert (unpack(pack(a)) == a).all() and len(unpack(pack(a[:0]))) == 0
    assert common(a[::2], a[::3]) == len(set(a[::2].tolist()) & set(a[::3].tolist()))


def family(rng):
    """Groups of near copies, chains of slowly changing copies, shared passages and plain texts."""
    rows, n = [], 0
    passage = [f"p{i}" for i in range(60)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.randint(20, 160))]
        for _ in range(rng.randint(2, 25)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((n := n + 1, " ".join(t)))
    t = [f"c{i}" for i in range(100)]
    for i in range(30):
        t = list(t)
        t[i * 3 % 100] = f"changed{i}"
        rows.append((n := n + 1, " ".join(t)))
    for i in range(30):
        rows.append((n := n + 1, " ".join([f"own{i}x{j}" for j in range(rng.randint(1, 60))] + passage)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,rounds", [(1, 16), (2, 0)])
def test_against_brute_force(spark, seed, rounds, monkeypatch):
    monkeypatch.setattr(set_join, "HOT_IN_BATCH", 8)
    monkeypatch.setattr(set_join, "OPEN_PAIRS", rounds)
    rows = family(random.Random(seed))
    got = set_relation_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = components(dict(rows))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_odd_rows(spark):
    rows = doc_rows()
    got = set_relation_join(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "node")).collect()
    want = components({r[0]: r[1] for r in rows if r[0] is not None})
    assert len(got) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert set_relation_join(spark.createDataFrame([], DOCS)).count() == 0


def test_one_of_each_stays(spark):
    rows = doc_rows()
    df = spark.createDataFrame(rows, DOCS)
    got = keep_one_of_each(df)
    assert got.columns == df.columns
    # 1 stands for its copies and near copies, 7 for 8, 9 for 10; texts without words all stay
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 11, 12, 14, None]))


def test_of_equal_texts_one_row_stays_whatever_the_partitions(spark):
    rows = [(1, "a b c d e f", "en", str(i), i) for i in range(8)] + [(2, "a b c d e f", "en", "z", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = [keep_one_of_each(x.withColumn("a.b", F.lit(1))).collect() for x in (df, df.repartition(5))]
    assert len(got[0]) == 1 and got[0] == got[1] and got[0][0]["doc_id"] == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
