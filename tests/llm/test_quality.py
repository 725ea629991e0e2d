import numpy as np

from terrafold.llm.quality import CHUNK, OVERLAP, PAD, ByteConv, chunks_of, classify_quality, fit_quality, keep_good

from .helpers import DOCS, doc_rows, held_out


def test_chunks_cover_all_bytes():
    for n in (0, 1, OVERLAP, CHUNK, CHUNK + 1, 3_000):
        t = bytes((i * 7) % 251 for i in range(n))
        c, owner = chunks_of([t, b"x"])
        step = CHUNK - OVERLAP
        seen = b"".join(bytes(x[x != PAD].astype(np.uint8))[0 if k == 0 else OVERLAP :] for k, x in enumerate(c[owner == 0]))
        assert seen == t and step > 0 and (owner == 1).sum() == 1


def test_pooling_and_combination_match_plain_loops():
    m = ByteConv()
    t = b"some text that is long enough " * 30
    c, owner = chunks_of([t])
    pooled, at = m.pooled(c, where=True)
    for i in range(len(c)):
        for f in range(3):
            z = [sum(float(m.filters[k, c[i, p + k], f]) for k in range(len(m.filters))) for p in range(CHUNK - len(m.filters) + 1)]
            assert abs(max(max(z), 0) - pooled[i, f]) < 1e-4 and abs(z[at[i, f]] - max(z)) < 1e-4
    h = m.hidden(pooled)
    x = np.hstack([h.mean(0), h.max(0)]) @ m.weights + m.shift
    assert abs(m.probability([t])[0] - 1 / (1 + np.exp(-x[0]))) < 1e-6


def corpus():
    rng = np.random.default_rng(3)
    syl = ["ba", "ko", "ri", "ten", "sol", "um", "ve", "dar"]
    docs, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice(syl, rng.integers(1, 4))) for _ in range(int(rng.integers(3, 200)))]
        good = int(rng.random() < 0.7)
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "s", 0))
        labels.append((i, good, 0))
    return docs, labels + [(None, 1, 0), (3, None, 0), (99_999, 1, 0)]


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify_quality(d, fit_quality(d, lab, epochs=4)).collect()}
    truth = {i: q for i, q, _ in labels if i is not None and q is not None and i in got}
    test = [i for i in truth if held_out(i, 3, 1)]
    assert np.mean([got[i]["predicted"] == truth[i] for i in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_odd_rows_and_missing_classes(spark):
    d = spark.createDataFrame(doc_rows(), DOCS)
    for labels in ([], [(1, 1, 0), (2, 1, 0), (3, 1, 0)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = fit_quality(d, lab)
        got = classify_quality(d, model).collect()
        assert len(got) == len(doc_rows()) and all(r["score"] >= 0.5 for r in got)
        assert keep_good(d, lab).columns == d.columns
    assert classify_quality(spark.createDataFrame([], DOCS), ByteConv()).count() == 0
