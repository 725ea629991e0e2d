import hashlib
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from terrafold.llm.simhash import fingerprints, op11_simhash, within_radius

from .helpers import DOCS, doc_rows

HALF = ["f1", "f2"]
U = (1 << 64) - 1


def brute_print(text, size=3):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w]
    terms = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    out = []
    for half in range(2):
        votes = [0] * 64
        for t in terms:
            seed = 42
            for x in t:  # Spark hashes each value with the hash before as seed
                seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
            if half:
                seed = xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), 42)
            for b in range(64):
                votes[b] += 1 if seed >> b & 1 else -1
        out.append(sum(1 << b for b in range(64) if votes[b] > 0))
    return tuple(out)


def edited(rows):
    """(doc_id, text) -> edited text; rows are distinct."""
    def key(r):
        h = "" if r[0] is None else str(r[0])
        h = xxhash.xxh64_intdigest(r[1].encode(), xxhash.xxh64_intdigest(h.encode(), 42))
        return r[0] is None, -(r[0] or 0), (h + (1 << 63)) & U

    order = sorted({(r[0], r[1] or "") for r in rows}, key=key)
    return {r: r[1][: len(r[1]) - len(r[1]) // 2] + order[(i + 1) % len(order)][1][: len(r[1]) // 2] for i, r in enumerate(order)}, {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_simhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    changed, after = edited(rows)
    shown = lambda p: f"{p[0]:016x}{p[1]:016x}"
    near = lambda p, q: 1 - sum((a ^ b).bit_count() for a, b in zip(p, q)) / 128
    own = {r: brute_print(r[1]) for r in changed}
    want = []
    for r in rows:
        k = (r[0], r[1] or "")
        e = brute_print(changed[k])
        close = [sum((a ^ b).bit_count() for a, b in zip(own[k], own[x[0], x[1] or ""])) <= 6 for x in rows]
        prints = {own[x[0], x[1] or ""] for x, c in zip(rows, close) if c}
        asked = r[0] is not None and r[0] % 50 == 0
        want.append((r[0], len(k[1]), hashlib.sha256(changed[k].encode()).hexdigest(), shown(own[k]), shown(e), near(own[k], e), near(own[k], own[after[k]]), len(prints) if asked else None, sum(close) if asked else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_odd_rows(spark, tmp_path):
    check(spark, tmp_path, [r for r in doc_rows() if len(r[1] or "") < 5000] + [(50, doc_rows()[0][1], "en", "a", 1), (100, "One two\tthree", "en", "a", 1), (100, "one TWO three", "en", "a", 1), (150, None, None, None, None)])


def test_long_texts_are_counted_in_chunks(spark):
    texts = [(1, " ".join(f"w{i % 5000}" for i in range(70_000))), (2, "again " * 40_000), *[(3, "often so " * 9000)] * 6]
    got = {r["doc_id"]: (r["f1"] & U, r["f2"] & U) for r in fingerprints(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {i: brute_print(t) for i, t in texts}


def test_clashing_names_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a b c", 9)], "at long, t long, text string, chunk long")
    got = fingerprints(df, ["at", "t"]).first()
    assert (got["at"], got["t"], got["f1"] & U, got["f2"] & U) == (1, 2, *brute_print("a b c"))
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_simhash(spark, str(tmp_path)).count() == 0


def test_the_search_finds_all_within_the_radius(spark):
    """A crowd around one fingerprint, in bits of any blocks, next to random ones: as many as a loop over all pairs finds."""
    rng = np.random.default_rng(3)
    base = int.from_bytes(rng.bytes(16), "little")
    prints = {base}
    for _ in range(1500):
        x = base
        for b in rng.choice(128, int(rng.integers(1, 12)), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int.from_bytes(rng.bytes(16), "little") for _ in range(500)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p & U), signed(p >> 64), 1 + i % 3) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "f1 long, f2 long, docs long")
    asked = df.where("docs = 2").select(*HALF)
    for radius, blocks in ((6, 8), (3, 4), (0, 2)):
        got = {(r["f1"] & U) | (r["f2"] & U) << 64: (r["n_prints"], r["n_docs"]) for r in within_radius(df, asked, radius, blocks).collect()}
        want = {}
        for i, p in enumerate(prints):
            if 1 + i % 3 == 2:
                near = [j for j, q in enumerate(prints) if (p ^ q).bit_count() <= radius]
                want[p] = (len(near), sum(1 + j % 3 for j in near))
        assert got == want


def test_likeness_follows_shared_text(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(0, text), (1, text.replace("w17 ", "other ")), (2, " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"v{i}" for i in range(200))), (3, " ".join(f"u{i}" for i in range(400)))]
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    like = [sum((got[0][h] & U ^ got[i][h] & U).bit_count() for h in HALF) for i in range(4)]
    assert like[0] == 0 < like[1] < 16 < like[2] < 58 < 80 > like[3] > like[2]
