import random
import re
import zlib
from collections import Counter

from terrafold.llm.spelling import op13_spelling, spelling_variants

from .helpers import DOCS, LOWER, doc_rows


def brute_counts(rows):
    c = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(map(str, out))


def crowd():
    """Words over few letters, many of them near each other, some with accents, long ones, and ties."""
    rng = random.Random(5)
    out = {}
    for _ in range(500):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        out[w] = rng.choice((5, 5, 25, 125, 700, 4000))
    long = "".join(rng.choice("abcd") for _ in range(130))
    for w in (long, long[:60] + "x" + long[60:], long[:60] + "x" + long[61:], "y" + long, long + "z", long[:-1], long[:129] + "q"):
        out[w] = rng.choice((5, 30))
    return out | {"aaaaaa": 9, "aaaaaaa": 50, "aaaaaaaa": 900}


def check(spark, counts, **more):
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(counts)


def test_near_words_forms_and_roots(spark):
    check(spark, crowd())


def test_keys_of_crowds_are_split(spark, monkeypatch):
    import terrafold.llm.spelling as s

    whole = s.near_words
    monkeypatch.setattr(s, "near_words", lambda words: whole(words, middle=3, crowd=6, block=64))
    check(spark, crowd())


def test_the_query(spark, tmp_path):
    rng = random.Random(1)
    base = ["thinking", "Thinkings", "thinkin", "ÉCOLEs", "écoles", "ecoles", "planet", "planets", "plane"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(base) for _ in range(60)) + " 2word_six-letters\x0bnaïvely", "en", "a", 1) for i in range(40)] + doc_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_spelling(spark, str(tmp_path)).collect()
    want = brute(brute_counts(rows))
    assert len(want) > 6 and sorted(str(tuple(r)) for r in got) == want


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_spelling(spark, str(tmp_path)).count() == 0
    check(spark, {"single": 7})
