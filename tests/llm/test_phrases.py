import random
import re
from collections import Counter, defaultdict

import duckdb

from terrafold.llm.phrases import OP12_SQL, collocations, compact_paths, heaviest_edges, op12_phrases

from .helpers import LOWER, doc_rows


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * x >= 50 * a and p in (q[:2], q[1:]) for q, x in cand.items() if len(q) == 3):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts():
    """Pieces and ends, loops of one and two words, fixed expressions, tabs, accents, nulls, and a word after which everything follows."""
    rng = random.Random(2)
    words = [*"abcdef", "Être", "漢字", "x\xa0y"]
    rows = [("en", " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(300))) for _ in range(8)]
    rows += [("de", "All rights of this long Notice are reserved here; " * 12), ("de", "no no no no no no no no no no no no no"), ("de", "tick tock " * 15), (None, "seen once. " * 11), ("fr", None), ("fr", ""), (None, " . ; \n")]
    rows += [("es", f"of the w{i} of the v{i % 5}") for i in range(60)]
    return rows + [(r[2], r[1]) for r in doc_rows() if len(r[1] or "") < 5000]


def test_against_brute_force(spark):
    rows = texts()
    want = brute(rows)
    assert len(want) > 40
    for more in ({}, {"batch_bytes": 500, "bucket_edges": 40}):
        got = collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), **more)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_the_query_and_its_sql(spark, tmp_path):
    rows = [(i, t, lang, 1) for i, (lang, t) in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_phrases(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(OP12_SQL)
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(want.fetchall())


def test_few_places(spark):
    rows = texts()
    got = collocations(spark.createDataFrame(rows, "lang string, text string"), top=3)
    assert sorted(tuple(r) for r in got.collect()) == [r for r in brute(rows) if r[1] <= 3]
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_paths_and_their_nodes(spark):
    """A path with a fork at its end, a ring, a loop of one node, and a node with two ways in."""
    edges = [(1, 2, 3, 50), (2, 3, 4, 40), (3, 4, 5, 30), (4, 5, 6, 20), (4, 5, 7, 15), (10, 11, 10, 9), (11, 10, 11, 8), (20, 20, 20, 7), (8, 4, 5, 12)]
    paths = compact_paths(spark.createDataFrame(edges, "a long, b long, c long, n long")).collect()
    named = defaultdict(list)
    for r in sorted(paths, key=lambda r: r["pos"]):
        named[r["path"]].append((r["a"], r["b"], r["c"]))
        assert r["last"] == (r["pos"] == sum(x["path"] == r["path"] for x in paths) - 1)
    ring = [v for v in named.values() if v[0][0] in (10, 11)]
    assert len(ring) == 1 and len(ring[0]) == 2
    assert sorted(v for v in named.values() if v[0][0] not in (10, 11)) == [[(1, 2, 3), (2, 3, 4), (3, 4, 5)], [(4, 5, 6)], [(4, 5, 7)], [(8, 4, 5)], [(20, 20, 20)]]
    want = Counter()
    for a, b, c, n in edges:
        want[a, b] = max(want[a, b], n)
        want[b, c] = max(want[b, c], n)
    got = [((r["a"], r["b"]), r["most"]) for r in heaviest_edges(spark.createDataFrame(paths)).collect()]
    assert sorted(got) == sorted(want.items())
