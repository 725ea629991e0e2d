from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrafold.llm import mixing
from terrafold.llm.mixing import mix_documents, mixing_plan, sainte_lague, source_targets

from .helpers import DOCS, doc_rows, words


def seats_one_by_one(votes, n):
    won = [0] * len(votes)
    for _ in range(n):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


@pytest.mark.parametrize("votes,n", [([100, 80, 30, 20], 8), ([5, 5, 5], 7), ([1, 0, 999], 10), ([3.5, 2.5, 1], 1), ([10] * 9, 3), ([7, 3], 0), ([1] * 50 + [1000], 40)])
def test_highest_quotients(spark, votes, n):
    p = spark.createDataFrame(list(enumerate(map(float, votes))), "i long, v double")
    got = {r["i"]: r["seats_won"] for r in sainte_lague(p, "v", F.lit(n), ["i"], []).collect()}
    assert [got[i] for i in range(len(votes))] == seats_one_by_one(votes, n)


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    w = [weights[i % 3] for i in range(len(sizes))]
    while True:
        level = left / sum(w[i] for i in open_) if open_ else 0
        full = {i for i in open_ if w[i] * level > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = w[i] * level
            return out
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= full


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1, 1], [5, 50, 500, 5000, 0], [7]])
def test_targets(spark, sizes):
    s = spark.createDataFrame([(chr(97 + i), n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in source_targets(s).orderBy("rank").collect()]
    assert got == pytest.approx(water(sizes))


def corpus():
    return [(i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 60)), "en", [None, "b", "a", "é", "c"][i % 5], 0) for i in range(400)]


def test_plan(spark):
    rows = corpus()
    got = mixing_plan(spark.createDataFrame(rows, DOCS), shard_words=500).collect()
    again = mixing_plan(spark.createDataFrame(rows[::-1], DOCS).repartition(7), shard_words=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {r[0]: len(words(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        total[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted((s for s in total if s is not None)) + [None]
    assert [target[s] for s in order] == pytest.approx(water([total[s] for s in order]))
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 5


def test_mixed_texts_have_the_words_of_the_plan(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    taken = {r["doc_id"]: r["taken"] for r in mixing_plan(df, shard_words=500).collect()}
    got = defaultdict(int)
    text = {r[0]: words(r[1]) for r in rows}
    out = mix_documents(df, shard_words=500)
    assert out.columns == df.columns
    for r in out.collect():
        w = words(r["text"])
        got[r["doc_id"]] += len(w)
        assert set(w) <= set(text[r["doc_id"]]) and len(set(w)) == len(w)
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)


def brute_force_taken(rows, plan, page=128):
    """taken by row, for sources of one shard: documents in a line by hash, pages by seeded hash until the quota is full."""
    hashes = {r["doc_id"]: r["text_hash"] for r in plan}
    size = {r["doc_id"]: r["size"] for r in plan}
    by = defaultdict(list)
    for i, _, _, s, _ in rows:
        by[s].append(i)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    targets = water([sum(size[i] for i in by[s]) for s in order])
    quotas = seats_one_by_one(targets, round(sum(targets)))
    return order, by, size, {s: sorted(by[s], key=lambda i: (hashes[i], i)) for s in order}, dict(zip(order, quotas))


def test_taken_against_brute_force(spark):
    rows = corpus()
    plan = mixing_plan(spark.createDataFrame(rows, DOCS), shard_words=10**6, page_words=16).collect()
    order, by, size, line, quota = brute_force_taken(rows, plan)
    keys = [(rank, i) for rank, s in enumerate(order, 1) for i in range(-(-sum(size[d] for d in by[s]) // 16))]
    df = spark.createDataFrame(keys, "rank int, i int")
    pages = defaultdict(list)
    for r in df.select("rank", "i", F.xxhash64(F.lit(7), "rank", F.lit(0).cast("long"), "i").alias("h")).collect():
        pages[order[r["rank"] - 1]].append((r["h"], r["i"]))
    want = {}
    for s in order:
        tape = [d for d in line[s] for _ in range(size[d])]
        rounds, rest = divmod(quota[s], len(tape))
        got = Counter({d: rounds * size[d] for d in by[s]})
        for _, i in sorted(pages[s]):
            page = tape[i * 16 : i * 16 + 16][:rest]
            rest -= len(page)
            got.update(page)
        want |= got
    assert {r["doc_id"]: r["taken"] for r in plan} == want


def test_small_sources_come_within_a_word(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(6 + i % 9)), "en", f"s{i:05d}", 0) for i in range(2000)]
    rows += [(5000 + i, " ".join(f"b{j}" for j in range(300)), "en", "big", 0) for i in range(200)]
    taken, target = defaultdict(int), {}
    for r, source in ((r, "big" if r["doc_id"] >= 5000 else r["doc_id"]) for r in mixing_plan(spark.createDataFrame(rows, DOCS)).collect()):
        taken[source] += r["taken"]
        target[source] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert max(abs(taken[s] - target[s]) for s in target) <= 1


def test_shards_in_groups(spark, monkeypatch):
    """Many shards of one source, with empty texts among them; shards are bounded by rows too."""
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    rows = [(i, " ".join(f"w{j}" for j in range(i % 11)), "en", "only" if i % 3 else "other", 0) for i in range(600)]
    got = mixing_plan(spark.createDataFrame(rows, DOCS), shard_words=10**6, shard_rows=20, page_words=8).collect()
    for parity in (True, False):
        part = [r for r in got if bool(r["doc_id"] % 3) == parity]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 1
        assert all(r["taken"] == sum(x["n"] for x in r["pieces"]) + (r["taken"] - sum(x["n"] for x in r["pieces"])) // max(1, r["size"]) * r["size"] for r in part)


def test_repeated_rows_and_odd_names(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 3)] * 3 + [(2, "x y z", "de", "s", 0), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("a.b", F.lit(1)).withColumn("nth", F.lit(2)).withColumn("TEXT_HASH", F.lit(3))
    plan = mixing_plan(df, page_words=2)
    out = mix_documents(df, page_words=2)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_documents(df.repartition(5), page_words=2).collect()))
    want = sum(r["taken"] for r in plan.collect())
    assert sum(len(words(r["text"])) for r in got) == want > 27


def test_odd_rows(spark):
    df = spark.createDataFrame(doc_rows(), DOCS)
    got = mixing_plan(df).collect()
    assert len(got) == len(doc_rows())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing_plan(spark.createDataFrame([], DOCS)).count() == 0
    assert mix_documents(df.withColumn("text_hash", F.lit("x"))).columns == [*df.columns, "text_hash"]
