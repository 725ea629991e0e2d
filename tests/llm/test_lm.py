import math
import os
import pickle
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import bitmix, lm
from terrafold.llm.lm import lm_scores

from .helpers import DOCS, LOWER, doc_rows, held_out, words


TEXTS = [b"the cat sat on the mat, and the cat saw it.", b"the dog sat on the mat", b"", "Ein nai\u0308ves W\u00f6rtchen".encode(), b"\n\n  odd  white\tspace ", b"the cat sat on the mat, and the cat saw it."]


def small_model(texts, bits=16):
    found = Counter(h for t in texts for h in bitmix.piece_hashes(*bitmix.pieces([t])[:3]).tolist())
    sizes = {h: n for t in texts for h, n in zip(bitmix.piece_hashes(*bitmix.pieces([t])[:3]).tolist(), bitmix.pieces([t])[2].tolist())}
    known = np.array(sorted(h for h, n in found.items() if n > 1 and sizes[h] > 1), np.uint64)
    c = np.zeros(257 + len(known), np.int64)
    for t in texts:
        c[:256] += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        c[256] += 1
    c[257:] = [found[int(h)] for h in known]
    code = bitmix.Code(c, known)
    plain, hashed = np.zeros((2, code.nodes), np.int64), np.zeros((bitmix.HASHED, 2, 1 << bits), np.uint32)
    bitmix.count_bits(texts, code, plain, hashed)
    return code, bitmix.plain_odds(plain), [bitmix.squeezed(h[0], h[1]) for h in hashed], hashed


def test_code_is_complete_and_knows_shared_beginnings():
    code = bitmix.Code(np.arange(300) ** 2)
    assert abs(sum(2.0 ** -int(n) for n in code.length) - 1) < 1e-12
    assert code.length[256] <= code.length[0]
    bits = [code.bit[s : s + n].tolist() for s, n in zip(code.start, code.length)]
    for a, b in [(3, 3), (3, 4), (250, 12), (299, 0)]:
        n = next((i for i, (x, y) in enumerate(zip(bits[a], bits[b])) if x != y), len(bits[a]))
        assert code.shared(np.array([a]), np.array([b]))[0] == n


def test_what_is_broadcast_is_small():
    """Every machine writes it to its disk: a code takes some 8 bytes for each symbol and each piece, and tables are compressed."""
    counts = np.random.default_rng(3).integers(0, 10**6, 20_257)
    known = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 20_000).astype(np.uint64))
    code = bitmix.Code(counts, known)
    sent = pickle.dumps(code)
    again = pickle.loads(sent)
    assert len(sent) < 20 * len(counts)
    assert all(np.array_equal(getattr(code, k), getattr(again, k)) for k in ("length", "start", "place", "bit", "word", "hashes", "symbols"))
    tables = [np.random.default_rng(k).integers(0, 3, 1 << 16).astype(np.uint16) * 257 for k in range(2)]
    sent = pickle.dumps(lm.Model(code, np.zeros(code.nodes, np.float32), tables))
    assert len(sent) < 600_000 and all(np.array_equal(a, b) for a, b in zip(pickle.loads(sent).parts[2], tables))


def test_symbols_spell_the_text():
    code, *_ = small_model(TEXTS)
    symbols, begin, many, inside = code.read(TEXTS)
    whole = {int(code.symbols[h >> np.uint64(64 - code.SLOT_BITS)]): t[s : s + n] for t in TEXTS for h, s, n in zip(bitmix.piece_hashes(*bitmix.pieces([t])[:3]), *bitmix.pieces([t])[1:3])}
    for t, b, n in zip(TEXTS, begin, many):
        own = symbols[b : b + n]
        assert own[-1] == bitmix.END and b"".join(bytes([s]) if s < 256 else whole[s] for s in own[:-1].tolist()) == t
    assert (symbols > bitmix.END).any()


def looped(text, code, plain, tables, start, guesses=None, own=False):
    """Natural log probability of one text, bit by bit, with weights and map refined after each block."""
    symbols, starts, many, inside = code.read([text])
    ctx = bitmix.contexts(symbols, inside)
    moved, corrections, total = np.zeros(bitmix.FEATURES), np.zeros(bitmix.MAP_STEPS), 0.0
    for j, size in bitmix.blocks_of(int(many[0])):
        grad, errs, n_bits = np.zeros(bitmix.FEATURES), np.zeros(bitmix.MAP_STEPS), 0
        for i in range(j, min(j + size, int(many[0]))):
            s = int(symbols[starts[0] + i])
            said = code.bit[code.start[s] : code.start[s] + code.length[s]]
            for d, bit in enumerate(said.tolist()):
                place = int(code.place[code.start[s] + d])
                odds, gate = [float(plain[place])], 0
                for k, c in enumerate(ctx):
                    if k == bitmix.HASHED - 1 and not inside[starts[0] + i]:
                        odds.append(0.0)
                        continue
                    slot = bitmix.slots(c[starts[0] + i : starts[0] + i + 1], np.array([place], np.uint32) * bitmix._NODE, len(tables[k]).bit_length() - 1)[0]
                    n = list(divmod(int(tables[k][slot]), 256))
                    if own:
                        n[bit] = max(0, n[bit] - 1)
                    odds.append(math.log((n[1] + 0.06) / (n[0] + 0.06)))
                    level = 0 if sum(n) == 0 else 1 if sum(n) < 4 else 2
                    gate += level if k == 0 else 3 * (1 + level)
                odds.append(0.0)
                if guesses is not None and guesses[1][i] > 0:
                    g, n, of = (int(x[i]) for x in guesses)
                    mine = code.bit[code.start[g] : code.start[g] + code.length[g]].tolist()
                    if mine[:d] == said[:d].tolist():
                        odds[-1] = math.log((n + 0.15) / (of - n + 0.3)) * (2 * mine[d] - 1)
                        gate += bitmix.GUESS_GATE * (1 + (n > 2))
                x = sum((float(start[gate, k]) + moved[k]) * odds[k] for k in range(bitmix.FEATURES))
                x = max(-bitmix.LIMIT, min(bitmix.LIMIT, x))
                step = int((x + bitmix.LIMIT) * bitmix.MAP_STEPS / (2 * bitmix.LIMIT + 1e-3))
                sign = 2 * bit - 1
                p = 1 / (1 + math.exp(-sign * (x + corrections[step])))
                total += math.log(p)
                grad += (1 - p) * sign * np.array(odds)
                errs[step] += (1 - p) * sign
                n_bits += 1
        moved += bitmix.RATE * grad / math.sqrt(n_bits + 16)
        corrections += bitmix.MAP_RATE * errs / math.sqrt(n_bits + 16)
    return total


@pytest.mark.parametrize("own", [False, True])
def test_scores_against_a_loop(own):
    """Texts over a kilobyte, so blocks of several lengths, with guesses that are right, wrong and absent."""
    texts = [*TEXTS, b" ".join([b"the cat sat"] * 120), b" ".join(b"new%d words" % i for i in range(150))]
    code, plain, tables, _ = small_model(TEXTS)
    w = bitmix.initial_weights() + np.random.default_rng(4).normal(0, 0.1, (bitmix.GATES, bitmix.FEATURES)).astype(np.float32)
    many = code.read(texts)[2]
    rng = np.random.default_rng(5)
    guess = [np.where(rng.random(n) < 0.5, code.read([t])[0][-n:], 100) for t, n in zip(texts, many)]
    often = [rng.integers(0, 6, n) for n in many]
    of = [n + rng.integers(0, 3, len(n)) for n in often]
    got = bitmix.score_texts(texts, code, plain, tables, w, tuple(map(np.concatenate, (guess, often, of))), own=own)
    want = [looped(t, code, plain, tables, w, g, own) for t, *g in zip(texts, guess, often, of)]
    assert got == pytest.approx(want, rel=2e-3)
    alone = np.concatenate([bitmix.score_texts([t], code, plain, tables, w, (g, n, m), own=own) for t, g, n, m in zip(texts, guess, often, of)])
    assert got == pytest.approx(alone, rel=2e-3)


def test_counts_match_a_plain_count():
    code, _, _, hashed = small_model(TEXTS)
    symbols, begin, many, inside = code.read(TEXTS)
    bits = [sum(int(code.length[symbols[b : b + n]][inside[b : b + n] >= k].sum()) for b, n in zip(begin, many)) for k in (0, 1)]
    assert hashed.sum((1, 2)).tolist() == bits


def test_guesses_are_what_most_often_followed(spark):
    """Against counts of what follows each three pieces, with the document's own occurrence taken off."""
    rows = [(i, " ".join(f"w{(i * j) % 5}" for j in range(30)) + f" end{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", lm.held_out(F.col("doc_id")))
    code, *_ = small_model([t.encode() for _, t in rows])
    got = lm.guessed_batches(df.repartition(3), spark.sparkContext.broadcast(code)).toPandas()
    follows = defaultdict(Counter)
    for i, t in rows:
        if not held_out(i, 10, 0):
            c, said, _ = code.guessed([t.encode()])
            for x, y in zip(c.tolist(), said.tolist()):
                follows[x][y] += 1
    seen = 0
    for _, g in got.groupby("batch"):
        ids, train, texts, known = lm.batch_contents(g)
        for own, t in zip(train, texts):
            (guess, n, of), _ = lm.guesses_of(code, [t], known, bool(own))
            c, said, number = code.guessed([t])
            for x, y, k in zip(c.tolist(), said.tolist(), number.tolist()):
                f = follows[x]
                if n[k] > 0:
                    top = max(f.values())
                    assert f[guess[k]] == top and n[k] == top - (own and guess[k] == y) and of[k] == sum(f.values()) - own
                    seen += 1
    assert seen > 500


def test_batches_do_not_depend_on_how_rows_come(spark, monkeypatch):
    """Rows that come to Python a few at a time make the same batches, with ids beyond 2^53 beside unknown ones, and the same counts, which a task sends in portions."""
    rows = [(2**60 + i if i % 9 else None, " ".join(f"w{(i * j) % 17}" for j in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("held_out", lm.held_out(F.col("doc_id")))
    code, *_ = small_model([t.encode() for _, t in rows])
    monkeypatch.setattr(lm, "BATCH_BYTES", 4_000)
    monkeypatch.setattr(lm, "_COUNT_BYTES", 1_000)

    def seen():
        got = lm.guessed_batches(df, spark.sparkContext.broadcast(code)).toPandas()
        batches = {n: lm.batch_contents(g) for n, g in got.groupby("batch")}
        counts = sorted(map(tuple, lm.token_counts(df).collect()))
        return {n: (ids, train.tolist(), texts, [x.tolist() for x in known]) for n, (ids, train, texts, known) in batches.items()}, counts

    whole = seen()
    assert len(whole[0]) > 5 and [i for b in whole[0].values() for i in b[0]] == [i for i, _ in rows]
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert seen() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_python_worker_for_each_core(spark, monkeypatch):
    """Functions on DataFrames and on RDDs run under the same daemon, so that no second worker keeps its memory; the session's settings are as before."""
    parents = []

    def noted(f):
        def run(*args):
            of_frames = spark.range(1).mapInPandas(lambda it: (x.assign(id=os.getppid()) for x in it), "id long")
            parents.extend([of_frames.first()[0], of_frames.repartition(2, "id").rdd.first()[0]])
            parents.append(spark.sparkContext.range(1).map(lambda _: os.getppid()).first())
            return f(*args)

        return run

    for name in ("token_counts", "start_weights", "document_scores"):
        monkeypatch.setattr(lm, name, noted(getattr(lm, name)))
    before = spark.conf.getAll
    lm_scores(spark.createDataFrame([(i, "the cat sat") for i in range(30)], "doc_id long, text string"))
    assert len(parents) == 9 and len(set(parents)) == 1
    assert spark.conf.getAll == before and not any(map(spark.sparkContext.getLocalProperty, lm.SETTINGS))


def test_places_of_contexts():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 3000):
        c = np.unique(np.concatenate([rng.integers(0, 1 << bitmix.GUESS_BITS, n, dtype=np.uint64), rng.integers(0, 50, n, dtype=np.uint64)]))
        c = rng.permutation(c)
        ctx, packed, begin = lm.known_guesses(c, *(np.arange(len(c)) % m for m in (1 << 20, 65_536, 65_535)))
        asked = np.concatenate([c, rng.integers(0, 1 << bitmix.GUESS_BITS, 500, dtype=np.uint64), np.array([0, (1 << bitmix.GUESS_BITS) - 1], np.uint64)])
        assert (lm.places_of(asked, ctx, begin) == np.searchsorted(np.sort(c), asked)).all()
        assert (packed[np.searchsorted(np.sort(c), c)] >> 32 == np.arange(len(c))).all()


def test_weights_are_fitted_on_every_training_document(spark, monkeypatch):
    """Over three megabytes of different documents: the tally has every bit of all that are not held out, and the same cells in any order."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000)) for i in range(2400)]
    assert sum(len(t) for _, t in rows) > 3e6
    seen = []
    monkeypatch.setattr(lm, "fitted_weights", lambda cells: (seen.append(cells), bitmix.initial_weights())[1])
    kept = lm.symbol_code
    monkeypatch.setattr(lm, "symbol_code", lambda counts: (seen.append(kept(counts)), seen[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (df.repartition(5), df.orderBy(F.desc("doc_id")).coalesce(2)):
        assert lm_scores(part).count() == len(rows)
    (code, _), cells, _, again = seen
    train = [t.encode() for i, t in rows if not held_out(i, 10, 0)]
    symbols, begin, many, _ = code.read(train)
    bits = sum(int(code.length[symbols[b : b + n]].sum()) for b, n in zip(begin, many))
    assert cells.sum() == bits and (cells == again).all()


def test_fitted_weights_are_near_the_best():
    """Against Newton's method on every bit's own log odds instead of rounded ones."""
    texts = [b" ".join(b"the cat sat on w%d" % x for x in np.random.default_rng(i).zipf(1.5, 60) % 300) for i in range(60)]
    code, plain, tables, _ = small_model(texts)
    symbols, begin, many, inside = code.read(texts)
    mine = np.arange(int(many.sum()))
    rng = np.random.default_rng(6)
    at = np.repeat(begin - (np.cumsum(many) - many), many) + mine
    often = np.where(inside[at] > 0, 0, rng.integers(0, 6, len(at)))
    guess = np.where(rng.random(len(at)) < 0.7, symbols[at], 100), often, often + rng.integers(0, 3, len(at))
    got = bitmix.fitted_weights(bitmix.tally(texts, code, plain, tables, guess))
    _, sign, gate, odds = bitmix._features(code, plain, tables, symbols, inside, bitmix.contexts(symbols, inside), at, (guess[0], *bitmix.guess_strength(*guess[1:])), mine, True)
    f = np.stack(odds, 1).astype(float) * sign[:, None]
    cost = lambda w: np.log1p(np.exp(-(w[gate] * f).sum(1))).sum()
    w = bitmix.initial_weights().astype(float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(w[gate] * f).sum(1)))
        grad, hess = np.zeros_like(w), np.zeros((*w.shape, w.shape[1]))
        np.add.at(grad, gate, (1 - p)[:, None] * f)
        np.add.at(hess, gate, (p * (1 - p))[:, None, None] * f[:, :, None] * f[:, None, :])
        w = bitmix.newton_step(w, grad, hess)
    assert cost(w) <= cost(got) < 1.01 * cost(w) < 0.9 * cost(bitmix.initial_weights())


def test_what_occurs_twice_scores_better(spark):
    """Documents of random words, half of them with a copy: copies are predicted by the other one, single ones not by themselves."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()}
    twice = [got[i] for i in range(40) if i in got and 1000 + i in got]
    once = [got[i] for i in range(40, 120) if i in got]
    assert max(twice) < min(once)


def test_scores(spark):
    rows = doc_rows() + [(i, f"the cat sat on the mat and the dog number {i % 7} saw it " * (1 + i % 5), "en", "s", 0) for i in range(20, 120)]
    got = lm_scores(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    token = lambda t: [*words((t or "").translate(LOWER)), " "]
    c = Counter()
    for i, t, *_ in rows:
        if i is not None and not held_out(i, 10, 0):
            c.update(token(t))
    n, v = sum(c.values()), len(c)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        w = token(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is None or held_out(r["doc_id"], 10, 0))
    cat = [r["bits_per_byte"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 20 and r["held_out"]]
    assert max(cat) < 2
    clashing = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit("x")).withColumn("a.b", F.lit(1))
    again = {(r["doc_id"], r["base_score"]) for r in lm_scores(clashing).collect()}
    assert len(again) == len({(r["doc_id"], r["base_score"]) for r in got})


def test_empty(spark):
    assert lm_scores(spark.createDataFrame([], DOCS)).count() == 0
    got = lm_scores(spark.createDataFrame([(None, None, None, None, None)], DOCS)).collect()
    assert got[0]["n_tokens"] == 1 and got[0]["train_tokens"] == 0
