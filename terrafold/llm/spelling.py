"""Spelling variants: words one edit apart, grouped under the most frequent form.

Two words that differ by one edit agree before it and behind it. So words meet by
what they have outside a middle part: first with their first or their second
half alike, then, where the middle is still long or too many words meet, with
half of the middle more. A key's words are thus bounded at last by the alphabet.

Words that meet are compared by a bit-sliced index: for each (position, letter) of
the middle a bitset over the words. For a block of queries at once, word-parallel
recurrences carry the sets with no error, with one letter replaced, and with one
inserted, for which the index's positions are shifted by one. A task sends one
row for each word and block, with the number of near words and the best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: The longest middle part; words that meet by a key, at most where their middle has over one letter; entries compared at once, about.
MIDDLE, CROWD, BLOCK = 24, 4096, 4096
_QUERIES = 1 << 17  # bytes of a set of a block of queries
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(run: Column) -> Column:
    """A-Z in lower case, and no other letter."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, _UPPER, _UPPER.lower()))


def damaged(doc_id: Column, word: Column) -> Column:
    """The word, without one letter where 199 divides the checksum of the id and the word; a null id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of docs(doc_id, text) with enough letters and occurrences. Null texts have none."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= letters).select(damaged(F.col("doc_id"), lowered(F.col("run"))).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(entries: DataFrame) -> DataFrame:
    """entries(word, n, m, lo, hi) with the key of what is outside the middle: the first lo and the last hi letters, m being the shorter word's length."""
    outside = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("-"), F.when(F.col("hi") > 0, F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi"))).otherwise(""))
    return entries.withColumn("key", F.xxhash64("m", "lo", "hi", outside))


def _split(entries: DataFrame) -> DataFrame:
    """Each entry twice: with the first half of its middle outside, and with the second."""
    free = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(free / 2).cast("int")
    two = F.array(F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + free - half).alias("hi")))
    return _keyed(entries.select("word", "n", "m", F.explode(two).alias("x")).select("word", "n", "m", "x.lo", "x.hi"))


def meeting_words(words: DataFrame, middle: int = MIDDLE, crowd: int = CROWD) -> DataFrame:
    """word, n, m, lo, hi, key: words(word, n) by all keys under which they meet words one edit away.

    Keys with a long middle or more than ``crowd`` words are split until the
    middle has one letter at most, when the rest of the words is the same.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    todo, done = stored(_split(whole.where("m > 0")), "meeting"), []
    while True:
        free = F.col("m") - F.col("lo") - F.col("hi")
        many = todo.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
        # a key of one word finds nothing
        rows = todo.join(many.where("met > 1"), "key").withColumn("split", (free > 1) & ((free > middle) | (F.col("met") > crowd)))
        rows = stored(rows, "meeting")
        done.append(rows.where("not split").select("word", "n", "m", "lo", "hi", "key"))
        more = rows.where("split")
        if more.isEmpty():
            break
        todo = stored(_split(more), "meeting")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points one behind another, and where each begins (with the end of the last)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words])])


def near_in_block(g: pd.DataFrame) -> list[tuple[int, int]]:
    """The pairs of rows of g(word, m, lo, hi, key) whose words are one edit apart and meet by their key; each pair of words once in all blocks.

    The first of a pair has m letters; pairs of two such words come both ways round.
    """
    words, n = list(g.word), len(g)
    m, lo, hi = (g[c].to_numpy(np.int64) for c in ("m", "lo", "hi"))
    points, starts = _letters(words)
    length = np.diff(starts)
    size = length - lo - hi  # of the middle
    deep = int(size.max()) + 1
    at = np.arange(deep)
    inside = at < size[:, None]
    codes = np.where(inside, points[np.minimum((starts[:-1] + lo)[:, None] + at, len(points) - 1)], 0)
    known, codes = np.unique(codes, return_inverse=True)  # 0 is no letter
    codes = codes.reshape(n, deep) + (known[0] != 0)
    letters, width = len(known) + (known[0] != 0), -(-n // 64)

    def bits(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), width * 8), np.uint8)
        packed = np.packbits(rows, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    index = [bits(codes[:, p] == np.arange(1, letters)[:, None]) for p in range(deep)]
    index = [np.concatenate([np.zeros((1, width), np.uint64), x]) for x in index]
    key, of_key = np.unique(g.key.to_numpy(np.int64), return_inverse=True)
    long = length > m
    lengths = bits(np.stack([~long, long]))
    pairs: list[tuple[int, int]] = []
    asked = np.flatnonzero(~long)
    asked = asked[np.lexsort((asked, size[asked]))]
    step = max(1, _QUERIES // (8 * width))
    for a in range(0, len(asked), step):
        q = asked[a : a + step]
        none = bits(of_key == of_key[q][:, None])
        replaced, inserted = np.zeros_like(none), none.copy()
        hit = np.zeros_like(none)
        for i in range(int(size[q].max()) + 1):
            over = np.flatnonzero(size[q] == i)
            hit[over] = (replaced[over] & lengths[0]) | (inserted[over] & lengths[1])
            if over.size == len(q) or i == deep - 1:
                break
            here, shifted = index[i][codes[q, i]], index[i + 1][codes[q, i]]
            replaced = (replaced & here) | (none & ~here)
            none = none & here
            inserted = (inserted & shifted) | none
        where, what = np.nonzero(hit)
        for r, w in zip(where, what):
            left = int(hit[r, w])
            while left:
                low = left & -left
                pairs.append((int(q[r]), int(w) * 64 + low.bit_length() - 1))
                left ^= low
    return [(i, j) for i, j in pairs if _met(words[i], words[j], int(m[i]), int(lo[i]), int(hi[i]))]


def _met(u: str, v: str, m: int, lo: int, hi: int) -> bool:
    """Whether u and v agree outside the middle, and this key is the one of all under which they meet that counts: the first half's where both halves agree."""
    if u[:lo] != v[:lo] or hi and u[-hi:] != v[-hi:]:
        return False
    if not hi:
        return True
    alike = 0
    while alike < m and u[alike] == v[alike]:
        alike += 1
    return alike < m - hi


def near_words(words: DataFrame, middle: int = MIDDLE, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: for words(word, n), each once, that have any: how many words are one edit away, and the most frequent (the smallest of equals)."""
    entries = stored(meeting_words(words, middle, crowd), "entries")
    blocks = max(1, entries.count() // block)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        best: dict[str, tuple[int, int, str]] = {}
        names, n = list(g.word), g.n.tolist()
        length, m = g.word.str.len().to_numpy(), g.m.to_numpy()
        for i, j in near_in_block(g):
            for a, b in ((i, j), (j, i)) if length[j] > m[j] else ((i, j),):
                many, top, name = best.get(names[a], (0, -1, ""))
                if n[b] > top or n[b] == top and names[b] < name:
                    top, name = n[b], names[b]
                best[names[a]] = (many + 1, top, name)
        return pd.DataFrame([(w, *x) for w, x in best.items()], columns=["word", "n_near", "best_n", "best"])

    found = entries.groupBy(F.pmod("key", F.lit(blocks)).alias("block")).applyInPandas(lambda _, g: compare(g), "word string, n_near long, best_n long, best string")
    top = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return top.select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that forms(word, form) lead to, found by doubling. There are no circles."""
    led = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(led.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        led = step.select("word", "root")
        if step.where("moved").isEmpty():
            return led


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for words(word, n), each once.

    A word's form is its most frequent near word if that is ``ratio`` times as
    frequent; root is the last of the forms, or the word. A table without rows
    gives none; words without near ones have n_near 0.
    """
    words = stored(words.select("word", "n"), "words")
    near = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    told = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "told")
    led = roots(told.where("form is not null"))
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir):
    """Words of all documents with their near words and forms. Rows count each, repeated ones too; null texts have no words, and a null id is empty in the checksum."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))
