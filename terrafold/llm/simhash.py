"""SimHash fingerprints of 128 bits, and a search for all within a Hamming radius.

A term is a run of three words. Its two 64-bit hashes vote on 128 signed bits,
and a term weighs as much as it occurs often: each occurrence casts its votes.
Four bits share a long while votes are added, so 32 sums count all of them, and
a task sends one row of sums a text. Texts with more terms than a lane can count
are counted in chunks, whose sums are added in wider lanes.

For the search a fingerprint is cut into BLOCKS blocks. Two that differ in at
most ``radius`` bits agree in BLOCKS - radius blocks at least, so a table for each
choice of so many blocks, keyed by those blocks, finds every one. Only keys that
queries have stay; a key's fingerprints are packed into pieces of a bounded
size, and queries meet pieces, so no pair becomes a row. A pair is counted in
the first table that has it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

TERM_WORDS = 3
RADIUS, BLOCKS = 6, 8
#: Fingerprints in a piece, about; and the share of ids that are queries.
PIECE, QUERY_EVERY = 512, 50
_CHUNK, _LANES, _WIDE = 32_767, 0x0001000100010001, 0x0000FFFF0000FFFF


def _words(text: Column) -> Column:
    """The hashes of the words of the text in lower case."""
    flat = F.lower(text)
    for space in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.transform(F.array_remove(F.split(flat, " "), ""), lambda w: F.xxhash64(w))


def fingerprints(texts: DataFrame, keys: list[str], size: int = TERM_WORDS) -> DataFrame:
    """keys, f1, f2: the two halves of the fingerprint of each text(keys, text).

    A text with fewer words than a term is one term. Null and empty texts and
    those without words have none, and no bit set. Keys are unique, or equal only
    for equal texts, which count once. Other columns are ignored. A table without
    rows gives none. Where texts are dealt by some of the keys already, nothing is
    shuffled.
    """
    own = [f"k{i}" for i in range(len(keys))]
    words = texts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], _words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    many = F.greatest(F.size("w") - (size - 1), F.signum(F.size("w")).cast("int"))
    terms = F.arrays_zip(*[F.slice("w", F.lit(k + 1), many) for k in range(size)])
    rows = words.select(*own, "row", F.posexplode_outer(terms).alias("at", "t"))
    says = F.col("t").isNotNull()
    first = rows.select(*own, "row", F.expr(f"at div {_CHUNK}").alias("chunk"), says.cast("long").alias("says"), F.when(says, F.xxhash64("t.*")).alias("h0"))
    hashes = first.withColumn("h1", F.when(F.col("h0").isNotNull(), F.xxhash64("h0")))
    votes = [F.sum(F.shiftrightunsigned(f"h{i}", k).bitwiseAND(F.lit(_LANES))).alias(f"v{i}_{k}") for i in range(2) for k in range(16)]
    # each row counts its own chunks, as a lane has room for one; those of equal texts are equal
    counted = hashes.groupBy(*own, "row", "chunk").agg(F.sum("says").alias("says"), *votes)
    chunks = counted.groupBy(*own, "chunk").agg(*[F.max(c).alias(c) for c in counted.columns if c not in (*own, "row", "chunk")])
    wide = [F.sum(F.shiftrightunsigned(f"v{i}_{k}", 16 * odd).bitwiseAND(F.lit(_WIDE))).alias(f"s{i}_{k}_{odd}") for i in range(2) for k in range(16) for odd in range(2)]
    summed = chunks.groupBy(*own).agg(F.sum("says").alias("said"), *wide)

    def half(i: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(16):
            for odd in range(2):
                s = F.col(f"s{i}_{k}_{odd}")
                for lane, bit in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), k + 16 * odd), (F.shiftrightunsigned(s, 32), k + 16 * odd + 32)):
                    out = out.bitwiseOR(F.when(2 * lane > F.col("said"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)))
        return out

    return summed.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], half(0).alias("f1"), half(1).alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def shown(f1: str, f2: str) -> Column:
    """A fingerprint as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _block(f1: Column, f2: Column, b: int, blocks: int) -> Column:
    bits = 128 // blocks
    f, low = (f1, b * bits) if b < blocks // 2 else (f2, b * bits - 64)
    if bits == 64:
        return f
    return F.shiftrightunsigned(f, low).bitwiseAND(F.lit((1 << bits) - 1))


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """prints, with a row for each table: key, its blocks and all blocks up to its last as bits."""
    rows = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.xxhash64(F.lit(t), *[_block(F.col("f1"), F.col("f2"), b, blocks) for b in chosen])
        rows.append(F.struct(key.alias("key"), F.lit(sum(1 << b for b in chosen)).alias("chosen"), F.lit((2 << chosen[-1]) - 1).alias("seen")))
    return prints.select("*", F.explode(F.array(*rows)).alias("t")).select(*prints.columns, "t.*")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """f1, f2, n_prints, n_docs for each of queries(f1, f2): how many prints(f1, f2, docs) lie within the radius, itself included, and their docs together.

    prints and queries have each fingerprint once. radius is under blocks, which
    is even and divides 128. Exact: hash collisions of keys are sorted out by the
    distance. A query that is no print of the table may have none: 0 and 0.
    """
    asked = _tables(queries.select("f1", "f2"), radius, blocks)
    met = _tables(prints.select("f1", "f2", "docs"), radius, blocks).select("key", "f1", "f2", "docs").join(asked.select("key").distinct(), "key", "left_semi")
    many = met.groupBy("key").agg(F.expr(f"1 + count(1) div {PIECE}").alias("pieces"))
    pieces = met.join(many, "key").groupBy("key", F.pmod(F.xxhash64("f1", "f2"), F.col("pieces")).alias("piece")).agg(F.collect_list(F.struct("f1", "f2", "docs")).alias("piece_of"))

    def first_met(x: Column) -> Column:
        x1, x2 = x["f1"].bitwiseXOR(F.col("f1")), x["f2"].bitwiseXOR(F.col("f2"))
        agree = F.lit(0)
        for b in range(blocks):
            agree = agree.bitwiseOR(F.when(_block(x1, x2, b, blocks) == 0, F.lit(1 << b)).otherwise(F.lit(0)))
        return (F.bit_count(x1) + F.bit_count(x2) <= radius) & (agree.bitwiseAND(F.col("seen")) == F.col("chosen"))

    near = asked.join(pieces.select("key", "piece_of"), "key").select("f1", "f2", F.filter("piece_of", first_met).alias("near"))
    counted = near.groupBy("f1", "f2").agg(F.sum(F.size("near")).alias("n_prints"), F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x["docs"])).alias("n_docs"))
    return queries.select("f1", "f2").join(counted, ["f1", "f2"], "left").select("f1", "f2", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_prints", "n_docs")])


#: Tells rows apart: 128 bits of the id and the text. Rows that repeat another wholly have its key.
KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the columns of KEY, and null texts empty."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")]
    return d.select("doc_id", "text", F.xxhash64(*both).alias("k1"), F.xxhash64(F.lit(1), *both).alias("k2"))


def followers(rows: DataFrame) -> DataFrame:
    """k1, k2, n_chars and n1, n2 (the next row's key) for rows(doc_id, KEY, n_chars) in descending doc_id, then by key; the first follows the last.

    Repeated rows count once, and null ids come last. The order is Spark's range
    partitioning, written once; the last row of each partition is led to the
    first of the next one by a table with a row for each partition.
    """
    order = [F.col("doc_id").desc_nulls_last(), *KEY]
    ranked = stored(rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    parts = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = parts.select("last", F.expr("coalesce(lead(first) over (order by part), min(first) over ())").alias("after"))
    led = ranked.join(ends, ranked["at"] == ends["last"], "left").select(*KEY, "n_chars", F.coalesce("after", F.col("at") + 1).alias("to"))
    return led.join(ranked.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("at").alias("to")), "to").drop("to")


def edited_texts(docs: DataFrame, led: DataFrame) -> DataFrame:
    """docs(doc_id, KEY, text) with edited: the text, its last half replaced by the start of the next one. Rows are dealt by KEY."""
    back = led.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.expr("n_chars div 2")).cast("int").alias("half"), F.col("n1").alias("k1"), F.col("n2").alias("k2"))
    starts = docs.join(back, KEY).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.col("half")).alias("start"))
    starts = starts.groupBy(*KEY).agg(F.min("start").alias("start"))  # of repeated rows
    n = F.length("text")
    return docs.join(starts, KEY).select("doc_id", *KEY, "text", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "start").alias("edited"))


def op11_simhash(spark, sf_dir):
    """Fingerprints of each row of documents and of its edited text, their likeness, and for ids divisible by 50 how many distinct fingerprints and documents lie within the radius (themselves included; null for the others).

    Null texts are empty. Rows that repeat another wholly, id and text, get the
    same result each. Likeness is the share of equal bits; 1 for two texts
    without words.
    """
    docs = keyed(table(spark, sf_dir, "documents"))
    rows = stored(docs.select("doc_id", *KEY, F.length("text").cast("long").alias("n_chars")), "rows")
    led = stored(followers(rows), "led")
    edited = edited_texts(docs, led)
    both = F.array(F.struct(F.lit(None).cast("binary").alias("sha"), "text"), F.struct(F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("text")))
    texts = edited.select(*KEY, F.explode(both).alias("t")).select(*KEY, "t.sha", "t.text")
    prints = stored(fingerprints(texts, [*KEY, "sha"]), "prints")
    own, changed = prints.where("sha is null").drop("sha"), prints.where("sha is not null").select(*KEY, "sha", F.col("f1").alias("c1"), F.col("f2").alias("c2"))

    after = led.select(*KEY, "n1", "n2").join(own.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("f1").alias("a1"), F.col("f2").alias("a2")), ["n1", "n2"]).drop("n1", "n2")
    like = lambda x, y: 1 - distance(F.col("f1"), F.col("f2"), F.col(x), F.col(y)) / 128.0
    told = own.join(changed, KEY).join(after, KEY).select(*KEY, "sha", "f1", "f2", "c1", "c2", like("c1", "c2").alias("near_edited"), like("a1", "a2").alias("near_next"))
    told = stored(rows.join(told, KEY).drop(*KEY), "told")

    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    near = within_radius(told.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("docs")), told.where(asked).select("f1", "f2").distinct())
    found = told.where(asked).join(near, ["f1", "f2"]).unionByName(told.where(~asked), allowMissingColumns=True)
    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown("f1", "f2").alias("fingerprint"), shown("c1", "c2").alias("edited_fingerprint"), "near_edited", "near_next",
        F.col("n_prints").alias("within_prints"), F.col("n_docs").alias("within_docs"),
    )
