"""Mixing of sources to target weights by Sainte-Lague apportionment.

Each source gets a target number of words. All targets together are laid out in
blocks of equal size, which go to the sources by highest quotient
target / (2 k + 1); each source's blocks go on to groups of its shards, and from
there to the shards, in the same way. With blocks of a word, the smallest source
comes within a word of its target, and no shard gets more than its share.

In a shard the documents stand in seeded order, one behind another, and this
line is cut into pages. A shard is read as many times as its quota holds it
wholly; the rest of the quota takes pages in the order of seeded hashes, the
last one in part.

The table with a row per source is sorted as a whole, shards only inside their
group; documents meet only inside their shard, whose words and rows are bounded
(but for a single longer document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, stored, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Words and rows of a shard, about, and shards of a group.
SHARD_WORDS, SHARD_ROWS, GROUP_SHARDS = 65_536, 16_384, 4_096
#: Words in a block of the apportionment, and in a page of a shard.
BLOCK_WORDS, PAGE_WORDS = 1, 128


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank, target for sizes(source, source_size).

    Targets are weight * level, but at most ``most`` times the source's size,
    with the level at which they sum to ``share`` of all words. Sorted by the
    level at which a source is full, the level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("weights_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("all_weight", F.sum("weight").over(everything)).withColumn("all_words", F.sum("source_size").over(everything))
    level = (F.col("all_words") * float(share) - F.col("caps_before")) / (F.col("all_weight") - F.col("weights_before"))
    s = s.withColumn("level", level)
    # the level is that of the first source that does not fill up at it; with none, all are full
    s = s.withColumn("at", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at")))
    return s.select("source", "source_size", "rank", F.greatest(target, F.lit(0.0)).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, order: list[str], within: list[str]) -> DataFrame:
    """parties with a column ``seats_won``: whole seats by highest quotient, ties by ``order``.

    Seats whose quotient is above total / (2 N - S) are sure (N seats, S
    parties); those below total / (2 N + S) are never won. Only the few between
    are listed and ranked, about two for each party, however many seats there
    are. ``seats`` is the number of seats of the group ``within``.
    """
    group = Window.partitionBy(*[F.col(c) for c in within]) if within else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_n", seats.cast("double")).withColumn("_v", F.col(votes).cast("double"))
    p = p.withColumn("_total", F.sum("_v").over(group)).withColumn("_s", F.sum(F.when(F.col("_v") > 0, 1).otherwise(0)).over(group))
    upto = lambda q: F.floor((F.col("_v") / q + 1) / 2)  # noqa: E731  seats with a quotient of q at least
    sure = F.when((F.col("_v") > 0) & (2 * F.col("_n") > F.col("_s")), F.greatest(F.lit(0), upto(F.col("_total") / (2 * F.col("_n") - F.col("_s"))) - 1)).otherwise(F.lit(0))
    last = F.when((F.col("_v") > 0) & (F.col("_n") > 0), upto(F.col("_total") / (2 * F.col("_n") + F.col("_s"))) + 1).otherwise(F.lit(0))
    p = p.withColumn("_sure", sure.cast("long")).withColumn("_last", last.cast("long"))
    p = p.withColumn("_left", F.col("_n") - F.sum("_sure").over(group))
    listed = p.where(F.col("_last") > F.col("_sure")).select(*within, *[c for c in order if c not in within], "_v", "_left", F.explode(F.sequence("_sure", F.col("_last") - 1)).alias("_k"))
    quotient = F.col("_v") / (2 * F.col("_k") + 1)
    ranked = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_k"))
    won = listed.withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= F.col("_left"))
    won = won.groupBy(*dict.fromkeys([*within, *order])).agg(F.count(F.lit(1)).alias("_more"))
    keys = list(dict.fromkeys([*within, *order]))
    joined = p.alias("p").join(won.alias("w"), [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys], "left")
    return joined.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("p._sure") + F.coalesce(F.col("w._more"), F.lit(0))).alias("seats_won"))


def _apportioned(shards: DataFrame, won: DataFrame) -> DataFrame:
    """shards(rank, shard, shard_size) with seats_won, from won(rank, blocks_won): first by groups of shards, then inside each."""
    s = shards.withColumn("grp", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = s.groupBy("rank", "grp").agg(F.sum("shard_size").alias("grp_size")).join(won, "rank")
    groups = sainte_lague(groups, "grp_size", F.col("blocks_won"), ["grp"], ["rank"]).select("rank", "grp", F.col("seats_won").alias("grp_won"))
    return sainte_lague(s.join(groups, ["rank", "grp"]), "shard_size", F.col("grp_won"), ["shard"], ["rank", "grp"])


def _pages(seed: int, page: int) -> Column:
    """For each page of a shard, in order, how many of its first words are taken: pages by seeded hash until ``rest`` words are."""
    n = F.ceil(F.col("shard_size") / page).cast("int")
    short = n * page - F.col("shard_size")  # the last page lacks this many words
    named = lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("rank"), F.col("shard"), i).alias("h"), i.alias("i"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), named))

    def taken(x, j):
        before = j * page - F.when(x > named(n - 1), short).otherwise(0)
        words = F.lit(page) - F.when(x["i"] == n - 1, short).otherwise(0)
        return F.struct(x["i"].alias("i"), F.greatest(F.lit(0), F.least(words, F.col("rest") - before)).cast("int").alias("n"))

    return F.when(F.col("rest") > 0, F.transform(F.array_sort(F.transform(order, taken)), lambda x: x["n"]))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, block_words: int = BLOCK_WORDS, page_words: int = PAGE_WORDS) -> DataFrame:
    """What the mix takes of each row: doc_id, text_hash, size, source_size, target, taken, pieces.

    ``taken`` words are the document's words as often as its shard is read
    wholly, and those of its ``pieces`` (from, n: words counted from 0). Null
    texts have size 0 and nothing is taken of them; a null source is a source of
    its own, last in order. Rows that repeat are rows of their own: which of
    equal rows gets which share of both is open, the shares are not. An empty
    table gives no rows. Other columns of docs are ignored.
    """
    salt = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    # a row's shard comes from this hash; equal rows are put in some order, which changes nothing
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), salt.alias("text_hash")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(sizes.drop("source_rows"), weights, share, most)
    alone = Window.partitionBy(F.lit(0))
    t = targets.withColumn("n_blocks", F.round(F.sum("target").over(alone) / block_words))
    t = sainte_lague(t, "target", F.col("n_blocks"), ["rank"], []).withColumnRenamed("seats_won", "blocks_won").alias("t")
    z = sizes.alias("z")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("z.source_size") / shard_words), F.ceil(F.col("z.source_rows") / shard_rows)).cast("long")
    t = stored(t.join(z, F.col("t.source").eqNullSafe(F.col("z.source"))).select("t.*", n_shards.alias("n_shards")), "targets")
    r = rows.alias("r").join(t.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    r = r.select("r.doc_id", "r.text_hash", "r.size", "t.rank", "t.source_size", "t.target", F.pmod(F.shiftright(F.col("text_hash"), 20), F.col("t.n_shards")).alias("shard"))
    shards = r.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    q = _apportioned(shards, t.select("rank", "blocks_won"))
    quota = (F.col("seats_won") * block_words).cast("long")
    rounds = F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    q = q.select("rank", "shard", "shard_size", quota.alias("quota"), rounds.alias("rounds")).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("shard_size"))
    q = q.select("rank", "shard", "rounds", _pages(seed, page_words).alias("pages"))
    laid = Window.partitionBy("rank", "shard").orderBy("text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("at", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    r = r.join(q, ["rank", "shard"])

    def piece(p):
        """What the document has of the taken words of a page."""
        begin = F.greatest(F.col("at"), p * page_words)
        end = F.least(F.col("at") + F.col("size"), p * page_words + F.element_at("pages", (p + 1).cast("int")))
        return F.struct((begin - F.col("at")).alias("from"), (end - begin).alias("n"))

    own = F.sequence(F.floor(F.col("at") / page_words), F.floor((F.col("at") + F.col("size") - 1) / page_words))
    pieces = F.when(F.col("pages").isNotNull() & (F.col("size") > 0), F.filter(F.transform(own, piece), lambda x: x["n"] > 0))
    none = F.array().cast("array<struct<from:bigint,n:bigint>>")
    r = r.withColumn("pieces", F.coalesce(pieces, none))
    taken = F.col("rounds") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return r.select("doc_id", "text_hash", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", taken.cast("long").alias("taken"), "pieces")


def mix_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: each row once for each whole
    pass over it, and once more with the words of its pieces. n_chars, if there
    is such a column, follows the text. Null and empty texts are not in the mix;
    rows that repeat (doc_id and text) each follow a plan of their own, dealt
    out in the order of a hash of all columns.
    """
    plan = mixing_plan(docs, seed=seed, **options).select("doc_id", "text_hash", "size", "taken", "pieces")
    quote = lambda c: f"`{c}`"
    key = fresh(docs, "text_hash")
    d = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    nth = fresh(d, "nth")
    plan = stored(plan, "mixing-plan")
    again = plan.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", "text_hash")
    if again.limit(1).count():
        every = F.xxhash64(*[quote(c) for c in docs.columns])
        d = d.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(every)))
        plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("taken", "pieces")))
    else:
        d, plan = d.withColumn(nth, F.lit(1)), plan.withColumn("nth", F.lit(1))
    p, d = plan.where("taken > 0").alias("p"), d.alias("d")
    j = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col(f"d.{key}") == F.col("p.text_hash")) & (F.col(f"d.{nth}") == F.col("p.nth")))
    whole = F.floor(F.col("p.taken") / F.col("p.size")).cast("int")
    part = F.col("p.taken") > whole * F.col("p.size")
    words = F.filter(F.split(F.col("d.text"), SPACE), lambda w: w != "")
    # the words are bound once: inside the inner function they would be split again for each piece
    cut = F.transform(F.array(words), lambda w: F.concat_ws(" ", F.flatten(F.transform("p.pieces", lambda x: F.slice(w, (x["from"] + 1).cast("int"), x["n"].cast("int"))))))
    texts = F.concat(F.array_repeat(F.col("d.text"), whole), F.when(part, cut).otherwise(F.array().cast("array<string>")))
    e = j.select(*[F.col(f"d.{quote(c)}") for c in docs.columns if c.lower() != "text"], F.explode(texts).alias("text"))
    if "n_chars" in docs.columns:
        e = e.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return e.select(*[quote(c) for c in docs.columns])


def op4_mixing(spark, sf_dir):
    """What the mix takes of each row of documents; odd rows as in mixing_plan()."""
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
