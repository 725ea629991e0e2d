"""Exact Jaccard join of word shingle sets, with set-relation skipping.

1. Each document's shingle set is hashed. The hashes go, packed, to buckets by
   value, which return to each document those it shares with another one, with
   their document frequency. What a document shares with no other can't meet.
2. In a set ordered by (frequency, hash), two sets that link share a hash within
   their first n - ceil(t n) + 1. Only the shared part of these prefixes becomes
   index entries, so a passage in very many documents is in few of them.
3. Relations between sets: in each index list and band of sizes one set stands
   for the others; each set is verified against the one it meets most often. If
   they link, that set is its leader, and the two differences are kept.
4. Index lists hold leaders only. While lists hold many pairs of leaders of
   different components, each leader meets one head of each of its lists, and
   components grow: a group of near copies becomes one component in a few rounds,
   each linear in the lists.
5. Then, in blocks of sizes, a leader visits just those blocks that its position
   in the list leaves possible, and just leaders that are not yet in its
   component. A pair of leaders is intersected once. What their members share
   follows from the intersection and the differences: most members are decided
   by bounds, others by intersecting the differences alone.

Equal sets, within 2^-20 or less for each hash, are one class and never paired.
All links between different sets count towards the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.graph import connected_components

from .common import fresh, stored, table
from .shingles import common, fingerprints, joined_arrays, pack, parts_of, shingle_sets, unpack

WORDS, THRESHOLD = 5, 80
#: Documents hashed at once; hashes in a bucket, about; documents of a batch from which a hash is counted before it is sent.
BATCH_DOCS, BUCKET_HASHES, HOT_IN_BATCH = 2_048, 300_000, 2
#: Rounds of heads go on while lists hold more open pairs than this many times their entries, and each round halves them.
OPEN_PAIRS = 16
#: Members that are compared at once.
PIECE = 256
_IDX = 16


def prefix_length(n: int, threshold: int) -> int:
    return n + (-threshold * n // 100) + 1


def links(inter, a, b, threshold: int):
    return 100 * inter >= threshold * (a + b - inter)


def _bytes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


def _shared_hashes(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """For each row of docs: node, doc_id, key, n, fp1, fp2 and, where its prefix holds shared hashes,
    hashes (packed, all that it shares), prefix (packed) and alone (how many of its hashes stand before).
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    total = max(1, size // 5)
    bits = min(62, max(32, math.ceil(math.log2(total)) + 20))
    buckets = max(1, total // BUCKET_HASHES)
    width = -(-(1 << bits) // buckets)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 20
        for frame in batches:
            for at in range(0, len(frame), BATCH_DOCS):
                f = frame.iloc[at : at + BATCH_DOCS]
                ids = f.doc_id.array
                values, counts = shingle_sets([t.encode() if t else b"" for t in f.text], words, bits)
                fp1, fp2 = fingerprints(values, counts)
                known = np.array([not pd.isna(x) for x in ids], bool)
                keys = f.key.to_numpy(np.int64)
                doc_ids = np.array([int(x) if ok else 0 for x, ok in zip(ids, known)], np.int64)
                _, firsts = np.unique(np.stack([fp1, fp2]), axis=1, return_index=True)
                speaks = np.zeros(len(f), bool)  # one of equal sets stands for the batch's others
                speaks[firsts] = True
                speaks &= counts > 0
                owner = np.repeat(np.arange(len(f)), counts)
                use = speaks[owner]
                tokens, owner = values[use], owner[use].astype(np.uint16)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                rows = []
                if len(tokens):
                    new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                    run = np.diff(np.append(new, len(tokens)))
                    hot = np.repeat(run >= HOT_IN_BATCH, run)
                    pick = run >= HOT_IN_BATCH
                    parts = [("p", tokens[~hot], owner[~hot])]
                    if pick.any():
                        parts.append(("c", tokens[new[pick]], run[pick].astype(np.uint16)))
                        rows.append((-1 - number, number, joined_arrays(_bytes(b"h"), _bytes(pack(tokens[hot])), owner[hot])))
                    for kind, tok, what in parts:
                        cuts = np.searchsorted(tok, np.arange(1, buckets, dtype=np.uint64) * np.uint64(width))
                        for k, (t, o) in enumerate(zip(np.split(tok, cuts), np.split(what, cuts))):
                            if len(t):
                                rows.append((k, number, joined_arrays(_bytes(kind.encode()), _bytes(pack(t)), o)))
                rows.append((-1 - number, number, joined_arrays(_bytes(b"d"), doc_ids, known, keys, counts, fp1, fp2)))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "blob"])
                number += 1

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        if g.bucket.iloc[0] < 0:  # what a batch tells itself
            return g[["batch", "blob"]]
        got = [parts_of(bytes(b)) for b in g.blob]
        toks = [unpack(p[1]) for p in got]
        nums = [np.frombuffer(p[2], np.uint16).astype(np.int64) for p in got]
        weight = [n if p[0] == b"c" else np.ones(len(n), np.int64) for p, n in zip(got, nums)]
        distinct, back = np.unique(np.concatenate(toks), return_inverse=True)
        df = np.bincount(back, np.concatenate(weight), len(distinct)).astype(np.int64)
        rows, at = [], 0
        for p, t, n, batch in zip(got, toks, nums, g.batch):
            d = df[back[at : at + len(t)]]
            at += len(t)
            keep = d > 1
            if keep.any():
                what = _bytes(b"C") if p[0] == b"c" else _bytes(b"P")
                rows.append((batch, joined_arrays(what, _bytes(pack(t[keep])), n[keep].astype(np.uint16), d[keep].astype(np.uint32))))
        return pd.DataFrame(rows, columns=["batch", "blob"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        got = [parts_of(bytes(b)) for b in g.blob]
        doc_ids, known, keys, counts, fp1, fp2 = (np.frombuffer(x, t) for x, t in zip(next(p for p in got if p[0] == b"d")[1:], (np.int64, bool, np.int64, np.int64, np.int64, np.int64)))
        toks, own, dfs = [], [], []
        for p in got:
            if p[0] == b"P":
                toks.append(unpack(p[1]))
                own.append(np.frombuffer(p[2], np.uint16))
                dfs.append(np.frombuffer(p[3], np.uint32))
        hot = [p for p in got if p[0] == b"h"]
        if hot:  # hashes of very many documents of the batch: their frequencies came as counts
            t = np.concatenate([unpack(p[1]) for p in hot])
            c = [p for p in got if p[0] == b"C"]
            ct, cd = np.concatenate([unpack(p[1]) for p in c]), np.concatenate([np.frombuffer(p[3], np.uint32) for p in c])
            order = np.argsort(ct)
            toks.append(t)
            own.append(np.concatenate([np.frombuffer(p[2], np.uint16) for p in hot]))
            dfs.append(cd[order][np.searchsorted(ct[order], t)])
        n_docs = len(doc_ids)
        hashes, prefix, alone = [None] * n_docs, [None] * n_docs, np.zeros(n_docs, np.int64)
        if toks:
            t, o, d = np.concatenate(toks), np.concatenate(own), np.concatenate(dfs)
            order = np.lexsort((t, d, o))
            t, o = t[order], o[order]
            cuts = np.searchsorted(o, np.arange(n_docs + 1))
            for i in np.unique(o):
                s = t[cuts[i] : cuts[i + 1]]
                n = int(counts[i])
                alone[i] = n - len(s)
                take = prefix_length(n, threshold) - int(alone[i])
                if take > 0:
                    prefix[i] = s[:take].tobytes()
                    hashes[i] = pack(np.sort(s))
        node = (int(g.batch.iloc[0]) << _IDX) + np.arange(n_docs)
        ids = pd.array(np.where(known, doc_ids, 0), "Int64")
        ids[~known] = pd.NA
        return pd.DataFrame({"node": node, "doc_id": ids, "key": keys, "n": counts, "fp1": fp1, "fp2": fp2, "hashes": hashes, "prefix": prefix, "alone": alone})

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInPandas(send, "bucket long, batch long, blob binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "batch long, blob binary")
    return met.groupBy("batch").applyInPandas(gather, "node long, doc_id long, key long, n long, fp1 long, fp2 long, hashes binary, prefix binary, alone long")


def _band(n, threshold: int):
    """Sizes that may link are in the same band or the next ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / threshold)) + 1e-9).cast("int")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: int, differences: bool) -> DataFrame:
    """pairs(a, b) with inter, na, nb and, if asked for, plus (a without b) and minus (b without a), packed."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))

    def intersect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            inter, plus, minus = [], [], []
            last, b = None, None
            for ha, hb in zip(f.ha, f.hb):
                if hb != last:
                    last, b = hb, unpack(hb)
                a = unpack(ha)
                inter.append(common(a, b))
                if differences:
                    plus.append(pack(np.setdiff1d(a, b, assume_unique=True)))
                    minus.append(pack(np.setdiff1d(b, a, assume_unique=True)))
            out = f[["a", "b", "na", "nb"]].assign(inter=inter)
            yield out.assign(plus=plus if differences else None, minus=minus if differences else None)

    j = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb")
    return j.mapInPandas(intersect, "a long, b long, na long, nb long, inter long, plus binary, minus binary")


def _member_links(ambiguous: DataFrame, members: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """a, b of members that link, for pairs of leaders (a, b, inter); one for each pair of pieces is enough.

    For a member x of leader r and a set c, |x & c| = |r & c| - |(r - x) & c| + |(x - r) & c|.
    """

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        r, s = unpack(f.hr.iloc[0]), unpack(f.hs.iloc[0])
        piece = lambda k: [(int(m["node"]), int(m["n"]), unpack(m["plus"]), unpack(m["minus"])) for m in f[k].iloc[0]]
        mine = piece("pr")
        for y, ny, plus, minus in piece("ps"):
            c = np.union1d(np.setdiff1d(s, minus, assume_unique=True), plus)
            rc = common(r, c)
            for x, nx, more, less in mine:
                if not links(min(rc + len(more), nx, ny), nx, ny, threshold):
                    continue
                if links(rc - common(less, c) + common(more, c), nx, ny, threshold):
                    found.append((x, y))
                    break
            if found:
                break
        return pd.DataFrame(found, columns=["a", "b"])

    own = nodes.join(ambiguous.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    empty = F.lit(bytearray(pack(np.empty(0, np.uint64))))
    selves = own.select(F.col("node").alias("leader"), "node", "n", empty.alias("plus"), empty.alias("minus"))
    m = selves.unionByName(members.select("leader", "node", "n", "plus", "minus"))
    counts = m.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("k"))
    m = m.join(counts, "leader")
    part = F.pmod(F.xxhash64("node"), F.col("k"))
    pieces = m.withColumn("part", part).groupBy("leader", "part").agg(F.collect_list(F.struct("node", "n", "plus", "minus")).alias("p"))
    pieces = pieces.join(own.select(F.col("node").alias("leader"), "hashes"), "leader")
    left = pieces.select(F.col("leader").alias("a"), F.col("part").alias("i"), F.col("p").alias("pr"), F.col("hashes").alias("hr"))
    right = pieces.select(F.col("leader").alias("b"), F.col("part").alias("j"), F.col("p").alias("ps"), F.col("hashes").alias("hs"))
    j = ambiguous.select("a", "b").join(left, "a").join(right, "b")
    return j.groupBy("a", "b", "i", "j").applyInPandas(compare, "a long, b long")


def _fits(p: str, h: str, threshold: int) -> Column:
    """Whether the sizes, and the rests from the common hash on, of two entries leave a link possible."""
    c = lambda side, name: F.col(f"{side}.{name}")
    enough = F.least(c(p, "rest"), c(h, "rest")) * (100 + threshold) >= (c(p, "lo") + c(h, "lo")) * threshold
    return (c(h, "lo") * threshold <= c(p, "hi") * 100) & (c(p, "lo") * threshold <= c(h, "hi") * 100) & enough


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels.withColumnRenamed("node", "leader"), "leader", "left").withColumn("label", F.coalesce("component", "leader")).drop("component")


def _merged(lists: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The lists that hold several components, after rounds in which leaders meet heads; the labels then; links found; pairs tested (None without a round).

    In a round every list has one head for each band of sizes, another one in
    each round, and every leader of another component meets it. Rounds end when
    few pairs are open, or a round leaves more than half of them.
    """
    # lists with the same leaders are one list, known by a hash of its leaders: a pair in many lists meets in few
    named = _labelled(lists, labels)
    known = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.bit_xor(F.xxhash64("leader")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "leader")).alias("s2")).where("x != y")
    left = named.join(known.select("token", "s1", "s2"), "token").groupBy("s1", "s2", "leader").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"))
    open_lists = stored(_labelled(left, labels), "open-lists")
    edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).limit(0)
    tested, number, before = None, 0, math.inf
    while True:
        sizes = open_lists.groupBy("s1", "s2", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("s1", "s2").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"))
        most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("within")) / 2, F.lit(0.0))).first()
        if most[1] <= OPEN_PAIRS * most[0] or most[1] > before / 2:
            return open_lists, labels, edges, tested
        before = most[1]
        band = open_lists.withColumn("band", _band(F.col("lo"), threshold))
        heads = band.groupBy("s1", "s2", "band").agg(F.min_by(F.struct("leader", "label", "lo", "hi", "rest"), F.xxhash64(F.lit(number), "leader")).alias("h"))
        met = band.alias("p").join(heads, ["s1", "s2", "band"]).where((F.col("p.label") != F.col("h.label")) & _fits("p", "h", threshold))
        met = met.select(F.least("p.leader", "h.leader").alias("a"), F.greatest("p.leader", "h.leader").alias("b")).distinct()
        if tested is not None:
            met = met.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = stored(_verified(met, nodes, threshold, False), "head-links")
        tested = new if tested is None else tested.unionByName(new)
        found = stored(new.where(links(F.col("inter"), F.col("na"), F.col("nb"), threshold)).select("a", "b"), "heads-linked")
        edges = edges.union(found)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        between = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = connected_components(between)
        # every node of found gets a label, and every label the one that it became
        all_labels = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node")))
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = stored(all_labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        again = _labelled(open_lists.drop("label"), labels)
        mixed = again.groupBy("s1", "s2").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("s1", "s2")
        open_lists = stored(again.join(mixed, ["s1", "s2"]), "open-lists")
        number += 1


def set_relation_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles, component_id and group_id for each row of docs.

    group_id tells the components apart; it is null for empty sets.
    """
    rows = stored(_shared_hashes(docs, words, threshold), "sets")
    nodes = rows.where("prefix is not null")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            got = [np.frombuffer(p, np.int64) for p in f.prefix]
            per = np.array([len(x) for x in got])
            if len(got):
                pos = np.concatenate([np.arange(a, a + k) for a, k in zip(f.alone, per)])
                yield pd.DataFrame({"token": np.concatenate(got), "node": np.repeat(f.node.to_numpy(), per), "n": np.repeat(f.n.to_numpy(), per), "pos": pos})

    index = nodes.select("node", "n", "alone", "prefix").mapInPandas(entries, "token long, node long, n long, pos long")
    index = stored(index.withColumn("band", _band(F.col("n"), threshold)), "index")
    # 3. relations
    heads = index.groupBy("token", "band").agg(F.min("node").alias("head"), F.max("node").alias("other")).where("head != other").select("token", "band", "head")
    meets = index.join(heads, ["token", "band"]).where("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    best = meets.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m"))
    pairs = best.select(F.col("node").alias("a"), (-F.col("m")["h"]).alias("b"))
    tested = stored(_verified(pairs, nodes, threshold, True), "relations")
    near = tested.where(links(F.col("inter"), F.col("na"), F.col("nb"), threshold))
    # a leader that follows another one keeps its own members: components join them
    followers = near.select(F.col("b").alias("leader"), F.col("a").alias("node"), F.col("na").alias("n"), "plus", "minus")
    first = near.select("a", "b")
    labels = connected_components(first)
    # 4. leaders' index lists
    by_member = followers.select("node", "leader")
    e = index.join(by_member, "node", "left").select("token", F.coalesce("leader", "node").alias("leader"), "n", "pos")
    own = index.join(by_member.select(F.col("leader").alias("node")).distinct(), "node").select("token", F.col("node").alias("leader"), "n", "pos")
    rest = F.col("n") - F.col("pos")
    lists = stored(e.union(own).groupBy("token", "leader").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(rest).alias("rest")), "lists")
    open_lists, labels, heads_linked, tested = _merged(lists, labels, nodes, threshold)
    # 5. pairs of leaders
    t = F.lit(threshold)
    # of two leaders, that with the smaller sets visits the other in the block of the other's smallest set. Sets of sizes
    # n and m link only if the rest of either, from their first common hash on, reaches t / (1 + t) (n + m): the blocks
    # that a leader visits end at the largest such m, and where that is under n, it visits none
    reach = F.least(F.floor(F.col("hi") * 100 / t), F.floor(F.col("rest") * (100 + t) / t) - F.col("lo"))
    low = _band(F.col("lo"), threshold)
    probe = open_lists.withColumn("reach", reach).where("reach >= lo").withColumn("block", F.explode(F.sequence(low, _band(F.col("reach"), threshold)))).drop("reach")
    p, h = probe.alias("p"), open_lists.withColumn("block", low).alias("h")
    once = F.struct("p.lo", "p.leader") < F.struct("h.lo", "h.leader")
    met = p.join(h, ["s1", "s2", "block"]).where((F.col("p.label") != F.col("h.label")) & once & _fits("p", "h", threshold))
    met = met.select(F.least("p.leader", "h.leader").alias("a"), F.greatest("p.leader", "h.leader").alias("b")).distinct()
    if tested is not None:
        met = met.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    among = stored(_verified(stored(met, "leader-pairs"), nodes, threshold, False), "leader-links")
    if tested is not None:
        # pairs that rounds have tested and left in different components: their members may still link
        far = tested.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        among = among.unionByName(far.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*among.columns))
    linked = among.where(links(F.col("inter"), F.col("na"), F.col("nb"), threshold)).select("a", "b").union(heads_linked)
    # members: what they may share beyond their leaders is bounded by the differences
    unsure = among.where(~links(F.col("inter"), F.col("na"), F.col("nb"), threshold))
    wide = near.groupBy("b").agg(F.max(F.col("na") - F.col("inter")).alias("plus"), F.min("na").alias("lo"))
    wa, wb = wide.select(F.col("b").alias("a"), F.col("plus").alias("pa"), F.col("lo").alias("la")), wide.select("b", F.col("plus").alias("pb"), F.col("lo").alias("lb"))
    u = unsure.join(wa, "a", "left").join(wb, "b", "left")
    most = F.col("inter") + F.coalesce("pa", F.lit(0)) + F.coalesce("pb", F.lit(0))
    u = u.where((F.col("pa").isNotNull() | F.col("pb").isNotNull()) & (most * 100 >= t * F.greatest(F.least("na", F.coalesce("la", "na")), F.least("nb", F.coalesce("lb", "nb")))))
    ambiguous = stored(u.select("a", "b", "inter"), "ambiguous")
    deep = _member_links(ambiguous, followers, nodes, threshold) if ambiguous.limit(1).count() else None
    edges = first.union(linked) if deep is None else first.union(linked).union(deep)
    # sets that are equal are one class, known by its smallest node
    full = rows.where("n > 0")
    classes = stored(full.groupBy("fp1", "fp2").agg(F.min("node").alias("class"), F.min("doc_id").alias("low")), "classes")
    copies = rows.where("prefix is not null").join(classes, ["fp1", "fp2"]).select(F.col("node").alias("a"), F.col("class").alias("b"))
    groups = connected_components(edges.union(copies.where("a != b")))
    in_group = classes.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("g", F.coalesce("component", "class"))
    lowest = in_group.groupBy("g").agg(F.min("low").alias("component_id"))
    by_class = in_group.join(lowest, "g").select("fp1", "fp2", "component_id", "g")
    empty = rows.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    met = full.join(by_class, ["fp1", "fp2"]).select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.col("g").alias("group_id"))
    return met.unionByName(empty)


def set_relation_join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; links are made at Jaccard >= threshold / 100.

    component_id is the smallest doc_id reachable. Null and empty texts, and
    texts without words, have an empty set and link with nothing, so they are
    their own components. A row with a null doc_id takes part in linking; its
    component_id is null only where all of the component's ids are. Rows that
    repeat get the same component. An empty table gives no rows.
    """
    return set_relation_groups(docs, words, threshold).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then text hash.

    Rows with empty sets, linked with nothing, all stay. Of rows that repeat
    doc_id and text, that with the smallest hash of all its columns stays.
    """
    groups = stored(set_relation_groups(docs, words, threshold).where("group_id is not null"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    first = groups.groupBy("group_id").agg(F.min(place).alias("first"))
    losers = groups.join(first, "group_id").where(place != F.col("first")).select("doc_id", "key").distinct().alias("l")
    key = fresh(docs, "text_hash")
    d = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col(f"d.{key}") == F.col("l.key"))
    kept = d.join(losers, same, "left_anti")
    # what repeats wholly, id and text, has one winner
    again = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").alias("l")
    if not again.limit(1).count():
        return kept.drop(key)
    columns = [F.col(f"`{c}`") for c in kept.columns]
    once = kept.join(again, same, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("m"))
    once = once.select(*[F.col(f"m.`{c}`") for c in kept.columns])
    return kept.join(again, same, "left_anti").unionByName(once).drop(key)


def op7_set_join(spark, sf_dir):
    return set_relation_join(table(spark, sf_dir, "documents"))
