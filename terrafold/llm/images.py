"""Copies of images by local descriptors: Hamming tables and geometric consensus.

Every image's corners become rows; a descriptor's bits are cut into TABLES
chunks, and descriptors that agree in one chunk meet in that table. Candidates
are kept by their Hamming distance and vote for where the image's centre lies in
the query, how much it is turned and how much it is resized; enough distinct
corners that vote alike make a match.

Images that are nearly the same as whole images form a class: in each list of
every table the smallest image stands for the others, and an image is tied to
the ones it meets in enough corners, in place. It is compared as a whole with
those, and with the smallest image that ties lead to; it follows one only if
most corners of both agree. Queries are matched with the leaders and with what
their followers have besides, so a large group of copies costs a row for each
copy; the result has leaders, and the leader of each image beside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.graph import connected_components

from .common import stored, table
from .features2d import TESTS, describe, resampling

SIZE = 96
TABLES, CHUNK_BITS = 8, 32
#: Bits in which matching descriptors may differ, corners that have to agree, and for a follower.
MAX_DISTANCE, MIN_INLIERS, MIN_SAME = 40, 3, 3
#: Share of either image's corners that a follower and its leader have in common, and rounds in which leaders are chosen.
SAME_SHARE, ROUNDS = 0.75, 3
_STACK = 256
#: Bits of a table are drawn from the whole descriptor.
_ORDER = np.random.default_rng(3).permutation(TESTS)[: TABLES * CHUNK_BITS]


def _cosines(n: int) -> np.ndarray:
    k = np.arange(8)
    return np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * (2 * k + 3 + k % 2)[None] / n).astype(np.float32)


def rendered(vectors: np.ndarray) -> np.ndarray:
    """Grey images (n, SIZE, SIZE) whose 64 cosine coefficients are the vectors."""
    c = np.nan_to_num(vectors.reshape(-1, 8, 8).astype(np.float32))
    b = _cosines(SIZE)
    x = b @ c @ b.T
    x /= x.std((1, 2), keepdims=True) + 1e-9
    return np.rint(np.clip(127.5 + 42 * x, 0, 255)).astype(np.uint8)


EDITS = ("crop", "crop, contrast and noise", "crop and quarter turn", "crop and resize")


def edited(image: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A cropped and otherwise edited copy, 72 pixels square (see EDITS)."""
    if kind == 1:
        noise = np.random.default_rng(seed).normal(0, 1.5, image.shape)
        image = np.clip(np.rint(0.8 * image + 25 + noise), 0, 255)
    elif kind == 2:
        image = np.rot90(image)
    elif kind == 3:
        m = resampling(SIZE, 1.25)
        return np.rint(m @ image @ m.T).astype(np.uint8)[2:74, 3:75]
    return image[10:82, 14:86].astype(np.uint8)


def images_from_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """image_id, pixels (bytes, row by row), height, width. A vector that is null or too short is padded with zeros."""

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), _STACK):
                g = f.iloc[at : at + _STACK]
                v = np.zeros((len(g), 64), np.float32)
                for i, x in enumerate(g.vector):
                    if x is not None:
                        a = np.asarray(x, np.float32)[:64]
                        v[i, : len(a)] = a
                yield pd.DataFrame({"image_id": g.image_id, "pixels": [x.tobytes() for x in rendered(v)], "height": SIZE, "width": SIZE})

    return rows.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector).alias("vector")).mapInPandas(render, "image_id long, pixels binary, height int, width int")


def sound(images: DataFrame) -> DataFrame:
    """The images that have an id and as many pixels as their height and width say."""
    return images.where("image_id is not null and height > 0 and width > 0 and octet_length(pixels) = height * width")


def edited_copies(images: DataFrame) -> DataFrame:
    """The sound images, edited in one of four ways by id."""

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, p, h, w in zip(f.image_id, f.pixels, f.height, f.width):
                e = edited(np.frombuffer(p, np.uint8).reshape(h, w), int(i) // 50 % 4, int(i))
                out.append((i, e.tobytes(), e.shape[0], e.shape[1]))
            yield pd.DataFrame(out, columns=["image_id", "pixels", "height", "width"])

    return sound(images).mapInPandas(edit, "image_id long, pixels binary, height int, width int")


def local_descriptors(images: DataFrame) -> DataFrame:
    """A row for each corner: image_id, corner, x, y (from the centre), scale, angle, d0..d3 (the bits) and chunks.

    Null and damaged pixels (not height times width of them), and images too
    small for a descriptor, have no rows. Other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (h, w), same in f.groupby(["height", "width"]):
                for at in range(0, len(same), _STACK):
                    g = same.iloc[at : at + _STACK]
                    d = describe(np.stack([np.frombuffer(p, np.uint8).reshape(int(h), int(w)) for p in g.pixels]))
                    i = d["image"].astype(int)
                    if not len(i):
                        continue
                    words = np.ascontiguousarray(d["bits"]).view(np.int64)
                    turned = np.unpackbits(d["bits"], axis=1)[:, _ORDER].reshape(len(i), TABLES, CHUNK_BITS)
                    chunks = np.packbits(turned, axis=2).view(">u4").reshape(len(i), TABLES).astype(np.int64)
                    order = np.argsort(i, kind="stable")
                    first = np.searchsorted(i[order], np.arange(len(g)))
                    corner = np.empty(len(i), np.int64)
                    corner[order] = np.arange(len(i)) - first[i[order]]
                    yield pd.DataFrame({"image_id": g.image_id.to_numpy()[i], "corner": corner, "x": d["x"] - (w - 1) / 2, "y": d["y"] - (h - 1) / 2, "scale": d["scale"], "angle": d["angle"], **{f"d{k}": words[:, k] for k in range(TESTS // 64)}, "chunks": list(chunks)})

    return sound(images.select("image_id", "pixels", "height", "width")).mapInPandas(run, "image_id long, corner int, x float, y float, scale float, angle float, d0 long, d1 long, d2 long, d3 long, chunks array<long>")


def _one_each(descriptors: DataFrame) -> DataFrame:
    """Of rows with equal image_id and corner, the smallest: equal ids with different pixels give the same in every run."""
    rest = [c for c in descriptors.columns if c not in ("image_id", "corner")]
    return descriptors.groupBy("image_id", "corner").agg(F.min(F.struct(*rest)).alias("m")).select("image_id", "corner", "m.*")


def _listed(descriptors: DataFrame, tables: int) -> DataFrame:
    """A row for each descriptor and table, keyed by table and chunk."""
    chunk = F.posexplode(F.slice("chunks", 1, tables)).alias("t", "chunk")
    return descriptors.select("image_id", "corner", "x", "y", "scale", chunk).select("image_id", "corner", "x", "y", "scale", (F.shiftleft(F.col("t").cast("long"), CHUNK_BITS) + F.col("chunk")).alias("key"))


def same_in_place(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[bool, np.ndarray]:
    """Whether two images (x, y, scale and bits (n, words) of their corners) are nearly the same, and which corners of a b lacks.

    Corners agree at one scale within 2 pixels and MAX_DISTANCE bits. SAME_SHARE
    of either image's corners have to, and MIN_SAME of one scale, whose corners
    are different points.
    """
    near = (np.abs(a[0][:, None] - b[0]) <= 2) & (np.abs(a[1][:, None] - b[1]) <= 2) & (a[2][:, None] == b[2])
    near &= np.bitwise_count(a[3][:, None] ^ b[3][None]).sum(-1) <= MAX_DISTANCE
    has, had = near.any(1), near.any(0)
    most = np.unique(a[2][has], return_counts=True)[1].max(initial=0)
    return bool(most >= MIN_SAME and has.mean() >= SAME_SHARE and had.mean() >= SAME_SHARE), ~has


def verified(descriptors: DataFrame, pairs: DataFrame) -> DataFrame:
    """image_id, head, lacks (corners of the image that the head has not) for the pairs(image_id, head) that are nearly the same in place."""
    words = [f"d{k}" for k in range(TESTS // 64)]
    ids = pairs.select("image_id").union(pairs.select("head")).distinct()
    packed = descriptors.join(ids, "image_id", "left_semi").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("corner", "x", "y", "scale", *words))).alias("p"))
    fields = ["corner", "x", "y", "scale", *words]
    packed = stored(packed.select("image_id", *[F.col(f"p.{c}").alias(c) for c in fields]), "packed")
    side = lambda key, p: packed.select(F.col("image_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in fields])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a, b = ((r[f"{p}x"], r[f"{p}y"], r[f"{p}scale"], np.stack([r[f"{p}{w}"] for w in words], 1)) for p in ("i_", "h_"))
                same, lacks = same_in_place(a, b)
                if same:
                    out.append((r["image_id"], r["head"], r["i_corner"][lacks]))
            yield pd.DataFrame(out, columns=["image_id", "head", "lacks"])

    both = pairs.join(side("image_id", "i_"), "image_id").join(side("head", "h_"), "head")
    return both.mapInPandas(compare, "image_id long, head long, lacks array<int>")


def followers(descriptors: DataFrame) -> DataFrame:
    """image_id, leader (smaller), lacks: images that are nearly the same in place as their leader, each compared with it directly.

    A leader follows no other image. An image that agrees only with followers is
    compared no further: it leads itself.
    """
    index = _listed(descriptors, TABLES)
    heads = index.groupBy("key").agg(F.min(F.struct("image_id", "x", "y")).alias("h"), F.max("image_id").alias("other")).where("h.image_id != other")
    met = index.join(heads.select("key", "h"), "key").where((F.col("image_id") != F.col("h.image_id")) & (F.abs(F.col("x") - F.col("h.x")) <= 2) & (F.abs(F.col("y") - F.col("h.y")) <= 2))
    tied = met.groupBy("image_id", F.col("h.image_id").alias("head")).agg(F.count_distinct("corner").alias("c")).where(F.col("c") >= MIN_SAME)
    tied = stored(tied.select("image_id", "head"), "tied")
    classes = connected_components(tied.select(F.col("image_id").alias("a"), F.col("head").alias("b")))
    pairs = tied.union(classes.where("node != component").select("node", "component")).distinct()
    left = stored(verified(descriptors, pairs), "verified")
    found = None
    for _ in range(ROUNDS):
        lead = left.select(F.col("head")).distinct().join(left.select(F.col("image_id").alias("head")).distinct(), "head", "left_anti")
        new = left.join(lead, "head").groupBy("image_id").agg(F.min(F.struct("head", "lacks")).alias("m")).select("image_id", F.col("m.head").alias("leader"), F.col("m.lacks").alias("lacks"))
        new = stored(new, "followers")
        found = new if found is None else found.unionByName(new)
        gone = new.select("image_id")
        left = stored(left.join(gone, "image_id", "left_anti").join(gone.withColumnRenamed("image_id", "head"), "head", "left_anti"), "verified")
    return found


def detect_copies(images: DataFrame, queries: DataFrame) -> DataFrame:
    """The matches of copies_and_members()."""
    return copies_and_members(images, queries)[0]


def copies_and_members(images: DataFrame, queries: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """query_id, match_id, n_copies, inliers, rotation, scale, centre_x, centre_y: a row for each query and leader that match.

    match_id is a leader, and n_copies counts it and its followers. rotation (in
    degrees) and scale lead from the image to the query; centre is where the
    image's centre lies, from the query's centre. A query without a match has
    one row of nulls. Images with equal ids count as one image.

    And image_id, leader: a row for each image, which may be its own leader. ids
    has the images' ids, where those cost less than the images.
    """
    d = stored(_one_each(local_descriptors(images)), "descriptors")
    q = stored(_one_each(local_descriptors(queries)), "query-descriptors")
    follow = followers(d)
    lead = d.join(follow, "image_id", "left_anti").withColumn("leader", F.col("image_id"))
    more = d.join(follow.select("image_id", "leader", F.explode("lacks").alias("corner")), ["image_id", "corner"])
    # of a leader's followers, one stands for those with the same chunk in the same place
    cell = [F.floor(F.col(c) / 4).alias(f"{c}_cell") for c in ("x", "y")]
    listed = _listed(more, TABLES).join(follow.select("image_id", "leader"), "image_id").groupBy("leader", "key", "scale", *cell).agg(F.min(F.struct("image_id", "corner")).alias("m"))
    index = _listed(lead, TABLES).select("key", F.col("image_id").alias("leader"), "image_id", "corner").unionByName(listed.select("key", "leader", "m.image_id", "m.corner"))
    met = _listed(q, TABLES).alias("q").join(index.alias("i"), "key")
    met = met.select(F.col("q.image_id").alias("query_id"), F.col("q.corner").alias("qc"), F.col("i.leader").alias("match_id"), F.col("i.image_id").alias("of"), F.col("i.corner").alias("ic")).distinct()
    side = lambda df, a, b, p: df.select(F.col("image_id").alias(a), F.col("corner").alias(b), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "scale", "angle", "d0", "d1", "d2", "d3")])
    m = met.join(side(q, "query_id", "qc", "q"), ["query_id", "qc"]).join(side(d, "of", "ic", "i"), ["of", "ic"])
    distance = sum((F.bit_count(F.col(f"q_d{k}").bitwiseXOR(F.col(f"i_d{k}"))) for k in range(1, 4)), F.bit_count(F.col("q_d0").bitwiseXOR(F.col("i_d0"))))
    m = m.where(distance <= MAX_DISTANCE)
    turn = F.col("q_angle") - F.col("i_angle")
    turn = F.pmod(turn, F.lit(2 * np.pi))
    ratio = F.col("q_scale") / F.col("i_scale")
    m = m.withColumn("turn", turn).withColumn("ratio", ratio)
    m = m.withColumn("cx", F.col("q_x") - ratio * (F.cos("turn") * F.col("i_x") - F.sin("turn") * F.col("i_y"))).withColumn("cy", F.col("q_y") - ratio * (F.sin("turn") * F.col("i_x") + F.cos("turn") * F.col("i_y")))
    two = lambda c, width: F.array(F.floor(c / width), F.floor(c / width + 0.5) + 1_000_000)  # noqa: E731  two overlapping rows of bins
    votes = m.withColumn("r", F.round(F.log2("ratio") * 10)).withColumn("a", F.explode(F.array(F.pmod(F.floor(F.col("turn") / (np.pi / 6)), F.lit(12)), 100 + F.pmod(F.floor(F.col("turn") / (np.pi / 6) + 0.5), F.lit(12)))))
    votes = votes.withColumn("u", F.explode(two(F.col("cx"), 10))).withColumn("v", F.explode(two(F.col("cy"), 10)))
    bins = votes.groupBy("query_id", "match_id", "r", "a", "u", "v").agg(
        F.count_distinct("qc").alias("inliers"), F.atan2(F.avg(F.sin("turn")), F.avg(F.cos("turn"))).alias("turn"), F.avg("ratio").alias("scale"), F.avg("cx").alias("cx"), F.avg("cy").alias("cy")
    )
    best = bins.where(F.col("inliers") >= MIN_INLIERS).groupBy("query_id", "match_id").agg(F.max(F.struct("inliers", F.round(F.degrees("turn"), 1).alias("rotation"), "scale", F.round("cx", 1).alias("cx"), F.round("cy", 1).alias("cy"))).alias("b"))
    behind = follow.groupBy(F.col("leader").alias("match_id")).agg(F.count(F.lit(1)).alias("n"))
    best = best.join(behind, "match_id", "left").select("query_id", "match_id", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"), F.col("b.inliers").alias("inliers"), F.col("b.rotation").alias("rotation"), F.col("b.scale").alias("scale"), F.col("b.cx").alias("centre_x"), F.col("b.cy").alias("centre_y"))
    members = (images if ids is None else ids).where("image_id is not null").select("image_id").distinct().join(follow.select("image_id", "leader"), "image_id", "left").select("image_id", F.coalesce("leader", "image_id").alias("leader"))
    return queries.select(F.col("image_id").alias("query_id")).distinct().join(best, "query_id", "left"), members


def op1_image_copies(spark, sf_dir):
    """Edited copies of the images with an id divisible by 50, against all images.

    A match has its query_id, and source_id, the leader of the query's own
    source. A row without query_id is membership: member_id is an image, match_id its leader.
    """
    rows = table(spark, sf_dir, "embeddings")
    images = images_from_vectors(rows)
    queries = edited_copies(images_from_vectors(rows.where("vec_id % 50 = 0")))
    matches, members = copies_and_members(images, queries, rows.select(F.col("vec_id").cast("long").alias("image_id")))
    sources = members.select(F.col("image_id").alias("query_id"), F.col("leader").alias("source_id"))
    return matches.join(sources, "query_id", "left").unionByName(members.select(F.col("leader").alias("match_id"), F.col("image_id").alias("member_id")), allowMissingColumns=True)
