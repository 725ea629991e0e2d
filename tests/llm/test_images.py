import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm.features2d import MARGIN, TESTS, corners, describe, resampling
from terrafold.llm.images import SIZE, copies_and_members, detect_copies, edited, edited_copies, followers, images_from_vectors, local_descriptors, op1_image_copies, rendered

MEDIA = "image_id long, pixels binary, height int, width int"


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(2).normal(0, 0.125, (60, 64)).astype(np.float32)


def test_corners_move_with_the_image(vectors):
    img = rendered(vectors[:1])[0].astype(np.float32)
    part = img[10:90, 6:86]
    a = {(int(y), int(x)) for _, y, x in zip(*corners(img[None], 99)[:3])}
    b = {(int(y) + 10, int(x) + 6) for _, y, x in zip(*corners(part[None], 99)[:3])}
    inner = {(y, x) for y, x in a if 10 + MARGIN + 3 <= y < 90 - MARGIN - 3 and 6 + MARGIN + 3 <= x < 86 - MARGIN - 3}
    assert inner and inner <= b


def test_descriptors_turn_with_the_image(vectors):
    imgs = rendered(vectors[:8])
    a, b = describe(imgs), describe(np.rot90(imgs, 1, (1, 2)))
    count = np.array([bin(i).count("1") for i in range(256)])
    for i in range(8):
        x, y = a["bits"][a["image"] == i], b["bits"][b["image"] == i]
        best = count[x[:, None] ^ y[None]].sum(-1).min(1)
        assert np.mean(best <= 25) > 0.5 and x.shape[1] == TESTS // 8


def test_resampling_keeps_constants_and_means():
    m = resampling(96, 1.25)
    assert m.shape == (76, 96) and np.allclose(m.sum(1), 1)


def test_edited_copies_are_found_and_others_are_not(spark, vectors):
    rows = [(i * 50, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(i * 50 + 1, (v + np.random.default_rng(i).normal(0, 0.001, 64)).tolist()) for i, v in enumerate(vectors[:10])]  # near copies
    rows += [(7, None), (8, [0.1] * 3), (None, vectors[0].tolist()), (50, vectors[1].tolist())]
    images = images_from_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = detect_copies(images, edited_copies(images.where("image_id % 50 = 0"))).collect()
    own = {r["query_id"]: r for r in got if r["match_id"] is not None and r["match_id"] // 50 == r["query_id"] // 50}
    assert len({r["query_id"] for r in got}) == 60
    assert len(own) >= 54
    assert all(r["match_id"] // 50 == r["query_id"] // 50 for r in got if r["match_id"] is not None)
    for q, r in own.items():
        kind = q // 50 % 4
        assert abs(r["scale"] - (0.8 if kind == 3 else 1)) < 0.01
        assert abs((r["rotation"] - (-90 if kind == 2 else 0) + 180) % 360 - 180) < 8
        # the crop begins at (14, 10) and is 72 pixels square: the image's centre in it
        if kind in (0, 1):
            assert abs(r["centre_x"] - ((SIZE - 1) / 2 - 14 - 35.5)) < 3 and abs(r["centre_y"] - ((SIZE - 1) / 2 - 10 - 35.5)) < 3
    assert sum(r["n_copies"] > 1 for r in own.values()) >= 8


def test_odd_media(spark):
    flat = bytes(SIZE * SIZE)
    df = spark.createDataFrame([(1, flat, SIZE, SIZE), (2, None, None, None), (None, flat, SIZE, SIZE), (3, bytes(16), 4, 4), (4, bytes(30 * 50), 30, 50)], MEDIA)
    assert local_descriptors(df).count() == 0
    got = detect_copies(df, df.where("image_id in (1, 3)")).collect()
    assert sorted((r["query_id"], r["match_id"]) for r in got) == [(1, None), (3, None)]
    assert detect_copies(df.limit(0), df.limit(0)).count() == 0
    assert edited(np.zeros((SIZE, SIZE), np.uint8), 3, 0).shape == (72, 72)


def test_damaged_images_have_no_rows(spark, vectors):
    whole = rendered(vectors[:1])[0].tobytes()
    df = spark.createDataFrame([(50, whole, SIZE, SIZE), (100, whole[:-1], SIZE, SIZE), (150, None, SIZE, SIZE), (200, b"", 0, 0), (250, whole, -SIZE, -SIZE), (300, whole, None, SIZE)], MEDIA).withColumn("corner", F.lit(1))
    assert [r["image_id"] for r in local_descriptors(df).select("image_id").distinct().collect()] == [50]
    assert [r["image_id"] for r in edited_copies(df).collect()] == [50]
    got = detect_copies(df, edited_copies(df)).collect()
    assert [(r["query_id"], r["match_id"]) for r in got] == [(50, 50)]


def test_each_edit_is_found_behind_a_chain(spark, vectors):
    """Every query's source is the last of 12 slowly changing images; of each edit, most are found by the source's own leader."""
    rng = np.random.default_rng(9)
    rows = []
    for i, v in enumerate(vectors[:16]):
        steps = rng.normal(0, 0.012, (12, 64)).cumsum(0)
        rows += [(i * 50 + (11 - k), (v + steps[k]).tolist()) for k in range(12)]
    images = images_from_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    matches, members = copies_and_members(images, edited_copies(images.where("image_id % 50 = 0")))
    leader = {r["image_id"]: r["leader"] for r in members.collect()}
    found = {r["query_id"] for r in matches.collect() if r["match_id"] is not None and r["match_id"] == leader[r["query_id"]]}
    assert len(found) >= 14
    for kind in range(4):
        assert sum(q // 50 % 4 == kind for q in found) >= 3


def _media(images):
    return [(i, x.tobytes(), SIZE, SIZE) for i, x in images.items()]


def test_images_that_share_a_part_do_not_follow_each_other(spark, vectors):
    """Half an image pasted into another: three corners agree, but not the whole; both halves are still found."""
    a, b, c = rendered(vectors[:3])
    ab, bc = np.hstack([a[:, :48], b[:, 48:]]), np.hstack([c[:, :48], b[:, 48:]])
    df = spark.createDataFrame(_media({1: a, 2: ab, 3: bc, 4: c, 5: a}), MEDIA)
    f = {r["image_id"]: r["leader"] for r in followers(local_descriptors(df)).collect()}
    assert f == {5: 1}
    q = spark.createDataFrame(_media({9: bc, 8: c}), MEDIA)
    got = {(r["query_id"], r["match_id"]) for r in detect_copies(df, q).collect()}
    assert {(9, 3), (8, 4)} <= got


def test_what_only_a_follower_has_is_found(spark, vectors):
    """Corners that a follower has and its leader lacks lead to the class."""
    whole = rendered(vectors[6:7])[0]
    cut, part = whole.copy(), whole.copy()
    cut[:, 74:] = 128
    part[:, :60] = 128
    df = spark.createDataFrame(_media({1: cut, 2: whole}), MEDIA)
    assert [(r["image_id"], r["leader"]) for r in followers(local_descriptors(df)).collect()] == [(2, 1)]
    query = spark.createDataFrame(_media({7: part}), MEDIA)
    assert [r["match_id"] for r in detect_copies(df.where("image_id = 1"), query).collect()] == [None]
    assert [(r["match_id"], r["n_copies"]) for r in detect_copies(df, query).collect()] == [(1, 2)]


def test_every_image_has_its_leader_and_every_query_its_source(spark, vectors, tmp_path):
    rows = [(i * 50, v.tolist()) for i, v in enumerate(vectors[:6])] + [(3, vectors[1].tolist()), (7, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op1_image_copies(spark, str(tmp_path)).collect()
    members = {r["member_id"]: r["match_id"] for r in got if r["query_id"] is None}
    assert members == {i: 3 if i == 50 else i for i, _ in rows} and sum(r["query_id"] is None for r in got) == len(rows)
    assert {r["query_id"]: r["source_id"] for r in got if r["query_id"] is not None} == {i * 50: 3 if i == 1 else i * 50 for i in range(6)}
