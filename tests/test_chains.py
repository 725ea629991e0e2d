import random

from terrafold.operators.chains import ranked_chains


def brute(links):
    prev = dict(links)
    out = []
    for x in prev:
        way, seen = [x], {x}
        while prev[way[-1]] is not None and prev[way[-1]] not in seen:
            way.append(prev[way[-1]])
            seen.add(way[-1])
        closed = prev[way[-1]] is not None
        head = min(way) if closed else way[-1]
        out.append((x, head, way.index(head), closed))
    return sorted(out)


def test_chains_rings_and_single_items(spark):
    rng = random.Random(7)
    names = rng.sample(range(10_000), 400)
    links, at = [], 0
    for size, closed in [(1, False), (1, True), (2, True), (3, True), (130, False), (64, True), (97, True), (2, False), (50, False), (33, True)]:
        part = names[at : at + size]
        at += size
        links += [(x, part[i - 1] if i else (part[-1] if closed else None)) for i, x in enumerate(part)]
    got = ranked_chains(spark.createDataFrame(links, "item long, prev long")).collect()
    assert sorted(tuple(r) for r in got) == brute(links)


def test_only_rings_and_nothing(spark):
    links = [(1, 2), (2, 3), (3, 1)]
    assert sorted(tuple(r) for r in ranked_chains(spark.createDataFrame(links, "item long, prev long")).collect()) == brute(links)
    assert ranked_chains(spark.createDataFrame([], "item long, prev long")).count() == 0
