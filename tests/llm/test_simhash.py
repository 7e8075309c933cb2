"""SimHash links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessellane.llm import simhash
from tessellane.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(ids, prints, radius=4):
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", None, " \t ", "one", "Two words", "a b c d", "a b c d e", "É é A\u00a0B \x1f x y z " * 50, "w" * 10000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_print(text)


def test_chunks_agree(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 200, 600]))] for _ in range(60)]
    made, n = [], 0
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "changed"
            made.append((n, " ".join(w)))
            n += 1
    made += [(n, None), (n + 1, ""), (n + 2, "  "), (3, made[3][1])]
    docs = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, fingerprint string")
    got = sorted(map(tuple, simhash.clusters(docs).collect()))
    prints = [brute_print(t) for _, t in made]
    want = sorted(zip([i for i, _ in made], [f"{p:016x}" for p in prints], brute_components([i for i, _ in made], prints)))
    assert got == want
    assert simhash.clusters(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_segments_cover(n):
    masks = simhash.segments(n, 4)
    rng = random.Random(n)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_forest_links_components():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64)
    points = np.unique(np.concatenate([seeds, *[seeds ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(10)]]))
    ids = list(range(len(points)))
    want = brute_components(ids, [int(p) for p in points])
    comp = list(ids)
    for _ in ids:
        for a, b in simhash.forest(points, 4):
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp == want


def hot_points():
    """Two clouds around centres that agree on their first bits, and points far from both."""
    rng = random.Random(12)
    out = set()
    for centre in (0xF0F0F0F0F0F0F0F0, 0xF0F0F0F0F0F00F0F):
        for _ in range(150):
            out.add(centre ^ sum(1 << b for b in rng.sample(range(48), rng.choice([1, 2, 4, 9]))))
    while len(out) < 420:
        out.add(rng.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("limit", [8, 40, 100_000])
def test_hot_shards_are_split_and_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SPLIT", limit)
    points = hot_points()
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)], "doc_id long, bits long")
    prints = rows.unionByName(rows.where("doc_id < 5"))
    got = {r.bits: r.smallest for r in simhash.near_duplicates(prints).collect()}
    want = brute_components(list(range(len(points))), points)
    assert [got[r.bits] for r in rows.orderBy("doc_id").collect()] == want
    shards = simhash.split(rows.selectExpr("1L as shard", "bits"), 4)
    sizes = [r["count"] for r in shards.groupBy("shard", "tile").count().collect()]
    if limit == 40:
        assert len(sizes) > 1 and max(sizes) <= 4 * limit
        assert shards.select("shard").distinct().count() > 1  # a vantage point has split it


def test_no_link_is_lost_by_a_split(spark):
    points = hot_points()
    rows = spark.createDataFrame([(1, True, p - (1 << 64) if p >> 63 else p) for p in points], "shard long, home boolean, bits long")
    cut = {(r.bits & (1 << 64) - 1): r for r in simhash.split_once(rows, 4, 0).collect()}
    assert len(cut) == len(points) and len({r.mu for r in cut.values()}) == 1
    mu = next(iter(cut.values())).mu
    assert mu is not None and all(r.d == (b ^ (r.pivot & (1 << 64) - 1)).bit_count() for b, r in cut.items())
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= 4:
                near, far = sorted((cut[a].d, cut[b].d))
                assert far <= mu + 4 or near > mu


def test_components_say_when_they_give_up(spark, monkeypatch):
    from tessellane.llm import components as module

    monkeypatch.setattr(module, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))


def test_hubs_are_salted_and_exact(spark, monkeypatch):
    from tessellane.llm import components as module

    monkeypatch.setattr(module, "LEAST_HUB", 8)
    rng = random.Random(5)
    links = [(0, i) for i in range(1, 300)] + [(900, i) for i in range(901, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(299, 2400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for x in linked}
    rows = spark.createDataFrame([(0, i) for i in range(200)] + [(1, 5)], "u long, v long")
    nodes = spark.createDataFrame([(0, 7, 200), (1, 8, 1)], "u long, m long, n long")
    beside = module._beside(rows, nodes)
    assert sorted(map(tuple, beside.collect())) == sorted([(0, i, 7) for i in range(200)] + [(1, 5, 8)])


def test_components_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0
