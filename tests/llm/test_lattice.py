"""Lattice hashing: the decoder, links against brute force, edge cases, recall."""

import numpy as np
import pytest

from tessellane.llm import lattice


def test_decoder_gives_the_nearest_point():
    x = np.random.default_rng(0).normal(size=(3000, 8)) * 2
    p = lattice.decode(x)
    assert ((p.sum(axis=1) % 4) == 0).all() and ((p % 2 == 0).all(axis=1) | (p % 2 != 0).all(axis=1)).all()
    own = ((x - p / 2) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius
    assert (((x[:, None] - (p[:, None] + lattice.ROOTS) / 2) ** 2).sum(axis=2).min(axis=1) >= own - 1e-9).all()
    assert len(lattice.ROOTS) == 240 and ((lattice.ROOTS**2).sum(axis=1) == 8).all()


def brute(rows, threshold=0.98):
    n = len(rows)
    good = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v, _), g in zip(rows, good)]
    comp, links = list(range(n)), [0] * n

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                comp[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root(i)], least[root(i)] == rows[i][0]) for i in range(n))


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=64)
        for k in range(int(rng.choice([1, 1, 2, 12]))):
            # Well inside the threshold, so that brute force's and our rounding agree.
            rows.append((len(rows), (v + rng.normal(size=64) * 0.05 * (k > 1)).astype(np.float32).tolist(), int(i % 3)))
    return rows


@pytest.mark.parametrize("tile", [4096, 9])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = made(1)
    n = len(rows)
    rows += [
        (n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [1.0, None], 1), (n + 4, [1.0, 2.0], 1), (n + 5, [2.0, 4.0], 1), (n + 6, rows[0][1], None),
        (n + 7, [], 1), (n + 8, [float("inf"), 1.0], 1), (n + 9, [2.0, 4.0, 0.0], 1), (n + 10, rows[5][1], rows[5][2]), (n + 11, [1e30, 2e30], 1),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == brute(rows)


def test_no_links_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_ids_and_repeated_ones(spark, kind):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    made = [("7", a), ("5", b), ("9", a), ("4", [3.0, -1.0, 0.0]), (None, [9.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0]), (None, a), ("4", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in made], "vec_id string, embedding array<double>, label int, kept string").withColumn("vec_id", pytest.importorskip("pyspark.sql.functions").col("vec_id").cast(kind))
    got = sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_duplicates(df).collect()))
    assert got == sorted([("7", 3, "5", False), ("5", 3, "5", True), ("9", 3, "5", False), ("None", 3, "5", False), ("4", 0, "4", True), ("4", 0, "4", True), ("None", 1, "None", True), ("None", 1, "None", True)])


@pytest.mark.parametrize("blocks", [1, 2, 3, 4])
def test_every_number_of_blocks_finds_the_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(lattice, "ONE_BLOCK", 60 / lattice.CELLS_OF_BLOCK ** (blocks - 1) * 1.5)
    rows = made(4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, lattice.near_duplicates(df).collect())) == brute(rows)


def test_equals_sql(spark):
    import duckdb

    from tessellane.llm import registry

    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    ours = registry.QUERIES["op10_embedding_near_duplicates"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, ours.collect())) == sorted(con.execute(registry.ORACLES["op10_embedding_near_duplicates"]).fetchall())


@pytest.mark.parametrize(("blocks", "least"), [(1, 0.999), (2, 0.995), (3, 0.995), (4, 0.99)])
def test_recall_at_the_threshold(blocks, least):
    rng = np.random.default_rng(2)
    a, o = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o -= (o * a).sum(axis=1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    p, q = (lattice.cells(x, np.ones(3000, np.uint64), blocks=blocks) for x in (a, b))
    assert p.shape[1] == lattice.tables_of(blocks)
    met = ((p == q[:, :, :1]).any(axis=2) | (q == p[:, :, :1]).any(axis=2)).any(axis=1)
    assert met.mean() >= least
