"""The pipeline's stages against brute force, and the classifier on held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest
from test_simhash import brute_components, brute_print

import corpus_pipeline
from tessellane.llm import mixing, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["grumblefax", "snorvile", "snorvilest", "snorvilung"]


def make(seed=3, n=420):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(BAD))
        docs.append((i, " ".join(own), "en", f"s{i % 4}" if i % 2 else "hot", len(own)))
        if rng.random() < 0.8:
            labels.append((i, 1, int(bad)))
    for i in range(20):
        docs.append((5000 + i, docs[2 * i][1], "en", "hot", 1))
    docs += [(6000, None, None, None, None), (6001, "", "en", "s1", 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = make()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_classifier_on_held_out_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([out[r.doc_id].predicted == r.toxic for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    clash = docs.selectExpr("doc_id", "text", "1 as score", "lang as predicted")
    assert {(r.doc_id, r.score) for r in toxicity.classify(clash, labels).collect()} == {(i, r.score) for i, r in out.items()}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}


def test_scorer_windows_agree(monkeypatch):
    rng = np.random.default_rng(0)
    n = len(toxicity.WIDTHS)
    model = toxicity.Model(
        rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype("f4"), rng.normal(size=(toxicity.N_MAPS, toxicity.SIZE, toxicity.FILTERS)).astype("f4"),
        np.zeros((n, toxicity.FILTERS), "f4"), np.ones((n, toxicity.FILTERS), "f4"), 0.0, {},
    )
    text = " ".join(f"w{k}" for k in range(20_000)) + " last"
    own = toxicity.Scorer(model)
    ids = [own.model.table[np.array([toxicity.buckets(w) for w in toxicity.words(text)])].sum(axis=1) @ own.flat]
    want = float((np.tanh(toxicity._convolve(ids[0], model.bias)[0]) * model.out).sum())
    assert abs(own.logit(text) - want) < 1e-3
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 500)
    assert abs(toxicity.Scorer(model).logit(text) - want) < 1e-3
    assert toxicity.Scorer(model).score("") == toxicity.Scorer(model).score("  ,.")


def test_near_duplicate_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.unionByName(docs.where("doc_id in (3, 6001)")).unionByName(spark.createDataFrame([(None, "only here", "en", "x", 1), (None, make()[0][0][1], "en", "x", 1), (7, "other text", "en", "y", 1)], SCHEMA))
    rows = sorted(map(tuple, more.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    prints = [brute_print(r[1]) for r in rows]
    group = brute_components(list(range(len(rows))), prints)
    want = sorted({g: rows[g] for g in group}.values(), key=str)
    got = sorted(map(tuple, simhash.one_of_each(more).collect()), key=str)
    assert [r[0] for r in got if r[0] != 7] == [r[0] for r in want if r[0] != 7] and len(got) == len(want)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_mix_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    goal = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = [r.asDict() for r in corpus_pipeline.mix_sources(spark, docs, tables).collect()]
    assert set(out[0]) == set(docs.columns)
    for source in {r.source for r in goal.values()}:
        mine = [r for r in goal.values() if r.source == source]
        words = sum(goal[r["doc_id"]].size for r in out if r["source"] == source)
        assert abs(words - mine[0].target) <= max(r.size for r in mine)
    times = {i: sum(r["doc_id"] == i for r in out) for i in goal}
    assert all(times[i] <= 2 for i in goal)
    assert all(math.floor(r.taken / max(r.size, 1)) <= times[i] <= math.ceil(r.taken / max(r.size, 1)) for i, r in goal.items() if r.size)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "1 as size", "2 as key", "3 as range", "4 as row", "5 as epochs")
    assert mixing.mixed_documents(clash).count() == len(out)


def test_run_is_the_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_duplicates", "source_mix", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
        assert docs.schema.names == [c.split()[0] for c in SCHEMA.split(", ")]
    last = corpus_pipeline.pack(spark, docs, tables).toPandas()
    whole = corpus_pipeline.run(spark, tables).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, last[cols].to_numpy())) == sorted(map(tuple, whole[cols].to_numpy()))
    assert (whole.groupby("sequence_id").length.sum() <= 1024).all()


def brute_targets(sizes):
    """Water-filling, source by source, until nobody is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= level * weight[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def brute_stages(spark, folder):
    """The first three stages by plain Python, but for the training: lists of rows."""
    import hashlib

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in docs.collect() if 1 / (1 + math.exp(-(brute_logit(model, r.text or "") - model.shift.get(toxicity.language_of(r.text or ""), 0.0)))) < 0.5]
    yield rows
    rows.sort(key=lambda r: r.doc_id)
    group = brute_components(list(range(len(rows))), [brute_print(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    yield rows
    words = lambda r: len((r.text or "").split())
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r)
    goals, out = brute_targets(sizes), []
    key = lambda r: hashlib.md5(f"{r.doc_id}:mix:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()
    for source, size in sizes.items():
        epochs, rest = divmod(math.floor(goals[source]), size) if size else (0, 0)
        for r in sorted((r for r in rows if r.source == source), key=key):
            last = max(0, min(words(r), rest))
            rest -= words(r)
            out += [r] * (epochs + (last > 0 and 2 * last >= words(r)))
    yield out


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(spark, tables), strict=False):
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(map(tuple, want), key=str), name


def test_stages_take_odd_rows_and_empty_tables(spark, tables):
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (2, "x " * 30_000, None, "s", 60_000), (3, "\x00 \u2028", "xx", "s", 3), (None, "a b", "en", "s", 3)]
    for n in (0, len(odd)):
        start = docs = spark.createDataFrame(odd[:n], SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, tables)
            assert docs.columns == start.columns
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
        packed = corpus_pipeline.pack(spark, docs, tables).collect()
        assert (len(packed) > 50) == (n > 0) and len({(p.sequence_id, p.offset) for p in packed}) == len(packed)


def test_stored_tables_can_be_deleted(spark, tmp_path):
    from pathlib import Path

    from tessellane.llm import shared

    one, two = (shared.store(spark.range(k), "gone") for k in (3, 4))
    folder = Path(shared.shared_dir(spark))
    names = [next(iter(shared._folders(t))) for t in (one, two)]
    shared.discard_all(spark, two)
    assert not (folder / names[0]).exists() and two.count() == 4
    shared.discard(two)
    assert not (folder / names[1]).exists()


def brute_logit(model, text):
    """Place by place and filter by filter."""
    own = toxicity.words(text)
    own += toxicity._PAD[: max(0, max(toxicity.WIDTHS) - len(own))]
    emb = np.array([sum(model.table[b].astype(float) for b in toxicity.buckets(w)) for w in own])
    z, m = model.out_bias, 0
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            places = [sum(float(emb[s + k] @ model.filters[m + k][:, f]) for k in range(width)) for s in range(len(own) - width + 1)]
            z += np.tanh(max(places) + model.bias[i, f]) * model.out[i, f]
        m += width
    return float(z)


def brute_loss(model, texts, labels):
    """Mean logistic loss."""
    p = 1 / (1 + np.exp(-np.array([brute_logit(model, t) for t in texts])))
    return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))


def test_gradients_equal_differences():
    texts = ["one two three two one", "four", "", "five one nine ten two two", "a longer text with more words in it than all the others have"]
    labels = np.array([1.0, 0.0, 0.0, 1.0, 1.0])
    model = toxicity.fresh(3)
    for name in ("table", "filters", "bias", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64) * (100 if name == "table" else 1))
    corpus = toxicity.Corpus(texts)
    grads, d_ob, rows, of_table = toxicity.gradients(model, corpus, np.arange(5), labels)
    logits = [toxicity.Scorer(model).logit(t) for t in texts]
    assert abs(brute_loss(model, texts, labels) - np.mean(np.log1p(np.exp(np.where(labels == 1, -1, 1) * logits)))) < 1e-5
    rng, step = np.random.default_rng(0), 1e-5

    def slope(array, at):
        was = array[at]
        array[at] = was + step
        up = brute_loss(model, texts, labels)
        array[at] = was - step
        down = brute_loss(model, texts, labels)
        array[at] = was
        return (up - down) / (2 * step)

    for name in ("filters", "bias", "out"):
        array = getattr(model, name)
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in array.shape)
            assert abs(slope(array, at) - grads[name][at]) < 1e-6, (name, at)
    for k in rng.choice(len(rows), 20, replace=False):
        at = (int(rows[k]), int(rng.integers(toxicity.SIZE)))
        assert abs(slope(model.table, at) - of_table[k, at[1]]) < 1e-6
    bias, model.out_bias = model.out_bias, model.out_bias + step
    up, model.out_bias = brute_loss(model, texts, labels), bias - step
    assert abs((up - brute_loss(model, texts, labels)) / (2 * step) - d_ob) < 1e-6


def test_cross_validation_sees_training_rows_only():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["plain", "words", "here", "and", "there"], 6)) + (" vile" if i % 2 else "") for i in range(90)]
    labels = np.array([i % 2 for i in range(90)], np.float32)
    assert toxicity.cross_validated(texts, labels, epochs=4) > 0.9
    assert toxicity.cross_validated(texts, rng.permutation(labels), epochs=4) < 0.75
