"""Ranking, fusion, reranking, packing, answers and metrics against worked numbers."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from tessellane.operators import evaluate, index, rerank, retrieval, search


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("a-1", "a", "rollback rollback deployment"), ("b-1", "b", "rollback checklist documentation procedure")], "chunk_id string, doc_id string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "rollback")], "query_id int, text string")


def test_worked_bm25(two, asked):
    got = {r.chunk_id: r.score for r in retrieval.bm25_scores(two, asked).collect()}
    idf = math.log(1 + 0.5 / 2.5)
    assert got["a-1"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3.5)))
    assert got["b-1"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / 3.5)))


def test_hybrid_is_the_sum_of_reciprocal_ranks(two, asked):
    rows = retrieval.hybrid(two, asked, 2).collect()
    assert {r.chunk_id for r in rows} == {"a-1", "b-1"}
    for r in rows:
        assert r.score == pytest.approx(1 / (60 + r.bm25_rank) + 1 / (60 + r.vector_rank))
    with pytest.raises(ValueError):
        retrieval.hybrid(two, asked, 13)
    with pytest.raises(ValueError):
        retrieval.hybrid(two, asked, 4, "other")


def test_worked_fusion(spark):
    one = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    other = spark.createDataFrame([(1, "z", 1), (1, "w", 2), (1, "x", 3)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r for r in retrieval.fused([one, other]).collect()}
    assert got["x"].score == pytest.approx(1 / 61 + 1 / 63) and got["x"].rank_2 == 3 and got["y"].rank_2 is None


def test_scope_and_gate(spark, two, asked):
    assert retrieval.scoped(two, []).count() == 0 and retrieval.scoped(two, None).count() == 2
    inside = retrieval.bm25_scores(retrieval.scoped(two, ["a"]), asked).collect()
    assert [r.chunk_id for r in inside] == ["a-1"] and inside[0].score == pytest.approx(math.log(1 + 0.5 / 1.5) * 2 * 2.5 / 3.5)
    han = spark.createDataFrame([("c", "回家路上"), ("d", "部署回滚")], "chunk_id string, text string")
    ask = spark.createDataFrame([(1, "回滚流程")], "query_id int, text string")
    assert [r.chunk_id for r in retrieval.lexical_gate(han, ask).collect()] == ["d"]
    single = spark.createDataFrame([(1, "回")], "query_id int, text string")
    assert {r.chunk_id for r in retrieval.lexical_gate(han, single).collect()} == {"c", "d"}


def test_empty_tables(spark, two, asked):
    assert retrieval.bm25_scores(two.limit(0), asked).count() == 0
    assert retrieval.bm25_scores(two, asked.limit(0)).count() == 0
    assert retrieval.tfidf_cosine(two.limit(0), asked).count() == 0
    stats = retrieval.corpus_stats(retrieval.tokens(two.limit(0))).first()
    assert (stats.n, stats.mean_length) == (0, 1.0)


def test_hash_embedding_equals_plain_python(spark):
    docs = {"a": "red fruit red 回滚", "b": "car fruit", "c": ""}
    df = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    toks = {"a": ["red", "fruit", "red", "回", "滚", "回滚"], "b": ["car", "fruit"], "c": []}
    want = {}
    for d, own in toks.items():
        vec = {}
        for t in set(own):
            n = sum(t in x for x in toks.values())
            h = zlib.crc32(t.encode())
            vec[h % 2048] = vec.get(h % 2048, 0) + (1 if h & 2 else -1) * (1 + math.log(own.count(t))) * math.log(1 + (3 - n + 0.5) / (n + 0.5))
        length = math.sqrt(sum(w * w for w in vec.values()))
        want |= {(d, i): w / length for i, w in vec.items()}
    got = {(r.chunk_id, r.idx): r.w for r in retrieval.hash_embedding(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_dense_search(spark):
    made = [(i, [float(i), 1.0], i % 3) for i in range(40)] + [(40, [0.0, 0.0], 1), (41, None, 1), (42, [1.0, 2.0], None)]
    v = spark.createDataFrame(made, "chunk_id int, vec array<double>, label int").repartition(5)
    asked = [(i, [1.0, float(i)], i % 3) for i in range(30)]
    q = spark.createDataFrame(asked, "query_id int, vec array<double>, label int")
    cos = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / math.hypot(*a) / math.hypot(*b) if any(a) and any(b) else 0.0
    for scope, own in ((None, False), ("label", False), ("label", True), (None, True)):
        want = set()
        for j, b, lab in asked:
            fit = [(-round(cos(a, b), 9), i) for i, a, x in made if a is not None and (scope is None or x == lab) and not (own and i == j)]
            want |= {(j, i, k) for k, (_, i) in enumerate(sorted(fit)[:7], 1)}
        assert {(r.query_id, r.chunk_id, r.rank) for r in search.dense(v, q, 7, scope, own).collect()} == want
    assert search.dense(v.limit(0), q, 3).count() == 0 and search.dense(v, q.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        search.dense(v, spark.createDataFrame([(1, [1.0])], "query_id int, vec array<double>"), 3).collect()


def brute_search(docs, asked, channel, pool):
    """Scores by plain Python from tokens: (query, chunk, rank)."""
    n, df = len(docs), {}
    for own in docs.values():
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    mean = sum(map(len, docs.values())) / n or 1
    w = lambda t, c: (1 + math.log(c)) * (1 + math.log((n + 1) / (df[t] + 1)))
    out = set()
    for q, terms in asked.items():
        known = {t for t in terms if t in df}
        found = []
        for d, own in docs.items():
            both = known & set(own)
            if channel == "bm25":
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in both)
            else:
                norm = lambda x: math.sqrt(sum(w(t, x.count(t)) ** 2 for t in set(x) if t in df))
                s = sum(w(t, own.count(t)) * w(t, terms.count(t)) for t in both) / (norm(own) * norm(terms)) if both else 0
            if s > 0:
                found.append((-round(s, 9), d))
        out |= {(q, d, k) for k, (_, d) in enumerate(sorted(found)[:pool], 1)}
    return out


@pytest.mark.parametrize(("channel", "block"), [("bm25", 512), ("vector", 512), ("bm25", 4), ("vector", 4)])
def test_index_search_equals_brute_force(spark, monkeypatch, channel, block):
    import random

    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "ROWS", 16)
    monkeypatch.setattr(search, "ADDED", 50)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["red", "green", "blue", "deep", "sea", "sky", "v2", "zebra"]) for _ in range(n))
    docs = {i: text(rng.randrange(0, 12)) for i in range(90)} | {90: "", 91: "of the"}
    asked = {i: text(rng.randrange(0, 6)) for i in range(13)} | {13: "nowhere red", 14: ""}
    table = spark.createDataFrame([(i, t or None) for i, t in docs.items()], "chunk_id int, text string").repartition(3)
    questions = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    made = index.build(table, "lab", "lab")
    got = {(r.query_id, r.chunk_id, r.rank) for r in search.lexical(made, questions, 6, (channel,)).collect()}
    split = lambda d: {i: [w for w in t.split() if w not in ("of", "the")] for i, t in d.items()}
    assert got == brute_search(split(docs), split(asked), channel, 6)
    assert index.is_there(made)
    few = index.scoped(made, spark.range(40).selectExpr("id as chunk_id"))
    got = {(r.query_id, r.chunk_id, r.rank) for r in search.lexical(few, questions, 6, (channel,)).collect()}
    assert got == brute_search({i: t for i, t in split(docs).items() if i < 40}, split(asked), channel, 6)
    stats = made.statistics().first()
    assert (stats.chunks, stats.terms, stats.tokens) == (92, 8, sum(map(len, split(docs).values())))
    made.discard()
    assert not index.is_there(made)


def test_index_equals_joins(spark):
    docs = spark.createDataFrame([(1, "回滚 部署 rollback"), (2, "回家 rollback rollback"), (3, "checklist")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "回滚 rollback"), (2, "checklist 回")], "query_id int, text string")
    joined = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25_scores(docs, asked).collect()}
    found = {(r.query_id, r.chunk_id): r.score for r in search.lexical(index.build(docs), asked, 9).collect()}
    assert joined.keys() == found.keys() and all(found[k] == pytest.approx(joined[k]) for k in joined)
    cosines = {(r.query_id, r.chunk_id): r.score for r in retrieval.tfidf_cosine(docs, asked).collect()}
    found = {(r.query_id, r.chunk_id): r.score for r in search.lexical(index.build(docs, "lab", "lab"), asked, 9, ("vector",)).collect()}
    assert cosines.keys() == found.keys() and all(found[k] == pytest.approx(cosines[k]) for k in cosines)
    with pytest.raises(ValueError):
        search.lexical(index.build(docs), asked, 9, ("vector",))


def test_containing(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, "bc"), (3, None), (4, ""), (5, "漢字 abc")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "bc"), (2, "abc"), (3, ""), (4, None), (5, "漢"), (6, "bc"), (7, "zzz")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id) for r in search.containing(docs, asked).collect()}
    texts = {1: "abcd", 2: "bc", 4: "", 5: "漢字 abc"}
    assert got == {(q, d) for q, p in ((1, "bc"), (2, "abc"), (3, ""), (5, "漢"), (6, "bc"), (7, "zzz")) for d, t in texts.items() if p in t}
    assert search.containing(docs, asked.limit(0)).count() == 0


def test_hashed_searches(spark, two, asked):
    both = spark.createDataFrame([(1, "rollback"), (2, "unknown words")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.embedding_search(two, both).collect()}
    assert set(got) == {(1, "a-1"), (1, "b-1")} and got[1, "a-1"] > got[1, "b-1"] > 0
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.hashed_search(two, both).collect()}
    assert {k for k in got if k[0] == 1} == {(1, "a-1"), (1, "b-1")} and got[1, "a-1"] > got[1, "b-1"]


def test_guards(spark, two):
    with pytest.raises(ValueError):
        retrieval.checked_capacity(two, 1)
    assert retrieval.checked_capacity(two).count() == 2
    for bad in ("", "  ", "x" * 2001):
        with pytest.raises(Exception, match="characters"):
            retrieval.checked_questions(spark.createDataFrame([(1, bad)], "query_id int, text string")).collect()
    assert retrieval.POOLS["kit"](3) == (20, None) and retrieval.POOLS["lab"](6) == (24, 24) and retrieval.POOLS["pro"](5) == (20, 20)


def test_related_and_expanded(spark):
    docs = spark.createDataFrame([(1, "apple fruit sweet"), (2, "apple fruit"), (3, "car road")], "chunk_id int, text string")
    got = {r.other: (r.together, r.rank) for r in retrieval.related_terms(docs, spark.createDataFrame([("apple",)], "term string")).collect()}
    assert got == {"fruit": (2, 1), "sweet": (1, 2)}
    q = spark.createDataFrame([(1, "apple car"), (2, "unknown")], "query_id int, text string")
    out = {r.query_id: r.text for r in retrieval.expanded(docs, q, 2).collect()}
    assert out == {1: "apple car fruit sweet", 2: "unknown"}


@pytest.mark.parametrize("frequent", [3, 8, 2048])
def test_related_equals_brute_force(spark, monkeypatch, frequent):
    import random

    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "ROWS", 16)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = {i: rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(9)) for i in range(120)}
    made = index.build(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "chunk_id int, text string").repartition(3), "pro")
    asked = ["w0", "w1", "w7", "w30", "w39", "none"]
    want = set()
    for w in asked:
        counts = {}
        for t in docs.values():
            for o in set(t) - {w} if w in t else ():
                counts[o] = counts.get(o, 0) + 1
        want |= {(w, o, c, k) for k, (c, o) in enumerate(sorted(((-c, o) for o, c in counts.items()))[:4], 1) for c in [-c]}
    got = {(r.term, r.other, r.together, r["rank"]) for r in search.related(made, spark.createDataFrame([(w,) for w in asked] + [(None,)], "term string"), 4).collect()}
    assert got == want


def brute_mmr(rows, k, lam, like):
    left, chosen = list(rows), []
    while left and len(chosen) < k:
        best = max(left, key=lambda r: lam * r[1] - (1 - lam) * max((like(r[2], c[2]) for c in chosen), default=0))
        chosen.append(best)
        left.remove(best)
    return [r[0] for r in chosen]


def test_mmr(spark):
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    rows = [(1, 0.9, ["a", "b"]), (2, 0.89, ["a", "b"]), (3, 0.5, ["c"]), (4, 0.4, ["a", "c"])]
    df = spark.createDataFrame([(7, *r) for r in rows], "query_id int, chunk_id int, score double, terms array<string>")
    got = [r.chunk_id for r in rerank.mmr(df, 3).orderBy("pick").collect()]
    assert got == brute_mmr(rows, 3, 0.7, jac)


def test_packing(spark):
    hits = spark.createDataFrame(
        [(1, 1, "x-1", "x", 0, 400, "a" * 400), (1, 2, "x-2", "x", 150, 400, "b" * 250), (1, 3, "x-3", "x", 200, 600, "c" * 400), (1, 4, "y-1", "y", 0, 90, "d" * 90)],
        "query_id int, rank int, chunk_id string, doc_id string, start int, end int, text string",
    )
    got = {r.chunk_id: (r.citation, r.reason) for r in rerank.pack_skipping(hits, 500).collect()}
    assert got == {"x-1": ("S1", None), "x-2": (None, "overlap"), "x-3": (None, "budget"), "y-1": ("S2", None)}
    with pytest.raises(ValueError):
        rerank.pack_skipping(hits, 100)
    full = rerank.pack_until_full(hits, 300, F.length("text")).collect()
    assert [r.rank for r in full] == [1]
    text = rerank.context_text(rerank.pack_until_full(hits, 700, F.length("text")), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]"))).first().context
    assert text == "[1]\n" + "a" * 400 + "\n\n[2]\n" + "b" * 250
    made = rerank.prompt(hits).first()
    assert made.prompt.startswith("[1] aaa") and made.previews[0] == "a" * 200 + "…"


def test_answers(spark):
    src = spark.createDataFrame(
        [(1, "rollback steps", 1, "S1", "Intro here. Rollback needs steps. Other. Rollback again!"), (1, "rollback steps", 2, "S2", "Nothing at all."), (2, "zzz", 1, "S1", "First. Second.")],
        "query_id int, query string, rank int, citation string, text string",
    )
    got = {r.query_id: r.answer for r in rerank.extractive_answers(src).collect()}
    assert got[1] == "“Rollback needs steps. Rollback again!” [S1]"
    assert got[2] == "“First. Second.” [S1]"
    df = spark.createDataFrame([("回滚 步骤", "前言。回滚有步骤。结束。无关。")], "q string, t string")
    assert df.select(rerank.key_sentences(F.col("q"), F.col("t")).alias("k")).first().k == ["回滚有步骤。"]
    assert df.select(rerank.snippet(F.col("q"), F.col("t")).alias("k")).first().k == "前言。回滚有步骤。结束"


def test_contexts_and_full_answers(spark):
    kind = "query_id int, query string, rank int, chunk_id int, path string, chunk_idx int, heading string, score double, text string"
    hits = spark.createDataFrame(
        [(1, "回滚 步骤", 1, 5, "a.md", 0, "H", 0.51239, "前言。回滚有步骤。"), (1, "回滚 步骤", 2, 6, "a.md", 0, "", 0.4, "again"), (1, "回滚 步骤", 3, 7, "b.md", 1, "", 0.3, "更多内容。"), (1, "回滚 步骤", 4, 8, "a.md", 2, "", 0.2, "x " * 40)], kind
    )
    got = rerank.pro_context(hits, 30).first()
    assert got.context == "[1] 来源：a.md\n前言。回滚有步骤。\n\n[2] 来源：b.md\n更多内容。" and got.used == ["a.md", "b.md"]
    assert rerank.pro_context(hits, 1).first().used == ["a.md"] and len(rerank.pro_context(hits, 10_000, 2).first().used) == 2
    kit = rerank.kit_context(hits.withColumnRenamed("path", "src"), 18).first().contexts
    assert kit == ["[1] 出典: a.md / 見出し: H\n前言。回滚有步骤。", "[2] 出典: a.md\nagain"]
    assert rerank.citations(hits).first().citations == ["a.md", "b.md"]
    answer = rerank.pro_answers(hits.where("rank in (1, 3)")).first().answer
    assert answer == "回滚有步骤。\n更多内容。\n\n参考来源：\n[1] a.md\n[2] b.md"
    assert rerank.pro_answers(hits.where("rank = 4")).first().answer.startswith("x x ")
    full = rerank.kit_answers(hits.withColumnRenamed("path", "src")).first()
    assert full.answer == "【抽出回答】\n回滚 步骤\n根拠: 前言。回滚有步骤\n（出典: a.md）" and [s.score for s in full.sources] == [0.5124, 0.4, 0.3] and full.sources[0].heading == "H"


def test_worked_metrics(spark):
    cases = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    ranking = spark.createDataFrame([(1, 1, True), (2, 2, True), (2, 1, False), (3, 4, True), (4, 1, False)], "query_id int, rank int, right boolean")
    hits = evaluate.first_hits(cases, ranking, F.col("right"))
    r = evaluate.quality(hits, 4).first()
    assert (r.n_cases, r.hit_rate, r.mrr) == (4, 0.75, 0.4375)
    assert evaluate.quality(hits.limit(0), 4).first().mrr is None
    assert evaluate.no_candidate_rate(evaluate.first_hits(cases, ranking.where("query_id = 1"), F.col("right"))).first().no_candidate_rate == 0.75


def test_weighted_rerank(spark):
    df = spark.createDataFrame([(1, 10, "apple pie", "apple tart", 0, 2.0, 0.5), (1, 11, "apple pie", "apple pie", 100, 1.0, 1.0)], "query_id int, chunk_id int, query string, text string, ordinal int, lexical double, vector double")
    got = {r.chunk_id: r.score for r in rerank.weighted(df).collect()}
    assert got[10] == pytest.approx(0.35 + 0.35 * 0.5 + 0.1 + 0.2 * 0.5) and got[11] == pytest.approx(0.175 + 0.35 + 0.05 + 0.2)
    cov = spark.createDataFrame([(1, 1, "apple", "", "", 0.1), (1, 2, "apple", "apple" + "x" * 295, "H", 0.1), (1, 3, "apple", "apple" + " " * 295, "H", 0.1)], "query_id int, chunk_id int, query string, text string, heading string, base double")
    got = {r.chunk_id: r.score for r in rerank.covered(cov).collect()}
    assert got[1] == pytest.approx(0.1 - 0.3) and got[2] == pytest.approx(0.15) and got[3] == pytest.approx(0.75)
