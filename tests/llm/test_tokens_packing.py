"""Token counts against the library, packing by its invariants."""

import random
import zlib

import numpy as np
import pytest

from tessellane.llm import packing, tokens


@pytest.fixture(scope="module")
def words():
    return tokens.PrefixCounter(tokens.tokenizer_path())


TEXTS = [
    "", " ", "The cat's  sat\n\n\ton THE mat. don't we'll I'd", "éÉ ñ ß œ Ǆ ŉ İstanbul ﬁne", "é Å x̧y", "漢字 と かな 한국어 👍🏽 mixed1234 ¼½ ²", "a<|endoftext|>b", "< | <|start", "x\x1cy \x1d z",
    " nbsp em\u0085nel ls", "word" * 400, "ΟΔΥΣΣΕΥΣ ΣΑΣ.", "a  b   c \n \n d   ", "1234567 3.14 $%&'s 're", "'", "''s 'S 'T",
]


@pytest.mark.parametrize("text", TEXTS)
def test_count_equals_library(words, text):
    assert words.count(text) == len(words.tokenizer.encode(text, add_special_tokens=False).ids)


def test_random_texts_equal_library(words):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab cDé'st 1²\n.,&<|>ªǅ ́") for _ in range(rng.randrange(80)))
        assert words.count(text) == len(words.tokenizer.encode(text, add_special_tokens=False).ids), text


def test_count_tokens_table(spark, words):
    made = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (0, "", "x"), (50, "long words here " * 4000, "x")]
    got = {tuple(r) for r in tokens.count_tokens(spark.createDataFrame(made, "doc_id long, text string, n_tokens string"), tokens.tokenizer_path()).collect()}
    for i, t, _ in made:
        n = len(words.tokenizer.encode(t or "", add_special_tokens=False).ids)
        row = next(r for r in got if r[0] == i)
        assert row[:4] == (i, len((t or "").encode()), n, n > 2048)
        assert words.count((t or "")[: row[4]]) <= 2048
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokens.tokenizer_path()).count() == 0


@pytest.mark.parametrize("chunk", range(8))
def test_ids_equal_library(chunk):
    own = packing.encoder(packing.tokenizer_path(packing.MODEL))
    want = lambda t: np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(chunk)
    chars = [chr(c) for c in range(0x250)]
    for t in TEXTS + ["".join(chars)]:
        assert own(t) == want(t), t
    for _ in range(300):
        t = "".join(rng.choice("ab  cDé'st re1²\n\t.,&<|>ªǅ ") if rng.random() < 0.7 else rng.choice(chars) for _ in range(rng.randrange(60)))
        assert own(t) == want(t), t


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("seed", range(5))
def test_evolve_is_a_tight_partition(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 1025) for _ in range(700)]
    groups = packing.evolve(sizes, 1024, seed)
    assert sorted(x for g in groups for x in g) == list(range(700))
    assert all(0 < sum(sizes[x] for x in g) <= 1024 for g in groups)
    plain = packing.best_fit(sizes, [], sorted(range(700), key=lambda x: -sizes[x]), 1024)
    assert packing.fitness(packing.measured(sizes, groups)) >= packing.fitness(packing.measured(sizes, plain))
    assert packing.evolve([], 1024) == []


@pytest.mark.parametrize(("n", "most"), [(20, 21), (60, 62), (150, 153)])
def test_evolve_beats_best_fit_decreasing(n, most):
    rng, sizes = random.Random(n), []
    for _ in range(n):  # sequences of three pieces each that are full: the fewest there can be is known
        a = rng.randrange(260, 420)
        b = rng.randrange(260, 1024 - a - 260)
        sizes += [a, b, 1024 - a - b]
    plain = packing.best_fit(sizes, [], sorted(range(3 * n), key=lambda x: -sizes[x]), 1024)
    groups = packing.evolve(sizes, 1024, 1)
    assert n <= len(groups) <= most < len(plain)


def fewest(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_evolve_finds_the_fewest_of_small_cases():
    rng = random.Random(6)
    for _ in range(60):
        sizes = [rng.randrange(10, 70) for _ in range(rng.randrange(1, 11))]
        assert len(packing.evolve(sizes, 100, 3)) == fewest(sizes, 100), sizes


def test_best_subset_comes_nearest():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(9)]
        space = rng.randrange(0, 150)
        got = packing.best_subset(sizes, list(range(9)), space)
        sums = [sum(x for k, x in enumerate(sizes) if m >> k & 1) for m in range(512)]
        assert len(set(got)) == len(got) and sum(sizes[k] for k in got) == max(x for x in sums if x <= space)


def test_crossover_keeps_every_piece_once():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 1024) for _ in range(300)]
    falling = sorted(range(300), key=lambda x: -sizes[x])
    a, b = (packing.measured(sizes, packing.best_fit(sizes, [], order, 1024)) for order in (falling, falling[::-1]))
    for _ in range(30):
        a = packing.crossover(sizes, b, a, 1024, rng)
        assert sorted(x for _, g in a for x in g) == list(range(300)) and all(f == sum(sizes[x] for x in g) <= 1024 for f, g in a)


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 64)
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "to", "é"]) for _ in range(rng.choice([0, 3, 90, 400, 900, 3000]))), "x") for i in range(250)]
    made += [(900, None, "x"), (901, "", "x"), (0, made[0][1], "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, offset string")
    out = packing.pack_documents(docs).toPandas()
    own = packing.encoder(packing.tokenizer_path(packing.MODEL))
    want = []
    for i, t, _ in made:
        ids = own(t or "") + np.array([2], "<u4").tobytes()
        want += [(i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(ids) // 4))]
    assert sorted(want) == sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    sizes = out.length.tolist()
    assert out.sequence_id.nunique() <= len(packing.best_fit(sizes, [], sorted(range(len(sizes)), key=lambda x: -sizes[x]), 1024)) + 3
    assert packing.pack_documents(docs.limit(0)).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, "c " * 1500)], "doc_id long, text string")
    seqs = packing.sequences(packing.pack_documents(few), few).collect()
    assert sorted(len(s.ids) for s in seqs)[-1] == 1024 and sum(len(s.ids) for s in seqs) == sum(len(own(t)) // 4 + 1 for t in ("a b", "c " * 1500))


LONG = [
    "漢字かな" * 60, "https://example.org/a/b?c=d&e=" + "QmFzZTY0" * 60, "it're'l!!'s 'vex''ll" * 9, "İSTANBULǅéÉ" * 40, "éx̧가각" * 20, "한국어" * 90, "a" * 500, "👍🏽" * 60,
    "function(){return!0};" * 40, "  lead " + "z9" * 90 + "  end  ",
]


#: Marks that compose, that don't, jamo and vowel signs; special strings beside words and cut ones.
ODD = [
    "e\u0301" * 40, "a\u0323\u0302b\u0302\u0323" * 12, "\u1112\u1161\u11ab\u1100\u1173\u11af" * 9, "\u0915\u093e\u09c7\u09be" * 8, "x'\u0301s 're\u0301 '\u0327s ''s\u0308" * 3, "!'s\u0301" * 5,
    "\u0301\u0302 \u0301", "1\u0301" * 5, "...\u0338" * 6, "a<|endoftext|><|endoftext|>b!!<|endoftext|>  <|startoftext|>c", "<|endoftext|", "x<|<|endoftext|>", "q\x1c<|endoftext|>\x1f", "\u212b\u1e9b\u0323",
]


def brute(words, text):
    return [len(words.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


@pytest.mark.parametrize("text", [t[:200] for t in TEXTS] + LONG + ODD)
def test_fit_is_the_longest_prefix(words, text):
    want = brute(words, text)
    units = words.units(text)
    assert words.prefixes(text).tolist() == want and words.count(text) == want[-1]
    assert [words.count_at(text, k, units) for k in range(len(text) + 2)] == [*want, want[-1]]
    for budget in (0, 1, 2, 3, 7, 20, 33, 100, 250):
        assert words.fit(text, budget, units) == max(k for k, n in enumerate(want) if n <= budget)


def test_fit_of_random_words(words):
    rng = random.Random(8)
    parts = ["the", "ing", "'re", "'", "l", "é", "Ö", "1", "..", "=", "漢", "ß", "tion", "x", "q", " ", "e", "\u0301", "\u0323", "<|endoftext|>", "<|", "\x1d", "!", "\u1161", "\u1112", "s"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        want = brute(words, text)
        assert words.prefixes(text).tolist() == want, text
        for budget in (rng.randrange(12), 9):
            assert words.fit(text, budget) == max(k for k, n in enumerate(want) if n <= budget), text


def test_long_texts_take_linear_time(words):
    import time

    for text in ("abc <|endoftext|>" * 1000 + "word salad " * 90_000, "a<|endoftext|>" * 60_000, "e\u0301" * 100_000, "x\x1cy " * 100_000, "漢" * 200_000):
        began = time.perf_counter()
        n = words.count(text)
        k = words.fit(text, 2048)
        assert n > 2048 and words.count(text[:k]) <= 2048 and time.perf_counter() - began < 20


def test_prefix_tables(spark, words):
    made = [(i, t) for i, t in enumerate(TEXTS + ODD)] + [(99, None), (0, "again")]
    stored = tokens.prefix_tables(spark.createDataFrame(made, "doc_id long, text string"), tokens.tokenizer_path())
    got = sorted((r.doc_id, r.counts) for r in stored.collect())
    assert got == sorted((i, brute(words, t or "")) for i, t in made)
    asked = stored.select("doc_id", "counts", tokens.tokens_of_prefix(tokens.F.col("counts"), tokens.F.lit(5)).alias("n"), tokens.longest_fit(tokens.F.col("counts"), tokens.F.lit(3)).alias("k"))
    for r in asked.collect():
        assert r.n == r.counts[min(5, len(r.counts) - 1)] and r.k == max(k for k, n in enumerate(r.counts) if n <= 3)
    assert stored.select(tokens.longest_fit(tokens.F.col("counts"), tokens.F.lit(-1)).alias("k")).first().k is None


def test_words_without_white_space(spark, words):
    made = spark.createDataFrame([(1, "漢字かな" * 2000), (2, "x " * 2047 + "w" + "QmFzZTY0" * 4000)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(made, tokens.tokenizer_path()).collect()}
    assert got[1].over_limit and 0 < got[1].fit_chars < 8000 and got[2].fit_chars >= 2 * 2047
    assert words.count(("漢字かな" * 2000)[: got[1].fit_chars]) <= 2048 < words.count(("漢字かな" * 2000)[: got[1].fit_chars + 1])
