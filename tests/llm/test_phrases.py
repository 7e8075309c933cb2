"""Lempel-Ziv fingerprints: a plain parse, edits side by side, likeness against exact Jaccard."""

import hashlib
import random

import pytest

from tessellane.llm import phrases


def plain(text):
    seen, out, w = set(), [], ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            out.append(w)
            w = ""
    return out


def polynomial(phrase):
    h = 0
    for c in phrase:
        h = (h * phrases._BASE + ord(c) + 1) % phrases._PRIME
    return h


def kept(found):
    """The smallest mixed hashes, one by one."""
    out = set()
    for w in found:
        h = polynomial(w)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor % 2**64
        out.add((h ^ h >> 33) >> 32)
    return phrases.np.array(sorted(out)[: phrases.KEPT], phrases.np.uint32)


def make(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "ö", "delta", "on", "the", "x"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("text", ["", "a", "aaaaaaa", "abababab", "é漢👍" * 9, "a" * 20000, "\x00\x01" * 50])
def test_parse(text):
    want = [polynomial(w) for w in plain(text)]
    for at in (0, len(text) // 2, len(text)):
        own = phrases.Parse()
        own.go_on(text[:at])
        mark = own.mark()
        own.go_on("something else")
        own.back(mark)
        own.go_on(text[at:])
        assert own.hashes[1:] == want and len(set(want)) == len(want)
    assert (phrases.smallest(text) == kept(plain(text))).all()


def test_no_phrase_is_too_long():
    short, long = phrases.smallest("a" * 3000), phrases.smallest("a" * 300_000)
    assert phrases.likeness(short, long) < 0.5  # 76 phrases, and 773 of which 76 are the same
    assert phrases.likeness(phrases.smallest("ab" * 2000), phrases.smallest("ab" * 2000)) == 1


def test_likeness_follows_jaccard():
    rng = random.Random(4)
    for share in (0.0, 0.3, 0.7, 1.0):
        a = make(rng, 800)
        b = a[: int(len(a) * share)] + make(rng, 800)[int(len(a) * share) :]
        p, q = set(plain(a)), set(plain(b))
        want = len(p & q) / len(p | q)
        assert abs(phrases.likeness(phrases.smallest(a), phrases.smallest(b)) - want) < 0.16
    assert phrases.fingerprint(a) == phrases.fingerprint(a) and phrases.likeness(phrases.smallest(a), phrases.smallest(a)) == 1
    assert phrases.show(phrases.read(phrases.fingerprint(a))) == phrases.fingerprint(a)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_edits_equal_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(6)
    made = [(i * 3, make(rng, rng.choice([0, 1, 5, 60, 400]))) for i in range(90)] + [(1, None), (2, ""), (9, "again"), (9, "again"), (10**12, "é" * 7), (-5, "neg 👍👍")]
    rng.shuffle(made)
    docs = spark.createDataFrame([(*r, "x") for r in made], "doc_id long, text string, n_chars string")
    got = sorted(map(tuple, phrases.with_edits(docs).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    line = sorted((i, t or "") for i, t in made)
    want = []
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        p, e, n = (kept(plain(x)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), phrases.show(p), phrases.show(e), phrases.likeness(p, e), phrases.likeness(p, n)))
    assert got == sorted(want)


def test_small_tables(spark):
    one = spark.createDataFrame([(7, "only one")], "doc_id long, text string")
    r = phrases.with_edits(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert phrases.with_edits(one.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "a b c"), (None, "d"), (4, "e f")], "doc_id long, text string")
    assert phrases.with_edits(lost).count() == 3
    assert phrases.fingerprints(lost).count() == 3
    named = spark.createDataFrame([("x", "a b"), ("y", None), ("y", None)], "doc_id string, text string")
    assert sorted(r.fingerprint for r in phrases.fingerprints(named).collect())[:2] == ["", ""]
    with pytest.raises(TypeError):
        phrases.with_edits(named)
