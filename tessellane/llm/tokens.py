"""Token counts by prefix dynamic programming.

``PrefixCounter`` knows the exact token count of every prefix of a text, and answers from that how many tokens a truncated text
has and how much of a text fits a budget. It works on two levels:

* A text is cut into units: special tokens' strings, which are one token each, and the words between white space and those. The
  vocabulary's pre-tokeniser never joins what stands on both sides of such a cut, so the running total of the units' counts
  is the count of every prefix that ends with a unit; its last entry is the text's count.
* Inside a unit, the tokens of a prefix are those of a shorter prefix and one last token that may follow them; one pass over the
  unit has them all (``_Merges``). A word whose characters compose when they are normalised has prefixes that are no prefixes
  of the normalised word: they are parts of it and a few characters that stand for the cut one. A prefix that ends inside
  a special token's string is plain text there and continues the word before it.

Words' counts, and the arrays of words that were cut, are kept per distinct word. All is linear in the length of a text, but for
runs of combining marks, whose square counts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import small_batches, whole_text

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: Words kept by a worker; beyond it the store starts anew, so memory is bounded.
KEPT_WORDS = 300_000
#: Words longer than this are counted but not kept.
KEPT_LENGTH = 64
#: Arrays of cut words kept by a worker.
KEPT_ARRAYS = 20_000
#: Python calls these white space, the tokeniser doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words: what stands between white space as the tokeniser understands it.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Word -> tokens."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word, add_special_tokens=False).ids)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class _Merges:
    """Token counts of all prefixes of a piece (in the tokeniser's byte characters), by dynamic programming.

    A sequence of tokens is a string's encoding exactly if each two neighbours are the encoding of what they spell. So a
    prefix's encoding is that of a shorter prefix and the one last token that may follow it. The vocabulary marks the end of a
    piece on its last token: each prefix has a last token inside a piece and one at a piece's end.
    """

    def __init__(self, model: dict) -> None:
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): self.vocab[a + b] for a, b in pairs}
        self.parts = {c: ab for ab, c in self.rank.items()}
        made = list(self.rank.values())
        # Ids have to follow the order of merges and each token to have one merge.
        self.sound = made == sorted(set(made)) and len(made) == len(self.vocab) - made[0] and len(self.rank) == len(pairs)
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.known: dict[tuple[int, int], bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[a, b] = self._may_follow(a, b)
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                if a in self.parts:
                    a = self.parts[a][1]
                    continue
                limit = b + 1
                if b not in self.parts:
                    return True
                b = self.parts[b][0]
            else:
                limit = b + 1
                if b in self.parts:
                    b = self.parts[b][0]
                    continue
                limit = a
                if a not in self.parts:
                    return True
                a = self.parts[a][1]

    def table(self, piece: str, limit: int | None = None) -> tuple[list[int], list[int]]:
        """(last, n) for each place in ``piece``: the last token of what is before it, and the number of tokens.

        The table ends early where all that follows has more than ``limit`` tokens: a count is one more than one of the
        ``longest`` before it.
        """
        last, n, high = [-1], [0], 0
        for i in range(1, len(piece) + 1):
            token, count = self._step(piece, i, "", last, n, 0)
            last.append(token)
            n.append(count)
            high = high + 1 if limit is not None and (count > limit or token == -2) else 0
            if high > self.longest:
                break
        return last, n

    def _step(self, piece: str, i: int, mark: str, last: list[int], n: list[int], base: int) -> tuple[int, int]:
        """Last token and count of ``piece[:i]``; ``last`` and ``n`` begin at the place ``base``."""
        for j in range(max(base, i - self.longest), i):
            token = self.vocab.get(piece[j:i] + mark)
            if token is not None and last[j - base] != -2 and (j == 0 or self.may_follow(last[j - base], token)):
                return token, n[j - base] + 1
        return -2, 0

    def counts(self, piece: str, ends: list[int], table: tuple[list[int], list[int]]) -> list[int]:
        """Tokens of ``piece[:e]`` for each of ``ends``, each taken as a whole piece; -1 beyond the table."""
        last, n = table
        return [self._step(piece, e, self.suffix, last, n, 0)[1] if e <= len(last) else -1 for e in ends]

    def grown(self, piece: str, upto: int, more: str, table: tuple[list[int], list[int]]) -> int:
        """Tokens of ``piece[:upto] + more`` as a whole piece; -1 beyond the table."""
        if upto >= len(table[0]):
            return -1
        base = max(0, upto - self.longest)
        last, n = table[0][base : upto + 1], table[1][base : upto + 1]
        # Only the last ``longest`` places matter; ``base`` is the string's beginning if it is 0.
        text = "\0" * base + piece[base:upto] + more
        for i in range(upto + 1, len(text)):
            token, count = self._step(text, i, "", last, n, base)
            last.append(token)
            n.append(count)
        return self._step(text, len(text), self.suffix, last, n, base)[1]


@lru_cache(maxsize=1)
def _joiners() -> frozenset[str]:
    """Characters that may compose with one before them though they are no combining marks (vowel signs, Hangul jamo)."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0xC0, 0x1E000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


class Units:
    """The units of a text: where they begin and end, whether they are special, and the tokens before each and after the last."""

    def __init__(self, spans: list[tuple[int, int, bool]], tokens: list[int]) -> None:
        self.starts = np.array([s[0] for s in spans], np.int64)
        self.ends = np.array([s[1] for s in spans], np.int64)
        self.special = [s[2] for s in spans]
        self.counts = np.cumsum([0, *tokens])


class PrefixCounter:
    """Exact token counts of all prefixes of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = [t.content for t in added]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added) or any(a != b and b.startswith(a) for a in names for b in names):
            raise ValueError("special tokens that depend on what is around them aren't supported")
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.words = _Words(self.tokenizer.encode)
        self.arrays: dict[str, np.ndarray] = {}
        with open(path, encoding="utf-8") as f:
            self.merges = _Merges(json.load(f)["model"])

    def _spans(self, text: str) -> Iterator[tuple[int, int, bool]]:
        at = 0
        for m in [*self.special.finditer(text), None]:
            for w in _WORD.finditer(text, at, m.start() if m else len(text)):
                yield w.start(), w.end(), False
            if m:
                yield m.start(), m.end(), True
                at = m.end()

    def totals(self, text: str) -> np.ndarray:
        """The running total of the units' counts: tokens of the prefixes that end with each unit, after a 0."""
        if self.special.search(text):
            return self.units(text).counts
        words = _WORD.findall(text) if _SEPARATORS.search(text) else text.split()
        return np.cumsum(np.fromiter(chain((0,), map(self.words.__getitem__, words)), np.int64, len(words) + 1))

    def count(self, text: str) -> int:
        return int(self.totals(text)[-1])

    def units(self, text: str) -> Units:
        spans = list(self._spans(text))
        return Units(spans, [1 if special else self.words[text[s:e]] for s, e, special in spans])

    def inside(self, word: str) -> np.ndarray:
        """Exact token counts of ``word[:k]``, as plain text, for every k of 0 to the word's length."""
        found = self.arrays.get(word)
        if found is None:
            found = self._inside(word)
            if len(word) <= KEPT_LENGTH:
                if len(self.arrays) >= KEPT_ARRAYS:
                    self.arrays.clear()
                self.arrays[word] = found
        return found

    def _inside(self, word: str, limit: int | None = None) -> np.ndarray:
        """As ``inside``; with a ``limit``, counts above it may be shown as any other above it."""
        normal = self.tokenizer.normalizer.normalize_str
        if not self.merges.sound:  # of another kind of vocabulary: each prefix is encoded
            return np.array([len(self.tokenizer.encode(word[:k], add_special_tokens=False).ids) for k in range(len(word) + 1)])
        # Clusters: characters that may compose with each other. at[k]: where the normalised prefix of k characters ends, if k is a cluster's end.
        loose = _joiners()
        begins = [k for k in range(len(word)) if k == 0 or not (unicodedata.combining(word[k]) or word[k] in loose)]
        shown = [normal(word[s:e]) for s, e in zip(begins, [*begins[1:], len(word)], strict=True)]
        text, at = "".join(shown), dict(zip(begins, accumulate(map(len, shown), initial=0), strict=False))
        at[len(word)] = len(text)
        counts, before, home = np.zeros(len(text) + 1, np.int64), 0, []
        for piece, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            own = text[start:end]
            sizes = list(accumulate((len(c.encode()) for c in own), initial=0))
            table = self.merges.table(piece, None if limit is None else max(limit - before, 0))
            if own[0] == "'" and len(own) > 1 and own[1].isalpha():  # 's, 're, ...: a cut one is other pieces
                found = [len(self.tokenizer.encode(own[:k], add_special_tokens=False).ids) for k in range(1, len(own) + 1)]
            else:
                found = self.merges.counts(piece, sizes[1:], table)
            counts[start + 1 : end + 1] = [before + n if n >= 0 else limit + 1 for n in found]
            home.append((start, before, piece, sizes, table))
            before = int(counts[end])
            if limit is not None and found[-1] < 0:
                counts[end + 1 :] = before = limit + 1
                break
        out = np.zeros(len(word) + 1, np.int64)
        starts = [h[0] for h in home]
        for s, e in zip(begins, [*begins[1:], len(word)], strict=True):
            out[e] = counts[at[e]]
            for k in range(s + 1, e):
                out[k] = self._cut(text, at[s], normal(word[s:k]), home[max(bisect_left(starts, at[s]) - 2, 0) : bisect_left(starts, at[s])], limit)
        return out

    def _cut(self, text: str, upto: int, tail: str, home: list[tuple], limit: int | None) -> int:
        """Tokens of ``text[:upto] + tail``; ``home`` has the piece that holds the character before ``upto``, after the piece before it."""
        encode = lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids)
        if not home:
            return encode(tail)
        start, before, piece, sizes, table = home[-1]
        if upto - start == 1 and text[home[0][0] : start] == "'":  # with the tail, 're or the like
            start, before = home[0][:2]
        if upto - start <= 3:
            return before + encode(text[start:upto] + tail)
        if limit is not None and sizes[upto - start] >= len(table[0]):
            return limit + 1
        # A run of one kind of characters: the last two tell how it goes on.
        made = self.tokenizer.pre_tokenizer.pre_tokenize_str(text[upto - 2 : upto] + tail)
        more = made[0][0][len(text[upto - 2 : upto].encode()) :]
        rest = (text[upto - 2 : upto] + tail)[made[0][1][1] :]
        return before + self.merges.grown(piece, sizes[upto - start], more, table) + (encode(rest) if rest else 0)

    def _glued(self, text: str, units: Units, i: int) -> tuple[int, int]:
        """Where the plain text that ends inside the special unit ``i`` begins, and the tokens before it."""
        if i and units.ends[i - 1] == units.starts[i] and not units.special[i - 1]:
            return int(units.starts[i - 1]), int(units.counts[i - 1])
        return int(units.starts[i]), int(units.counts[i])

    def count_at(self, text: str, chars: int, units: Units | None = None) -> int:
        """Tokens of ``text[:chars]``, from the units and, inside one, from its array."""
        units = units or self.units(text)
        i = int(np.searchsorted(units.ends, chars, "right"))
        if i == len(units.ends) or units.starts[i] >= chars:
            return int(units.counts[i])
        start, before = self._glued(text, units, i) if units.special[i] else (int(units.starts[i]), int(units.counts[i]))
        return before + int(self.inside(text[start : units.ends[i]])[chars - start])

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of ``text[:k]`` for every k of 0 to the text's length."""
        units, out, at = self.units(text), np.zeros(len(text) + 1, np.int64), 0
        for i, (s, e) in enumerate(zip(units.starts.tolist(), units.ends.tolist(), strict=True)):
            out[at : s + 1] = units.counts[i]
            start, before = self._glued(text, units, i) if units.special[i] else (s, int(units.counts[i]))
            out[s + 1 : e] = before + self.inside(text[start:e])[s + 1 - start : e - start]
            out[e] = units.counts[i + 1]
            at = e
        out[at:] = units.counts[-1]
        return out

    def fit(self, text: str, budget: int, units: Units | None = None) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens; it may end inside a word or with white space."""
        units = units or self.units(text)
        i = int(np.searchsorted(units.counts, budget, "right")) - 1
        if i == len(units.ends):
            return len(text)
        best = int(units.starts[i])
        # The unit that passes the budget, and a special one right after it, whose beginning is plain text.
        for k in range(i, min(i + 2, len(units.ends))):
            start, before = self._glued(text, units, k) if units.special[k] else (int(units.starts[k]), int(units.counts[k]))
            if k > i and (not units.special[k] or units.starts[k] != units.ends[i]):
                break
            word = text[start : units.ends[k]]
            # A token has at most ``longest`` bytes, and four code points or fewer compose to one: no longer prefix can fit.
            found = self._inside(word[: 4 * self.merges.longest * (budget + 1)], budget - before)
            fits = np.flatnonzero(found[: len(word)] <= budget - before)
            best = max([best, *(start + fits[-1:]).tolist()])
        return best


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: one row a document.

    ``n_tokens`` counts the whole text without added special tokens; ``fit_chars`` is the length, in code points, of the
    longest prefix that has at most ``limit`` tokens, inside a word too (the whole text if it fits). Null text is empty:
    0 bytes, 0 tokens. Repeated rows stay, an empty table gives an empty table, other columns aren't read. One pass over
    the texts, no shuffle; a worker holds one batch and a bounded store of words.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [own.count(t) for t in texts]
            fit = [len(t) if n <= limit else own.fit(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fit, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole_text(text).alias("text"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, counts array<int>: the exact token count at every prefix of each text, of 0 to all its code points.

    ``tokens_of_prefix`` and ``longest_fit`` answer from a stored table, without any encoding. Null text is empty and has the one
    count 0; repeated rows stay, an empty table gives an empty table, other columns aren't read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([own.prefixes(t).astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, counts array<int>")


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points (all, if there are fewer)."""
    return F.get(counts, F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1))


def longest_fit(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens; null if even the empty one has more."""
    from_end = F.array_position(F.transform(F.reverse(counts), lambda n: n <= budget), True)
    return F.when(from_end > 0, F.size(counts) - from_end)
