"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first bytes (``STEMS``), so words never
seen share what their stems have learned. Filters of several widths slide over the whole text, each keeps its maximum,
and a logistic layer reads the maxima. Thresholds are calibrated by language: the language is told from the text's own
letters (``language_of``), and its logit is shifted so that 0.5 is where that language's held-back rows separate best.
No column but the text is an input of a score.

Training uses a sample of at most ``TRAIN_ROWS`` labelled rows (the rows of smallest hash, half of each label where there are
enough), whatever the table's size; scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import small_batches, whole_text

#: Documented bounds of the training sample: rows, and characters of all its texts.
TRAIN_ROWS, TRAIN_CHARS = 6000, 40_000_000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 6, (1, 2, 3)
STEMS = (4, 5, 6)
#: By 3-fold cross-validation inside the training rows (5 to 18 epochs, rates 0.05 to 0.2, embeddings that begin at 0 to 0.1).
EPOCHS, RATE, BATCH, BEGIN = 8, 0.1, 16, 0.005
LANGUAGES = ("de", "es", "fr", "en")
#: Words kept by a worker with their projections; beyond it the store starts anew.
KEPT_WORDS = 150_000
_WORD = re.compile(r"\w+")
_LETTERS = {"de": "äöüß", "es": "ñíóáú", "fr": "éèêçàù"}
N_MAPS = sum(WIDTHS)


def language_of(text: str) -> str:
    """The language whose own letters the text has most of; English if it has none."""
    if text.isascii():
        return "en"
    counts = {k: sum(text.count(c) for c in own) for k, own in _LETTERS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] * 400 >= len(text) else "en"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets(word: str) -> list[int]:
    """Rows of the embedding table: the word's and its stems'."""
    own = word.encode()
    return [crc32(own) % BUCKETS, *[crc32(own[:n], n) % BUCKETS for n in STEMS]]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x SIZE
    filters: np.ndarray  # N_MAPS x SIZE x FILTERS: one map for each width and place in it
    bias: np.ndarray  # widths x FILTERS
    out: np.ndarray  # widths x FILTERS
    out_bias: float
    shift: dict[str, float]

    def maps(self) -> np.ndarray:
        """SIZE x (N_MAPS * FILTERS), so that one product gives every place of every filter."""
        return self.filters.transpose(1, 0, 2).reshape(SIZE, -1)


def _convolve(projected: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima (widths x FILTERS) over places, and where they are; ``projected`` has a row of N_MAPS * FILTERS for each word."""
    tops, at, m = [], [], 0
    for w in WIDTHS:
        n = len(projected) - w + 1
        own = projected[:n, m * FILTERS : (m + 1) * FILTERS]
        for k in range(1, w):
            own = own + projected[k : k + n, (m + k) * FILTERS : (m + k + 1) * FILTERS]
        at.append(own.argmax(axis=0))
        tops.append(own.max(axis=0))
        m += w
    return np.array(tops) + bias, np.array(at)


_PAD = [f"\0{k}" for k in range(max(WIDTHS))]


def fresh(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    return Model(
        rng.normal(0, BEGIN, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.4, (N_MAPS, SIZE, FILTERS)).astype(np.float32),
        np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32), 0.0, {},
    )


class Corpus:
    """Texts as numbers: of each its distinct words, and which of them stands where; of each word its rows of the table."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        rows: list[list[int]] = []
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        for t in texts:
            own = words(t)
            own += _PAD[: max(0, max(WIDTHS) - len(own))]
            place = []
            for w in own:
                if (i := known.get(w)) is None:
                    i = known[w] = len(rows)
                    rows.append(buckets(w))
                place.append(i)
            unique, inverse = np.unique(np.array(place, np.int32), return_inverse=True)
            self.texts.append((unique, inverse.astype(np.int32)))
        self.rows = np.array(rows, np.int64).reshape(len(rows), 1 + len(STEMS))


def gradients(model: Model, corpus: Corpus, chosen: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss on the texts ``chosen``: for filters, bias and out; for out_bias; rows of the table and their gradients."""
    grads = {k: np.zeros_like(getattr(model, k)) for k in ("filters", "bias", "out")}
    d_ob, touched, t_grads = 0.0, [], []
    flat = model.maps()
    for d in chosen:
        unique, inverse = corpus.texts[d]
        emb = model.table[corpus.rows[unique]].sum(axis=1)
        tops, at = _convolve((emb @ flat)[inverse], model.bias)
        act = np.tanh(tops)
        p = 1 / (1 + np.exp(-np.clip(float((act * model.out).sum() + model.out_bias), -30, 30)))
        err = model.out.dtype.type(p - labels[d])
        grads["out"] += err * act
        d_ob += float(err)
        d_top = err * model.out * (1 - act * act)
        grads["bias"] += d_top
        m = 0
        for wi, w in enumerate(WIDTHS):
            for k in range(w):
                hit = inverse[at[wi] + k]
                grads["filters"][m + k] += (emb[hit] * d_top[wi][:, None]).T
                touched.append(corpus.rows[unique[hit]])
                t_grads.append(d_top[wi][:, None] * model.filters[m + k].T)
            m += w
    n = len(chosen)
    where = np.concatenate(touched)
    value = np.concatenate(t_grads) / n
    uniq, back = np.unique(where, return_inverse=True)
    total = np.zeros((len(uniq), SIZE), model.table.dtype)
    back = back.reshape(where.shape)
    for c in range(where.shape[1]):
        np.add.at(total, back[:, c], value)
    return {k: g / n for k, g in grads.items()}, d_ob / n, uniq, total


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit on four fifths of the rows, calibrate the languages' shifts on the last fifth.

    Without texts, or with one label only, the score is the same for every text. Repeated rows count as often as they occur.
    """
    rng = np.random.default_rng(seed)
    model = fresh(seed)
    if not len(texts) or labels.min() == labels.max():
        model.out[:] = 0
        model.out_bias = float(4 * (labels.mean() - 0.5)) if len(texts) else -2.0
        return model
    corpus = Corpus(texts)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    g_table = np.full(BUCKETS, 1e-3, np.float32)
    sums = {k: np.full_like(getattr(model, k), 1e-3) for k in ("filters", "bias", "out")}
    g_ob = 1e-3
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(fit)
        for start in range(0, len(fit), BATCH):
            grads, d_ob, uniq, total = gradients(model, corpus, fit[start : start + BATCH], labels)
            g_table[uniq] += (total**2).mean(axis=1)
            model.table[uniq] -= step * total / np.sqrt(g_table[uniq])[:, None]
            for k, g in grads.items():
                sums[k] += g**2
                getattr(model, k)[...] -= step * g / np.sqrt(sums[k])
            g_ob += d_ob**2
            model.out_bias -= step * d_ob / g_ob**0.5
    logits = _logits(model, [texts[d] for d in held])
    calibrate(model, [language_of(texts[d]) for d in held], logits, labels[held])
    return model


def cross_validated(texts: list[str], labels: np.ndarray, folds: int = 3, **settings) -> float:
    """Accuracy on training rows that weren't fitted, each fold once: what settings are chosen by. Held-out rows aren't looked at."""
    fold = np.random.default_rng(1).permutation(len(texts)) % folds
    right = 0
    for k in range(folds):
        model = Scorer(train([t for t, f in zip(texts, fold, strict=True) if f != k], labels[fold != k], **settings))
        right += sum((model.score(texts[i]) >= 0.5) == (labels[i] == 1) for i in np.flatnonzero(fold == k))
    return right / max(len(texts), 1)


def _logits(model: Model, texts: list[str]) -> np.ndarray:
    own = Scorer(model)
    return np.array([own.logit(t) for t in texts])


def calibrate(model: Model, languages: list[str], logits: np.ndarray, labels: np.ndarray) -> None:
    """For each language the shift at which most of its rows are on the right side; the widest gap of the best ones."""
    for lang in LANGUAGES:
        own = np.array([x == lang for x in languages], bool)
        y, z = labels[own], logits[own]
        if len(y) < 20 or y.min() == y.max():
            continue
        order = np.argsort(z)
        y, z = y[order], z[order]
        right = np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([np.cumsum((y == 1)[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        best = np.flatnonzero(right == right.max())
        gaps = np.concatenate([[0], np.diff(z), [0]])[best]
        model.shift[lang] = float(edges[best[gaps.argmax()]])


class Scorer:
    """Scores whole texts; a word's projections are made once."""

    def __init__(self, model: Model) -> None:
        self.model, self.flat = model, model.maps()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, N_MAPS * FILTERS), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        at = len(self.known)
        while at + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(fresh)] = self.model.table[np.array([buckets(w) for w in fresh])].sum(axis=1) @ self.flat
        self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def logit(self, text: str) -> float:
        own = words(text)
        own += _PAD[: max(0, max(WIDTHS) - len(own))]
        fresh = list(set(own).difference(self.known))
        if len(self.known) + len(fresh) > KEPT_WORDS and self.known:
            self._clear()
            fresh = list(set(own))
        self._learn(fresh)
        ids = np.fromiter(map(self.known.__getitem__, own), np.int32, len(own))
        top = None
        for s in range(0, len(ids), 20_000):  # bounded memory on very long texts; neighbours overlap by the widest filter
            part = ids[s : s + 20_000 + max(WIDTHS) - 1]
            if s and len(part) < max(WIDTHS):
                break
            got = _convolve(self.rows[part], self.model.bias)[0]
            top = got if top is None else np.maximum(top, got)
        return float((np.tanh(top) * self.model.out).sum() + self.model.out_bias)

    def score(self, text: str) -> float:
        z = self.logit(text) - self.model.shift.get(language_of(text), 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> DataFrame:
    """text, toxic: at most ``rows`` labelled rows that aren't held out, half of each label where there are enough.

    Rows are taken by hash of doc_id: a label's threshold is set from its number of rows, so that the sample is spread over
    the table; the ``limit`` only trims what chance put above it. Null labels and ids don't count.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    own = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {t: max(rows // 2, rows - n.get(1 - t, 0)) for t in (0, 1)}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("toxic") == 1, F.lit(most[1] / max(n.get(1, 0), 1))).otherwise(F.lit(most[0] / max(n.get(0, 0), 1)))
    # At most rows (id, label) pairs: small enough to be sent to the texts, which then needn't be shuffled.
    picked = F.broadcast(own.where(h < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return docs.select("doc_id", whole_text(text).alias("text")).join(picked, "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod 5 isn't 0; reruns give the same model."""
    got = training_rows(docs, labels, rows, text).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(rows + rows // 4).collect()
    texts, y, chars = [], [], 0
    for r in got:
        if chars + len(r["text"]) <= TRAIN_CHARS:  # texts that would pass the bound aren't sampled
            chars += len(r["text"])
            texts.append(r["text"])
            y.append(r["toxic"])
    return train(texts, np.array(y, np.float32))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score: one row a document, in one pass without a shuffle.

    Null and empty texts are scored as texts without words; texts are read whole; repeated rows stay; an empty table gives an
    empty table; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x SIZE numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(sent.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't scored toxic (score under 0.5).

    Null and empty texts are texts without words; repeated rows stay or go together; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.where(scored(whole_text(text)) < 0.5)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document. Null doc_id counts as not held out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs, fit(docs, labels, rows, text), text).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
