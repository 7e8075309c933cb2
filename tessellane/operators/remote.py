"""Optional hooks for remote models: embeddings, answers, query rewriting. Nothing here is called unless a caller passes a function
that reaches a model; what comes back is checked before it is used."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellane.functions.text import citations_hold

BATCH, TIMEOUT = 32, 90


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: int = TIMEOUT) -> dict:
    """JSON in, JSON out, over HTTPS only; redirects aren't followed, as they would take credentials elsewhere. ValueError if it fails."""
    if not url.startswith("https://"):
        raise ValueError("only https addresses are called")
    request = urllib.request.Request(url, data=json.dumps(body).encode(), headers={"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as answer:
            return json.load(answer)
    except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
        raise ValueError(f"the model can't be reached: {e}") from e


def in_order(data: list[dict], n: int) -> list[list[float]]:
    """Vectors of an answer that lists them with their ``index``."""
    rows = sorted(data, key=lambda r: r["index"])
    if [r["index"] for r in rows] != list(range(n)):
        raise ValueError("vectors are missing or out of order")
    return [r["embedding"] for r in rows]


def checked(vectors: list[list[float]], n: int) -> list[list[float]]:
    """``vectors``, if there are ``n``, none empty, all finite and of one length."""
    if len(vectors) != n or any(not v or not all(isinstance(x, int | float) and math.isfinite(x) for x in v) for v in vectors) or len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors are missing, not finite or of different lengths")
    return vectors


class Embedder:
    """Embeds texts with ``call`` (list of texts -> list of vectors), in batches of 32. ``name`` tells models apart."""

    def __init__(self, call: Callable[[list[str]], list[list[float]]], name: str) -> None:
        self.call, self.key = call, hashlib.sha256(name.encode()).hexdigest()

    def embedded(self, rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """key, embedding: each distinct text is sent once (by its SHA-256)."""
        call = self.call

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for s in range(0, len(part), BATCH):
                    own = part.iloc[s : s + BATCH]
                    yield pd.DataFrame({"digest": own["digest"].to_numpy(), "embedding": checked(call(own["text"].tolist()), len(own))})

        named = rows.select(key, F.sha2(F.col(text), 256).alias("digest"), F.col(text).alias("text"))
        once = named.groupBy("digest").agg(F.min("text").alias("text")).mapInPandas(run, "digest string, embedding array<double>")
        return named.join(once, "digest").select(key, "embedding")


def _called(call: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(asked: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else call(x)
            except ValueError:
                return None

        return asked.map(one)

    return run


def rewritten(queries: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """``queries`` (query_id, text) with texts as the model puts them, on one line; as they are without a model or where it fails or says nothing."""
    if call is None:
        return queries
    new = F.replace(F.trim(_called(call)("text")), F.lit("\n"), F.lit(" "))
    return queries.withColumn("text", F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(F.col("text")))


def answered(extractive: DataFrame, prompts: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """query_id, answer, kind of ``extractive`` (query_id, answer) and ``prompts`` (query_id, prompt, n_sources).

    The model's answer is taken (kind ``generated``) if it cites at least one source and none that wasn't given; where it doesn't, fails,
    or there is no model, the extractive answer stays (kind ``extractive``).
    """
    joined = extractive.join(prompts, "query_id", "left")
    candidate = _called(call)("prompt") if call else F.lit(None).cast("string")
    joined = joined.withColumn("candidate", candidate)
    good = F.coalesce(citations_hold(F.col("candidate"), F.col("n_sources")), F.lit(False))
    return joined.select("query_id", F.when(good, F.col("candidate")).otherwise(F.col("answer")).alias("answer"), F.when(good, "generated").otherwise("extractive").alias("kind"))
