"""The engine's functions under names for SQL: tokenizers and splitters as functions, chunkers as table functions.

``register(spark)`` adds them to a session:

    SELECT doc_id, tok_lab(text) FROM documents;
    SELECT doc_id, c.* FROM documents, LATERAL chunk_lab(text) c;

A function's name in SQL can't stand for a column expression, so these are Arrow functions with the same rules; DataFrames
should use the column functions of ``text``, which stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellane.functions.text import ENGLISH_STOP, HAN_STOP
from tessellane.operators.chunking import CHUNKERS

_STOP = frozenset(ENGLISH_STOP + HAN_STOP)
_CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
_CJK_KIT = "぀-ヿ一-鿿가-힯"


def _with_pairs(run: str) -> list[str]:
    return [*run, *map("".join, zip(run, run[1:], strict=False))]


def tok_pro(t: str) -> list[str]:
    single = [w.lower() for w in re.findall("[a-zA-Z0-9]+|[一-鿿]", t)]
    return single + [a + b for a, b in zip(single, single[1:], strict=False) if min(a, b) >= "一"]


def tok_lab(t: str) -> list[str]:
    runs = re.findall("([a-z0-9_]+)|([㐀-鿿]+)", t.lower())
    return [w for word, han in runs for w in ([word] if word else _with_pairs(han)) if w not in _STOP]


def tok_easy(t: str) -> list[str]:
    return re.findall("[a-z0-9]+", t.lower()) + [w for run in re.findall(f"[{_CJK}]+", t) for w in _with_pairs(run)]


def tok_kit(t: str) -> list[str]:
    return re.findall(f"[a-z0-9]+|[{_CJK_KIT}]", t.strip().lower())


def split_sentences(t: str) -> list[str]:
    return [s for s in map(str.strip, re.split(r"(?<=[。！？!?；;])\s*", t)) if s]


def hard_split(t: str) -> list[str]:
    return [t[i : i + 500] for i in range(0, len(t), 500)]


FUNCTIONS: dict[str, tuple[Callable, str]] = {f.__name__: (f, "array<string>") for f in (tok_pro, tok_lab, tok_easy, tok_kit, split_sentences, hard_split)}
FUNCTIONS["estimate_tokens"] = (lambda t: len(tok_pro(t)), "bigint")


def _scalar(f: Callable, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def _table_function(cut: Callable):
    class Chunks:
        def eval(self, t: str):
            for ordinal, (chunk, start, end, heading) in enumerate(cut(t or ""), 1):
                yield ordinal, start, end, heading, chunk

    return F.udtf(Chunks, returnType="ordinal int, start int, end int, heading string, chunk string")


def register(spark: SparkSession) -> list[str]:
    """Register everything with ``spark``; return the names. Null texts give null, or no rows."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, _scalar(f, kind))
    for name, cut in CHUNKERS.items():
        spark.udtf.register(f"chunk_{name}", _table_function(cut))
    return [*FUNCTIONS, *(f"chunk_{name}" for name in CHUNKERS)]
