"""Counters over time: deltas, rates, totals and recent history, as batch windows and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 60


def rates(samples: DataFrame, key: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """``samples`` with delta and rate against the key's sample before; a counter that went back gives 0, the first null."""
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    before, since = F.lag(value).over(order), F.lag(ts).over(order)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1e6
    delta = F.when(before.isNull(), None).when(F.col(value) >= before, F.col(value) - before).otherwise(F.lit(0).cast("double"))
    return samples.withColumn("delta", delta).withColumn("rate", F.when(seconds > 0, F.col("delta") / seconds))


def running_total(samples: DataFrame, key: str, ts: str, delta: str, tie: str | None = None) -> DataFrame:
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumn("total", F.sum(F.coalesce(delta, F.lit(0.0))).over(order))


def recent(samples: DataFrame, key: str, ts: str, value: str, n: int = HISTORY, tie: str | None = None) -> DataFrame:
    """``samples`` with sum, mean, greatest and number of the last ``n`` values of the key."""
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else [])).rowsBetween(1 - n, Window.currentRow)
    return samples.withColumns({"recent_sum": F.sum(value).over(order), "recent_mean": F.avg(value).over(order), "recent_max": F.max(value).over(order), "recent_n": F.count(value).over(order)})


def stream_rates(samples: DataFrame, key: str, ts: str, value: str, n: int = HISTORY) -> DataFrame:
    """The stream's twin of ``rates`` and ``running_total``: state is the key's last sample, its total and its last ``n`` rates."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = {f.name: f.dataType.simpleString() for f in samples.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_ts, last, total, ring = state.get if state.exists else (None, None, 0.0, [])
        ring = list(ring)
        rows = pd.concat(list(parts)).sort_values(ts)
        out = []
        for at, now in zip(rows[ts], rows[value], strict=True):
            micros = int(pd.Timestamp(at).value // 1000)
            delta = rate = None
            if last is not None:
                delta = max(0.0, now - last) if now >= last else 0.0
                seconds = (micros - last_ts) / 1e6
                rate = delta / seconds if seconds > 0 else None
                total += delta
            if rate is not None:
                ring = [*ring, rate][-n:]
            last_ts, last = micros, float(now)
            out.append((k[0], at, delta, rate, total, sum(ring) / len(ring) if ring else None))
        state.update((last_ts, last, total, ring))
        yield pd.DataFrame(out, columns=[key, ts, "delta", "rate", "total", "recent_mean"])

    return samples.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {ts} {kind[ts]}, delta double, rate double, total double, recent_mean double",
        "last_ts long, last double, total double, ring array<double>", "append", GroupStateTimeout.NoTimeout,
    )


def windowed(events: DataFrame, ts: str, late: str, size: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates in windows of event time (sliding ones with ``slide``), for streams and tables; rows later than ``late`` are given up by a stream."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(window, *keys).agg(*aggregates)


def sessions(events: DataFrame, ts: str, late: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates in sessions: runs of a key's rows with less than ``gap`` between them, for streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)
