"""Keeping a graph fresh: rate-limited checks, delayed rebuilds and streaming merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.schema import CHECK_TTL_SECONDS


def _accept(times, last: pd.Timestamp | None, seconds: float) -> tuple[list[bool], pd.Timestamp | None]:
    gap, out = pd.Timedelta(seconds=seconds), []
    for t in times:
        ok = last is None or t >= last + gap
        last = t if ok else last
        out.append(ok)
    return out, last


def accepted(checks: DataFrame, key: str, time: str, tie: str, seconds: float = CHECK_TTL_SECONDS) -> DataFrame:
    """``checks`` with ``accepted``: at least ``seconds`` after the key's last accepted one.

    Which checks count depends on all before them, so each key is gone through in order; one
    time is kept, whatever the number of a key's checks.
    """
    names = checks.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), None
        for part in parts:
            ok = []
            for k, t in zip(part[key].where(part[key].notna(), None), part[time]):
                if k != now:
                    now, last = k, None
                (one,), last = _accept([t], last, seconds)
                ok.append(one)
            yield part[names].assign(accepted=ok)

    fields = T.StructType([*checks.schema.fields, T.StructField("accepted", T.BooleanType())])
    return checks.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, fields)


def rebuilds(triggers: DataFrame, key: str, time: str, tie: str, seconds: float) -> DataFrame:
    """``(key, started, n)``: rebuilds that begin a fixed delay after their first trigger.

    Later triggers until then, ``n`` with the first, are swallowed; they do not put it off.
    """
    # Rows of a key are in order already, so the window adds no exchange.
    start = F.last(F.when(F.col("accepted"), F.col(time)), ignorenulls=True).over(Window.partitionBy(key).orderBy(time, tie))
    return accepted(triggers, key, time, tie, seconds).withColumn("started", start).groupBy(key, "started").agg(F.count("*").alias("n"))


def accepted_stream(checks: DataFrame, key: str, time: str, seconds: float = CHECK_TTL_SECONDS) -> DataFrame:
    """The streaming twin of ``accepted``: ``(key, time)`` of accepted checks; the state is one time for each key."""

    def one(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values(time, kind="stable")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        ok, last = _accept(part[time], last, seconds)
        if last is not None:
            state.update((int(last.value // 1000),))
        yield part.loc[ok, [key, time]]

    kind = dict(checks.dtypes)
    return checks.groupBy(key).applyInPandasWithState(one, f"{key} {kind[key]}, {time} {kind[time]}", "last long", "append", GroupStateTimeout.NoTimeout)


def sessions(triggers: DataFrame, time: str, gap: str, watermark: str, *keys: str) -> DataFrame:
    """Triggers without a pause of ``gap`` as one rebuild; late ones are dropped after ``watermark``."""
    windows = triggers.withWatermark(time, watermark).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each batch of changes to ``rebuild``; a failed batch is tried again.

    ``rebuild`` writes a new snapshot version, so readers keep the last whole one meanwhile.
    """
    return changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changed(fingerprints: DataFrame, key: str, order: str, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint differs from the one before it."""
    was = F.lag(fingerprint).over(Window.partitionBy(key).orderBy(order))
    return fingerprints.withColumn("changed", F.coalesce(F.col(fingerprint) != was, F.lit(True))).where("changed").drop("changed")
