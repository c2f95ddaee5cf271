"""Rules whose next step depends on earlier decisions: rate limits, replays and version guards; batch and stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def limit_hits(times: list[int], accepted: list[int], most: int, window: int) -> list[bool]:
    """Which of ``times`` (microseconds, ascending) pass: fewer than ``most`` accepted ones lie within ``window`` before it;
    exactly at the edge counts as within. ``accepted`` is carried on, in place."""
    out = []
    for t in times:
        while accepted and accepted[0] < t - window:
            accepted.pop(0)
        ok = len(accepted) < most
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def replay_hits(times: list[int], stored: int | None, ttl: int) -> tuple[list[bool], int | None]:
    """Which of ``times`` are answered from the store: at most ``ttl`` after the last computation; later ones compute anew."""
    out = []
    for t in times:
        replay = stored is not None and t - stored <= ttl
        if not replay:
            stored = t
        out.append(replay)
    return out, stored


def _micros(s: pd.Series) -> list[int]:
    return (s.astype("datetime64[us]").astype("int64")).tolist()


def _spells(rows: DataFrame, seconds: int) -> DataFrame:
    """rows (key, hit_id, ts) with ``spell``, a number that grows at each gap of over ``seconds`` within a key. State ends at
    such gaps, so spells are dealt to tasks of their own, sorted; a key with very many hits doesn't meet in one."""
    by = Window.partitionBy("key").orderBy("ts", "hit_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(by) > seconds * 1_000_000
    return rows.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("spell", F.sum("gap").over(by)).drop("gap").repartition("key", "spell").sortWithinPartitions("key", "spell", "ts", "hit_id")


def rate_limit(hits: DataFrame, key: str = "key", at: str = "ts", ident: str = "hit_id", most: int = 20, seconds: int = 60) -> DataFrame:
    """(key, hit_id, ts, allowed) of a table of hits; ties of time in order of id. A key's hits stream through in sorted
    chunks, so a key with very many hits needs no more memory than its window; hits after a pause longer than the window
    go to a task of their own."""
    rows = hits.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("hit_id"), F.col(at).alias("ts")).where("ts is not null")
    dealt = _spells(rows, seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, accepted = object(), []
        for b in batches:
            ok: list[bool] = []
            for (k, spell), part in b.groupby(["key", "spell"], sort=False, dropna=False):
                at = (k if isinstance(k, str) else None, spell)
                if at != now:
                    now, accepted = at, []
                ok += limit_hits(_micros(part["ts"]), accepted, most, seconds * 1_000_000)
            yield b.assign(allowed=ok).drop(columns="spell")

    return dealt.mapInPandas(run, "key string, hit_id long, ts timestamp, allowed boolean")


def ttl_replay(asks: DataFrame, key: str = "key", at: str = "ts", ident: str = "hit_id", seconds: int = 300) -> DataFrame:
    """(key, hit_id, ts, replayed) of a table of requests; see ``replay_hits``."""
    rows = asks.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("hit_id"), F.col(at).alias("ts")).where("ts is not null")
    dealt = _spells(rows, seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stored = object(), None
        for b in batches:
            out: list[bool] = []
            for (k, spell), part in b.groupby(["key", "spell"], sort=False, dropna=False):
                at = (k if isinstance(k, str) else None, spell)
                if at != now:
                    now, stored = at, None
                got, stored = replay_hits(_micros(part["ts"]), stored, seconds * 1_000_000)
                out += got
            yield b.assign(replayed=out).drop(columns="spell")

    return dealt.mapInPandas(run, "key string, hit_id long, ts timestamp, replayed boolean")


class RateLimiter(StatefulProcessor):
    """``limit_hits`` for transformWithStateInPandas; the accepted times (``most`` at most) are a key's state. With
    ``forget_ms``, keys idle for so long by the clock are forgotten: for live streams, not for replays of old ones."""

    def __init__(self, most: int = 20, seconds: int = 60, forget_ms: int | None = None):
        self.most, self.seconds, self.forget_ms = most, seconds, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("accepted", StructType([StructField("t", LongType())]), ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        accepted = [t[0] for t in self.times.get()] if self.times.exists() else []
        for b in rows:
            b = b.sort_values(["ts", "hit_id"])
            ok = limit_hits(_micros(b["ts"]), accepted, self.most, self.seconds * 1_000_000)
            yield b.assign(allowed=ok)[["key", "hit_id", "ts", "allowed"]]
        self.times.put([(t,) for t in accepted]) if accepted else self.times.clear()

    def close(self) -> None:
        pass


class Replayer(StatefulProcessor):
    """``replay_hits`` for transformWithStateInPandas."""

    def __init__(self, seconds: int = 300):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("stored", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.at.get()[0] if self.at.exists() else None
        for b in rows:
            b = b.sort_values(["ts", "hit_id"])
            out, stored = replay_hits(_micros(b["ts"]), stored, self.seconds * 1_000_000)
            yield b.assign(replayed=out)[["key", "hit_id", "ts", "replayed"]]
        if stored is not None:
            self.at.update((stored,))

    def close(self) -> None:
        pass


def stream_rate_limit(hits: DataFrame, most: int = 20, seconds: int = 60, forget_ms: int | None = None) -> DataFrame:
    """The streaming twin of ``rate_limit``, over (key, hit_id, ts). Needs the RocksDB state store."""
    return hits.groupBy("key").transformWithStateInPandas(RateLimiter(most, seconds, forget_ms), "key string, hit_id long, ts timestamp, allowed boolean", "Append", "ProcessingTime")


def stream_ttl_replay(asks: DataFrame, seconds: int = 300) -> DataFrame:
    return asks.groupBy("key").transformWithStateInPandas(Replayer(seconds), "key string, hit_id long, ts timestamp, replayed boolean", "Append", "ProcessingTime")


# --- keyed state of event streams -------------------------------------------------------------------

ARRIVED = "folioflow_arrived"


def _arriving(stream: DataFrame) -> DataFrame:
    """``stream`` with the time of its micro-batch, which is the same for all rows of a batch (also if it is repeated) and for no other. The session
    of ``stream`` gets the RocksDB state store, so that state needn't fit into memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withColumn(ARRIVED, F.current_timestamp())


def first_of_key(stream: DataFrame, key: Column, order: tuple[str, ...]) -> DataFrame:
    """The rows of ``stream`` whose key never came before, of those that come together the first by ``order``; for output mode update.

    A key's state is its first row and when its first and last rows came: while these are one batch, the key is new. A batch looks
    up its own keys alone, in built-in aggregates, so its work doesn't grow with what came before.
    """
    rows = _arriving(stream)
    row = F.struct(*(F.col(c) for c in stream.columns))
    held = rows.groupBy(key.alias("folioflow_key")).agg(F.min_by(row, F.struct(ARRIVED, *order)).alias("first"), F.min(ARRIVED).alias("since"), F.max(ARRIVED).alias("last"))
    return held.where("since = last").select("first.*")


def newer_versions(events: DataFrame, gone: Column) -> DataFrame:
    """The events that apply, for output mode update: deletions (``gone``), and of each page the newest version if it is newer than all before; ties
    within a batch by time, then event id. State is one row a page: its newest version, by the batch that had it first."""
    rows = _arriving(events)
    row = F.struct(*(F.col(c) for c in events.columns), ARRIVED)
    live = rows.where(~F.coalesce(gone, F.lit(False)) & F.col("cf_version").isNotNull())
    order = F.struct(F.col("cf_version"), (-F.unix_micros(ARRIVED)).alias("early"), F.col("event_timestamp"), F.col("event_id"))
    held = live.groupBy("page_id").agg(F.max_by(row, order).alias("newest"), F.max(ARRIVED).alias("last"))
    newest = held.where(F.col(f"newest.{ARRIVED}") == F.col("last")).select("newest.*").drop(ARRIVED)
    return events.where(gone).unionByName(newest)
