"""Event lines: classes, triggers, throttling and the latest report of an image."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: How a line begins and what it is.
PREFIXES = (
    ("Workspaces changed", "workspaces_changed"),
    ("Windows changed", "windows_changed"),
    ("Window opened or changed", "window_opened_or_changed"),
    ("Window closed", "window_closed"),
    ("Window focused", "focus_changed"),
    ("Focus changed", "focus_changed"),
    ("Keyboard layouts changed", "keyboard_layouts_changed"),
    ("Overview toggled", "overview_toggled"),
)
TRIGGERS = ("windows_changed", "window_opened_or_changed", "window_closed", "focus_changed")


def classify(line: Column) -> Column:
    s, out = F.trim(line), F.lit("other")
    for prefix, kind in reversed(PREFIXES):
        out = F.when(s.startswith(prefix), kind).otherwise(out)
    return out


def triggers(kind: Column) -> Column:
    return kind.isin(*TRIGGERS)


def throttled(events: list[tuple], width: float) -> list[tuple]:
    """(ts, kind, is_trigger) in order -> one event a window: a window opens at its first
    event and lasts `width`; it gives its last trigger, else its first event."""
    out, start, pick, sure = [], None, None, False
    for e in events:
        if start is None or e[0] - start >= width:
            if pick is not None:
                out.append(pick)
            start, pick, sure = e[0], e, bool(e[2])
        elif e[2]:
            pick, sure = e, True
    return out + [pick] * (pick is not None)


def throttle(df: DataFrame, key: str, width: float) -> DataFrame:
    """Batch form over key, ts (seconds, double), kind, is_trigger, tie. A window depends on
    where the last one opened, so a key is folded in order; keys are the parallel unit, and
    only the open window is held, however many events a key has."""
    kind = dict(df.dtypes)[key]
    names = [key, "ts", "kind", "tie"]

    def run(batches):
        now = start = pick = None  # the key, when its window opened, the event it gives so far
        for batch in batches:
            out = []
            for k, t, name, hit, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start is None or k != now or t - start >= width:
                    if start is not None:
                        out.append(pick)
                    now, start, pick = k, t, (k, t, name, tie)
                elif hit:
                    pick = (k, t, name, tie)
            yield made(out, batch.schema)
            last = batch.schema
        if start is not None:
            yield made([pick], last)

    def made(rows, schema):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(cols, names, strict=True)], names=names)

    d = df.select(key, F.col("ts").cast("double").alias("ts"), "kind", F.coalesce("is_trigger", F.lit(False)).alias("is_trigger"), F.col("tie").cast("long").alias("tie"))
    return d.repartition(key).sortWithinPartitions(key, "ts", "tie").mapInArrow(run, f"{key} {kind}, ts double, kind string, tie long")


def throttle_stream(stream: DataFrame, by: str, width: float) -> DataFrame:
    """Streaming form over a key (by), ts (seconds, double), kind, is_trigger: the open window is the
    key's state; a timer closes it when no event comes. Needs the RocksDB state store."""
    schema = f"{by} {dict(stream.dtypes)[by]}, ts double, kind string"

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "start double, ts double, kind string, sure boolean")

        def given(self, key, events):
            return pd.DataFrame([(key[0], e[1], e[2]) for e in events], columns=[by, "ts", "kind"])

        def handleInputRows(self, key, rows, timerValues):
            done, held = [], self.open.get() if self.open.exists() else None
            frames = pd.concat(list(rows)).sort_values("ts", kind="stable")
            for t, name, hit in zip(frames.ts, frames.kind, frames.is_trigger, strict=True):
                if held is None or t - held[0] >= width:
                    done += [held] if held is not None else []
                    held = (float(t), float(t), name, bool(hit))
                elif hit:
                    held = (held[0], float(t), name, True)
            self.open.update(held)
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(width * 1000)))
            yield self.given(key, done)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = [self.open.get()] if self.open.exists() else []
            self.open.clear()
            yield self.given(key, held)

        def close(self) -> None:
            pass

    return stream.groupBy(by).transformWithStateInPandas(Windows(), schema, "Append", "processingTime")


def latest(df: DataFrame, key: str, order: list[str], ok: str | None = None) -> DataFrame:
    """The last row of each key; rows that failed leave what was there."""
    d = df.where(F.col(ok)) if ok else df
    rest = [c for c in df.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def refresh(cache: DataFrame, news: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cache after news, ok and failed counts). news: key, value (null if it failed)."""
    d = cache.join(news.select(key, F.col("value").alias("_new"), F.lit(True).alias("_hit")), key, "full")
    counts = news.agg(F.count("value").alias("ok"), F.count_if(F.col("value").isNull()).alias("failed"))
    return d.select(key, F.coalesce("_new", "value").alias("value")).where("value IS NOT NULL"), counts


def cached(requests: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(requests with their values, cache after them). What the cache (key, value) has isn't computed
    again: compute(requests without a hit) -> key, value."""
    hits = requests.join(cache, key)
    new = compute(requests.join(cache, key, "left_anti").select(key).distinct())
    return hits.unionByName(requests.join(new, key)), cache.unionByName(new.select(key, "value"))


def watch(stream: DataFrame, act, checkpoint: str, max_events: int | None = None):
    """Runs act(batch, number) on batches of triggering events; at most max_events if given."""
    seen = {"n": 0}

    def batch(df: DataFrame, number: int) -> None:
        left = None if max_events is None else max_events - seen["n"]
        if left is not None and left <= 0:
            return
        part = df if left is None else df.limit(left)
        seen["n"] += part.count()
        act(part, number)

    hits = stream.withColumn("kind", classify(F.col("line"))).where(triggers(F.col("kind")))
    return hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with the number of its key's rows so far."""
    return df.withColumn("seen", F.row_number().over(W.partitionBy(key).orderBy(order)))
