"""The inventory and the sessions as Structured Streaming jobs, for logs that are still being written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_log(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_inventory(log: DataFrame, *, ts: str, kind: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, kind, n: counts per time window, final once the watermark has passed."""
    stamped = log.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counts = stamped.groupBy(F.window("_t", window), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")


def live_sessions(log: DataFrame, *, key: str, ts: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n: sessions by gap, given out once the watermark has passed their end."""
    stamped = log.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counts = stamped.groupBy(F.session_window("_t", gap), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there now, appends it to a Parquet table and reads that."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(path)


#: Keyed state with timers needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """The session's state store while a stream starts and runs; its own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


#: Neighbouring keys, as a power of two, whose waits share a state and a timer: a call into Python serves them all.
BLOCK_BITS = 8


class _Waits(StatefulProcessor):
    """Of a block of keys: each key's last kept trigger, triggers whose look-ahead is not over, and requests that may still answer one.

    Rows only go into the state, in whatever order they come. A timer at the end of the first open look-ahead decides: by then the
    watermark has passed it, so all rows up to there are known, and triggers are thinned and answered in order of time, key by key.
    """

    def __init__(self, gap: int, ahead: int):
        self.gap, self.ahead = gap, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waits", "kept binary, triggers binary, requests binary, timer long")

    def _load(self) -> tuple:
        """(key, time) of the last kept, open triggers and requests, and the timer."""
        held = self.state.get() if self.state.exists() else (b"", b"", b"", None)
        return *(np.frombuffer(bytes(x), np.int64).reshape(-1, 2) for x in held[:3]), held[3]

    def _keep(self, kept: np.ndarray, triggers: np.ndarray, requests: np.ndarray, timer) -> None:
        """Stores the state with one timer, a millisecond after the first open look-ahead ends."""
        due = -(-(int(triggers[:, 1].min()) + self.ahead) // 1000) + 1 if len(triggers) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((kept.tobytes(), triggers.tobytes(), requests.tobytes(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, triggers, requests, timer = self._load()
        came = [(batch[["key", "at"]].to_numpy(np.int64), batch["asks"].to_numpy(bool)) for batch in rows]
        triggers = _in_order([triggers, *(at[~asks] for at, asks in came)])
        requests = _in_order([requests, *(at[asks] for at, asks in came)])
        self._keep(kept, triggers, requests, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, triggers, requests, _ = self._load()
        past = timerValues.getCurrentWatermarkInMs() * 1000 - self.ahead  # all that is due, so that the next timer lies ahead
        due = triggers[triggers[:, 1] < past]
        last, out = dict(kept.tolist()), []
        keys, begins = np.unique(due[:, 0], return_index=True)
        asked = np.searchsorted(requests[:, 0], keys), np.searchsorted(requests[:, 0], keys, side="right")
        for k, a, b, c, d in zip(keys.tolist(), begins.tolist(), [*begins.tolist()[1:], len(due)], *(x.tolist() for x in asked)):
            times, answers = due[a:b, 1], requests[c:d, 1]
            at = int(np.searchsorted(times, last[k] + self.gap)) if k in last else 0
            while at < len(times):
                t = last[k] = int(times[at])
                first = int(np.searchsorted(answers, t))
                if first == len(answers) or answers[first] > t + self.ahead:
                    out.append((k, t))
                at = int(np.searchsorted(times, t + self.gap))
        self._keep(np.array(list(last.items()), np.int64).reshape(-1, 2), triggers[triggers[:, 1] >= past], requests[requests[:, 1] >= past], None)
        return iter([pd.DataFrame(out, columns=["key", "t"]).astype({"key": "int64", "t": "int64"})] if out else [])

    def close(self) -> None:
        pass


def _in_order(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct (key, time) rows of all parts, sorted."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows


def live_waits(log: DataFrame, *, key: str, ts: str, kind: str, trigger: str, request: str, min_gap_s: int, lookahead_s: int, late: str = "1 hour") -> DataFrame:
    """key, t (microseconds): triggers that nothing answered: rows of the trigger kind, thinned to one per min_gap_s, without a row of
    the request kind in [t, t + lookahead_s].

    A wait is given out once the watermark has passed its look-ahead, by an event-time timer. Rows may come in any order within
    `late`; later ones are dropped. Rows without a key or a time are passed over. State of a key: its last kept trigger and the
    rows of the last `late` + lookahead_s; 2^BLOCK_BITS neighbouring keys share a state, so that Python is not called for each. key is
    a whole number. The session needs ROCKS as its state store.
    """
    at = F.col(ts).cast("timestamp")
    named = F.when(F.col(kind) == trigger, "trigger").when(F.col(kind) == request, "request")
    rows = log.filter(F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("key"), at.alias("_t"), F.unix_micros(at).alias("at"), named.alias("kind"))
    # a row without a key or kind still moves the watermark on, as a filter that reads the event time stays above it
    stamped = rows.withWatermark("_t", late).filter("(key IS NOT NULL AND kind IS NOT NULL) OR _t IS NULL")
    dealt = stamped.select(F.shiftright("key", BLOCK_BITS).alias("block"), "key", "_t", "at", (F.col("kind") == "request").alias("asks"))
    return dealt.groupBy("block").transformWithStateInPandas(
        _Waits(int(min_gap_s * 1_000_000), int(lookahead_s * 1_000_000)), outputStructType="key long, t long", outputMode="Append", timeMode="EventTime"
    )
