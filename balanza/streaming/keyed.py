"""Streams with state per key that timers take away again: uploads within an hour, balances that late rows correct.

Both need the RocksDB state store (``keyed_state`` sets it on a session that may be changed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MILLIS = 1000


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FirstSights(StatefulProcessor):
    """Admits a file of a key unless one was admitted within the lifetime before it."""

    def __init__(self, lifetime_us: int):
        self.lifetime = lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([frame["at"].to_numpy() for frame in rows]))
        last = self.seen.get()[0] if self.seen.exists() else None
        admitted = []
        for at in times.tolist():
            if last is None or at > last + self.lifetime:
                admitted.append(at)
                last = at
        self.seen.update((last,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last + self.lifetime) // MILLIS + 1)
        if admitted:
            yield pd.DataFrame({"job_id": [key[0]] * len(admitted), "hash": [key[1]] * len(admitted), "at": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_first_sights(files: DataFrame, lifetime: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(job_id, hash, ts) of files that no admitted file with the same job and hash precedes by ``lifetime`` or less.

    However the files are cut into micro-batches, the result is the same while they come in order of ``ts`` for their key;
    one that comes after a later one is judged by that. A key's state is one time, and a timer takes it away when the
    watermark, ``late`` behind the newest file, is past its lifetime.
    """
    span = int(pd.Timedelta(lifetime).total_seconds() * 1_000_000)
    timed = files.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("job_id", "hash", "ts", F.unix_micros("ts").alias("at"))
    schema = f"job_id {files.schema['job_id'].dataType.simpleString()}, hash string, at bigint"
    found = timed.groupBy("job_id", "hash").transformWithStateInPandas(FirstSights(span), schema, "Append", "EventTime")
    return found.select("job_id", "hash", F.timestamp_micros("at").alias("ts"))


class CorrectedBalance(StatefulProcessor):
    """Running balance of one document. Movements that the watermark has not passed stay in the state, in order, so
    that a late one is put in its place and the balances after it are given out anew."""

    def __init__(self, opening_cents: int):
        self.opening = opening_cents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "cents bigint")
        self.open = handle.getListState("open", "at bigint, mov_id string, change bigint, balance double, expected bigint")

    def _state(self) -> tuple[int, pd.DataFrame]:
        base = self.base.get()[0] if self.base.exists() else self.opening
        rows = list(self.open.get()) if self.open.exists() else []
        return base, pd.DataFrame(rows, columns=["at", "mov_id", "change", "balance", "expected"]).astype({"balance": "float64", "expected": "float64"})

    def _keep(self, base: int, rows: pd.DataFrame, watermark_ms: int) -> None:
        """Movements up to the watermark become the base; the others stay, and a timer comes back for them."""
        done = rows["at"] <= watermark_ms * MILLIS
        base += int(rows.loc[done, "change"].sum())
        rest = rows[~done]
        self.base.update((base,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(rest):
            self.open.put([
                (int(a), m, int(c), None if np.isnan(b) else float(b), int(e))
                for a, m, c, b, e in zip(rest["at"], rest["mov_id"], rest["change"], rest["balance"], rest["expected"], strict=True)
            ])
            self.handle.registerTimer(int(rest["at"].max()) // MILLIS + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base, known = self._state()
        fresh = pd.concat([frame[["at", "mov_id", "change", "balance"]] for frame in rows]).assign(expected=np.nan)
        every = pd.concat([known, fresh]) if len(known) else fresh
        every = every.sort_values(["at", "mov_id"], kind="stable").reset_index(drop=True)
        expected = base + every["change"].cumsum()
        moved = ~(every["expected"] == expected)
        out = every[moved]
        now = expected[moved]
        off = out["balance"].isna() | ((out["balance"] - now).abs() > 1)
        yield pd.DataFrame({"doc_id": key[0], "mov_id": out["mov_id"], "expected_cents": now.astype("int64"), "review": off, "corrected": out["expected"].notna()})
        self._keep(base, every.assign(expected=expected), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base, known = self._state()
        self._keep(base, known, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def stream_balance_corrected(mov: DataFrame, opening_cents: int = 0, late: str = "30 days") -> DataFrame:
    """(doc_id, mov_id, expected_cents, review, corrected): the balance after each movement, and again when a late one
    before it changes it (``corrected``). The last row of a movement is its balance once the stream has gone on.

    ``mov`` has doc_id, mov_id, ts, change and balance. Movements of the last ``late`` are the state of a document;
    older ones are one number. Later rows are dropped by the watermark.
    """
    cents = mov.select(
        "doc_id", F.col("mov_id").cast("string").alias("mov_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.round(F.col("change") * 100).cast("bigint").alias("change"), F.round(F.col("balance") * 100).cast("double").alias("balance"),
    )
    schema = f"doc_id {mov.schema['doc_id'].dataType.simpleString()}, mov_id string, expected_cents bigint, review boolean, corrected boolean"
    return cents.withWatermark("ts", late).groupBy("doc_id").transformWithStateInPandas(CorrectedBalance(opening_cents), schema, "Append", "EventTime")
