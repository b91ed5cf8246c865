"""Live running balance per document, with a review flag."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def stream_balance(mov: DataFrame, opening_cents: int = 0, idle: str = "90 days", late: str = "30 days") -> DataFrame:
    """Expected balance after each movement, in cents, and whether the read balance is missing or
    more than one cent off.

    The state is a number and a time per document, and leaves when the watermark is ``idle`` past its last
    movement. The movements of a document in one micro-batch are put in order of ``ts`` and ``mov_id``; size
    the trigger so that they fit in a task. One that comes in a later batch with an earlier time is added where
    it comes and flagged for review; Spark drops those more than ``late`` behind the newest.
    """

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        carried, last = state.get if state.exists else (opening_cents, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "mov_id"])
        expected = carried + rows["change_cents"].cumsum()
        off = rows["balance_cents"].isna() | ((rows["balance_cents"] - expected).abs() > 1)
        at = rows["ts"].astype("int64") // unit(rows["ts"])
        if last is not None:
            off = off | (at < last)
        last = max(int(at.iloc[-1]), last or 0)
        state.update((int(expected.iloc[-1]), last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1 + keep)
        yield pd.DataFrame({"doc_id": key[0], "mov_id": rows["mov_id"], "expected_cents": expected.astype("int64"), "review": off})

    def unit(column: pd.Series) -> int:
        """Steps of the column's time unit in a microsecond."""
        return 1000 if "[ns" in str(column.dtype) else 1

    keep = int(pd.Timedelta(idle).total_seconds() * 1000)
    cents = mov.select(
        "doc_id", "mov_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("change") * 100).cast("bigint").alias("change_cents"),
        F.round(F.col("balance") * 100).cast("double").alias("balance_cents"),
    )
    schema = f"doc_id {mov.schema['doc_id'].dataType.simpleString()}, mov_id {mov.schema['mov_id'].dataType.simpleString()}, expected_cents bigint, review boolean"
    timed = cents.withWatermark("ts", late)
    return timed.groupBy("doc_id").applyInPandasWithState(walk, schema, "cents bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
