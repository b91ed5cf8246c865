"""Running a stream over what is there now, into a table of the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from balanza.session import checkpoint_root


def replay(spark: SparkSession, stream: DataFrame, name: str, numbered: bool = False) -> DataFrame:
    """Processes all available input once, in append mode, and returns what was written.

    Windows and sessions that the watermark has not closed by then stay in the state, for the next run. With
    ``numbered`` each row has the number of its micro-batch in ``batch``; a batch that is run again replaces its own rows.

    Output and progress live in the shared folder, so lost executors do not lose them.
    """
    root = f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    if not numbered:
        query = writer.format("parquet").option("path", f"{root}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    query = writer.foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")
