"""Spark session helpers.

On a cluster the session comes from outside and is used as it is; ``local_session`` exists for
tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning the operators rely on; all are safe to set on a shared session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: str | int = "*", app: str = "balanza", driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", driver_memory))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master, where driver and tasks are one machine, may do without: it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_root()
    return root


@lru_cache(maxsize=1)
def _own_root() -> str:
    """One folder for this process; the setting itself can't be changed in a running session."""
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The frame written to the shared checkpoint folder and read back.

    Long pipelines read some frames several times; from here on they read the table instead of the
    whole plan before it, and a lost executor costs no recomputation.
    """
    path = f"{checkpoint_root(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
