"""Results of jobs as tables that may be written again: a run replaces what a job had, as a whole.

Every sheet is a table partitioned by job and run. A manifest names the run that counts for each job and sheet; it is
written last, so a run that breaks off leaves what was there before, and a repeated one doubles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest"


def _put(df: DataFrame, path: str, *by: str) -> None:
    """Partitions that ``df`` has are replaced, others stay. A movement's text stands on each of its sheets, which zstd takes up."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path, compression="zstd")


def write_run(sheets: dict[str, DataFrame], jobs: DataFrame, path: str, run: str) -> DataFrame:
    """Writes all sheets of the jobs (column job_id) of a run and then its manifest, which is returned.

    A sheet has a column job_id; its rows of other jobs are left out. A job without rows in a sheet has a manifest
    row with none, so that rows of earlier runs no longer show. Sheets that share a frame should get it
    written once (``session.cut``). ``run`` names the run; the same name writes over itself.
    """
    spark = jobs.sparkSession
    wanted = jobs.select("job_id").distinct()
    rows = None
    for name, df in sheets.items():
        _put(df.join(wanted, "job_id", "left_semi").withColumn("run", F.lit(run)), f"{path}/sheet={name}", "job_id", "run")
        kept = spark.read.schema(_stored(df)).parquet(f"{path}/sheet={name}").filter(F.col("run") == run).groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))
        told = wanted.join(kept, "job_id", "left").select("job_id", F.lit(name).alias("sheet"), F.lit(run).alias("run"), F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))
        rows = told if rows is None else rows.unionByName(told)
    _put(rows.coalesce(1), f"{path}/{MANIFEST}", "job_id", "sheet")
    return rows


def _stored(df: DataFrame) -> StructType:
    """The columns as they stand in the folder: partition columns last."""
    fields = [f for f in df.schema.fields if f.name not in ("job_id", "run")]
    out = StructType(fields).add("job_id", df.schema["job_id"].dataType)
    return out.add("run", "string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_sheet(spark: SparkSession, path: str, name: str, schema: StructType, job_id=None) -> DataFrame:
    """The rows that count; with ``job_id`` only that job's folders are listed. ``schema`` is the sheet's own."""
    empty = spark.createDataFrame([], schema)
    rows = spark.read.schema(_stored(empty)).parquet(f"{path}/sheet={name}")
    valid = read_manifest(spark, path).filter((F.col("sheet") == name) & (F.col("rows") > 0)).select("job_id", "run")
    if job_id is not None:
        rows, valid = rows.filter(F.col("job_id") == job_id), valid.filter(F.col("job_id") == job_id)
    return rows.join(valid, ["job_id", "run"], "left_semi").select(*schema.fieldNames())
