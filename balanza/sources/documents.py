"""Document files: scan with content hash, admission, and job results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from balanza.operators.intake import MAX_FILE_BYTES, admit, content_hash


def scan_documents(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files under a folder with name, size, SHA-256 and admission verdict; rejects stay as rows.

    The size test uses the listing, so the bytes of oversized files are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fits = files.filter(F.col("length") <= max_bytes)
    read = admit(fits, "content", max_bytes).withColumn("hash", content_hash(F.col("content")))
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "modificationTime", "length", F.lit("El archivo supera el límite permitido.").alias("intake_error")
    )
    both = read.unionByName(large, allowMissingColumns=True)
    return both.withColumn("file_name", F.substring_index("path", "/", -1))


def save_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Job results as a table partitioned by job; ``json`` for exchange, ``parquet`` for reuse."""
    df.write.mode(mode).partitionBy("job_id").format(fmt).save(path)


def load_results(spark: SparkSession, path: str, job_id=None, fmt: str = "parquet", schema=None) -> DataFrame:
    """Stored results; a job id prunes to that job's folder."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df if job_id is None else df.filter(F.col("job_id") == job_id)
