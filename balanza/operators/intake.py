"""Document intake: admission by magic bytes and size, archive audit, reuse by content hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Intake limits.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_ARCHIVE_FILES = 50
MAX_ARCHIVE_BYTES = 100 * 1024 * 1024
MAX_RATIO = 100


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content.cast("binary"), 256)


def admit(df: DataFrame, content: str = "content", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds ``file_type`` and ``intake_error`` (NULL for admitted files); rejects stay as rows."""
    head = F.substring(F.col(content), 1, 4)
    is_pdf, is_zip = head == F.lit(b"%PDF"), head == F.lit(bytes((0x50, 0x4B, 0x03, 0x04)))
    return df.withColumns({
        "file_type": F.when(is_pdf, "pdf").when(is_zip, "zip"),
        "intake_error": F.when(~F.coalesce(is_pdf | is_zip, F.lit(False)), F.lit("Tipo de archivo no soportado o falsificado."))
        .when(F.octet_length(F.col(content)) > max_bytes, F.lit("El archivo supera el límite permitido.")),
    })


def audit_archives(
    manifest: DataFrame, by="archive", max_files: int = MAX_ARCHIVE_FILES, max_bytes: int = MAX_ARCHIVE_BYTES,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Verdict per archive from its member list (archive, member, size, packed).

    Only PDF members count; folders and system leftovers do not. Checks in order: expansion ratio,
    number of files, expanded size, path escape.
    """
    name = F.lower("member")
    counted = name.endswith(".pdf") & ~F.col("member").startswith("__MACOSX")
    ratio = F.when(F.col("packed") > 0, F.col("size") / F.col("packed"))
    escapes = F.col("member").startswith("/") | F.col("member").rlike(r"(^|/)\.\.(/|$)")
    stats = manifest.filter(counted).groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("expanded"),
        F.max(ratio).alias("worst_ratio"), F.bool_or(escapes).alias("escapes"),
    )
    verdict = (
        F.when(F.col("worst_ratio") > max_ratio, F.lit("ratio"))
        .when(F.col("files") > max_files, F.lit("files"))
        .when(F.col("expanded") > max_bytes, F.lit("size"))
        .when(F.col("escapes"), F.lit("path"))
        .otherwise(F.lit("ok"))
    )
    return stats.withColumn("verdict", verdict)


def split_cached(new: DataFrame, prior: DataFrame, on=("job_id", "hash"), name: str = "file_name"):
    """(cached, fresh): earlier results under the new file name, and files still to process."""
    keys = list(on)
    known = prior.filter(F.coalesce("hash", F.lit("")) != "").dropDuplicates(keys)
    fields = [c for c in known.columns if c not in (*keys, name)]
    cached = new.select(*keys, name).join(known.select(*keys, *fields), keys)
    fresh = new.join(known.select(*keys), keys, "left_anti")
    return cached, fresh


def union_results(*frames: DataFrame) -> DataFrame:
    """Digital, scanned, failed and cached results as one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def error_rows(df: DataFrame, error: str = "error") -> DataFrame:
    """Failed documents as report rows: label, message, zero amounts."""
    text = F.lower(F.coalesce(F.col(error), F.lit("")))
    locked = text.contains("encrypted") | text.contains("password") | text.contains("contraseña")
    return df.filter(F.col(error).isNotNull()).withColumns({
        "bank": F.when(locked, F.lit("ERROR_CIFRADO")).otherwise(F.lit("ERROR_LECTURA")),
        "status": F.lit("fallido"),
        "message": F.when(locked, F.lit("Documento protegido con contraseña.")).otherwise(F.col(error)),
        "deposits": F.lit(0.0),
        "charges": F.lit(0.0),
    })
