"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from balanza.queries.registry import query
from balanza.rules.tags import TagRule
from balanza.session import checkpoint_root
from balanza.streaming import balance, intake, keyed, run, sessions, totals

RULES = (
    TagRule("TPV", 80, ("purchase",)),
    TagRule("FINANCIAMIENTO", 50, ("signup", "error")),
    TagRule("TRASPASO", 40, ("view",)),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with ``ts`` as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_intake", """
WITH e AS (SELECT user_id % 10 AS job_id, sha256(concat(event_type, CAST(user_id AS VARCHAR))) AS hash FROM events)
SELECT DISTINCT job_id, hash FROM e""")
def stream_intake(spark, d):
    """Within one micro-batch the first sight of a key is kept, so the keys equal the distinct ones
    when the whole input is one batch."""
    files = events(spark, d).select(
        "ts", (F.col("user_id") % 10).alias("job_id"), F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("hash")
    )
    return run.replay(spark, intake.stream_intake(files, "40 days"), "intake").select("job_id", "hash")


_CLASS = """c AS (SELECT *, user_id % 2 = 0 AS is_in FROM events),
k AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'TPV' WHEN event_type IN ('signup', 'error') THEN CASE WHEN is_in THEN 'FINANCIAMIENTO' ELSE 'PAGO_FINANCIAMIENTO' END
 WHEN event_type = 'view' THEN CASE WHEN is_in THEN 'TRASPASO_ABONO' ELSE 'TRASPASO_CARGO' END ELSE 'GENERAL' END AS category FROM c)"""


def _movements(spark, d):
    return events(spark, d).select(
        "ts", (F.col("user_id") % 20).alias("doc_id"), F.col("event_type").alias("description"),
        F.when(F.col("user_id") % 2 == 0, "abono").otherwise("cargo").alias("kind"), F.col("value").cast("decimal(18,2)").alias("amount"),
    )


# A stream gives out what its watermark has closed: windows that ended an hour before the newest event.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_totals", "WITH " + _CLASS + f"""
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, user_id % 20 AS doc_id, category, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM k
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""")
def stream_totals(spark, d):
    out = run.replay(spark, totals.stream_totals(_movements(spark, d), RULES), "totals")
    return out.select(F.to_date("start").alias("day"), "doc_id", "category", "total", "n")


@query("stream_totals_sliding", "WITH " + _CLASS + f"""
, w AS (SELECT *, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY * b AS s FROM k, (SELECT unnest([0, 1]) AS b))
SELECT CAST(s AS VARCHAR) AS start, CAST(s + INTERVAL 2 DAY AS VARCHAR) AS end, user_id % 20 AS doc_id, category, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM w
WHERE s + INTERVAL 2 DAY <= {_CLOSED} GROUP BY ALL""")
def stream_totals_sliding(spark, d):
    out = run.replay(spark, totals.stream_totals(_movements(spark, d), RULES, "2 days", "1 day"), "sliding")
    return out.select(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "doc_id", "category", "total", "n")


@query("stream_balance", """
WITH m AS (SELECT user_id % 20 AS doc_id, printf('%012d', event_id) AS mov_id, ts, CAST(round(CAST(value AS DECIMAL(18,2)) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 100) AS BIGINT) AS cents FROM events),
b AS (SELECT *, sum(cents) OVER (PARTITION BY doc_id ORDER BY ts, mov_id ROWS UNBOUNDED PRECEDING)::BIGINT AS expected_cents FROM m)
SELECT doc_id, mov_id, expected_cents, CAST(mov_id AS BIGINT) % 5 = 0 OR abs(CAST(CASE WHEN CAST(mov_id AS BIGINT) % 7 = 0 THEN 0 ELSE 100000 END AS BIGINT) - expected_cents) > 1 AS review FROM b""")
def stream_balance(spark, d):
    k = F.col("event_id")
    sign = F.when(k % 2 == 0, 1).otherwise(-1)
    mov = events(spark, d).select(
        (F.col("user_id") % 20).alias("doc_id"), F.format_string("%012d", k).alias("mov_id"), "ts", (F.col("value").cast("decimal(18,2)") * sign).alias("change"),
        F.when(k % 5 != 0, F.when(k % 7 == 0, F.lit(0)).otherwise(F.lit(1000))).cast("decimal(18,2)").alias("balance"),
    )
    return run.replay(spark, balance.stream_balance(mov), "balance")


@query("stream_sessions", """
WITH e AS (SELECT user_id % 10 AS job_id, ts::TIMESTAMP AS ts, event_id % 5 AS back FROM events),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT job_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS files, bool_or(back = 1) AS m1, bool_or(back = 2) AS m2, bool_or(back = 3) AS m3, bool_or(back = 4) AS m4 FROM s GROUP BY job_id, k)
SELECT job_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS end, files, (m1 AND m2 AND m3) OR (m2 AND m3 AND m4) AS complete FROM c WHERE e <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, d):
    files = events(spark, d).select(
        "ts", (F.col("user_id") % 10).alias("job_id"),
        F.date_format(F.add_months(F.lit("2001-08-01").cast("date"), -(F.col("event_id") % 5).cast("int")), "MM-yyyy").alias("period"),
    )
    out = run.replay(spark, sessions.stream_sessions(files, "2001-08-15"), "sessions")
    return out.select("job_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "files", "complete")


def in_batches(spark: SparkSession, sf_dir: str, batch: Column, count: int, *cols: Column) -> DataFrame:
    """The events as a stream of ``count`` micro-batches: one file for each number of ``batch``, read one at a time."""
    root = f"{checkpoint_root(spark)}/streams/split-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*cols, batch.alias("_batch"))
    for i in range(count):  # in this order, as a file stream goes by time of writing
        rows.filter(F.col("_batch") == i).drop("_batch").coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(rows.drop("_batch").schema).option("maxFilesPerTrigger", 1).parquet(root)


# Files in order of time, in three micro-batches; a file counts again an hour after it was last admitted.
@query("stream_first_sights", """
WITH RECURSIVE e AS (SELECT user_id % 10 AS job_id, event_type AS hash, ts::TIMESTAMP AS ts FROM events),
n AS (SELECT job_id, hash, ts, row_number() OVER (PARTITION BY job_id, hash ORDER BY ts) AS i FROM (SELECT DISTINCT * FROM e)),
w(job_id, hash, i, ts, last, fresh) AS (SELECT job_id, hash, i, ts, ts, true FROM n WHERE i = 1
 UNION ALL SELECT n.job_id, n.hash, n.i, n.ts, CASE WHEN n.ts > w.last + INTERVAL 1 HOUR THEN n.ts ELSE w.last END, n.ts > w.last + INTERVAL 1 HOUR FROM w JOIN n ON n.job_id = w.job_id AND n.hash = w.hash AND n.i = w.i + 1)
SELECT job_id, hash, CAST(ts AS VARCHAR) AS ts FROM w WHERE fresh""")
def stream_first_sights(spark, d):
    keyed.keyed_state(spark)
    span = spark.read.parquet(f"{d}/events.parquet").agg(F.min(F.col("ts").cast("timestamp").cast("double")).alias("a"), F.max(F.col("ts").cast("timestamp").cast("double")).alias("b")).first()
    third = F.least(F.lit(2), F.floor((F.col("ts").cast("double") - F.lit(span.a)) / F.lit(max(span.b - span.a, 1.0) / 3))).cast("int")
    files = in_batches(spark, d, third, 3, F.col("ts"), (F.col("user_id") % 10).alias("job_id"), F.col("event_type").alias("hash"))
    out = run.replay(spark, keyed.stream_first_sights(files), "sights")
    return out.select("job_id", "hash", F.col("ts").cast("string").alias("ts"))


# Every third event comes a batch or two late; the last word on each movement is the balance in order of time.
@query("stream_balance_corrected", """
WITH m AS (SELECT user_id % 20 AS doc_id, printf('%012d', event_id) AS mov_id, ts, CAST(round(CAST(value AS DECIMAL(18,2)) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 100) AS BIGINT) AS cents FROM events),
b AS (SELECT *, sum(cents) OVER (PARTITION BY doc_id ORDER BY ts, mov_id ROWS UNBOUNDED PRECEDING)::BIGINT AS expected_cents FROM m)
SELECT doc_id, mov_id, expected_cents, CAST(mov_id AS BIGINT) % 5 = 0 OR abs(CAST(CASE WHEN CAST(mov_id AS BIGINT) % 7 = 0 THEN 0 ELSE 100000 END AS BIGINT) - expected_cents) > 1 AS review FROM b""")
def stream_balance_corrected(spark, d):
    keyed.keyed_state(spark)
    k = F.col("event_id")
    sign = F.when(k % 2 == 0, 1).otherwise(-1)
    mov = in_batches(
        spark, d, (k % 3).cast("int"), 3, (F.col("user_id") % 20).alias("doc_id"), F.format_string("%012d", k).alias("mov_id"), F.col("ts"), (F.col("value").cast("decimal(18,2)") * sign).alias("change"),
        F.when(k % 5 != 0, F.when(k % 7 == 0, F.lit(0)).otherwise(F.lit(1000))).cast("decimal(18,2)").alias("balance"),
    )
    out = run.replay(spark, keyed.stream_balance_corrected(mov, late="400 days"), "corrected", numbered=True)
    last = out.groupBy("doc_id", "mov_id").agg(F.max_by(F.struct("expected_cents", "review"), "batch").alias("l"))
    return last.select("doc_id", "mov_id", "l.expected_cents", "l.review")
