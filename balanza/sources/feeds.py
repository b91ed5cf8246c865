"""Data-provider feeds: JSON responses to rows of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from balanza.functions.dates import api_month
from balanza.functions.money import MONEY
from balanza.operators.risk import members


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one JSON object per line with taxpayer, endpoint and a VARIANT body."""
    raw = spark.read.schema("taxpayer string, endpoint string, body string").json(path)
    return raw.withColumn("body", F.try_parse_json("body"))


def monthly_feed(responses: DataFrame, endpoint: str) -> DataFrame:
    """Rows (taxpayer, month, type, mxn_amount, amount, transactions, payment_type, seq) of one feed.

    The endpoint filter reaches the scan; items without a month are left out.
    """
    rows = responses.filter(F.col("endpoint") == endpoint).select("taxpayer", F.posexplode(members(F.col("body"))).alias("seq", "item"))

    def get(*paths, kind="string"):
        return F.coalesce(*[F.try_variant_get("item", p, kind) for p in paths])

    month = F.try_to_date(F.concat(api_month(get("$.date")), F.lit("-01")), "yyyy-MM-dd")
    return rows.select(
        "taxpayer", month.alias("month"), F.coalesce(get("$.type"), F.lit("total")).alias("type"), get("$.mxnAmount", kind=MONEY).alias("mxn_amount"),
        get("$.amount", kind=MONEY).alias("amount"), F.coalesce(get("$.transactions", "$.count", "$.movements", kind="bigint"), F.lit(0)).alias("transactions"),
        get("$.groupName", "$.paymentType", "$.type").alias("payment_type"), "seq",
    ).filter(F.col("month").isNotNull())
