"""Products sold or bought: mix, top lists, monthly timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.operators.network import with_share
from balanza.operators.ordered import top_k


def product_mix(rows: DataFrame) -> DataFrame:
    """Per taxpayer and product: name and code with fallbacks, total, share, number of movements."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("detail"), F.lit("")), F.lit("Sin descripción"))
    code = F.coalesce(F.nullif(F.col("product_code"), F.lit("")), F.nullif(F.col("code"), F.lit("")), F.lit("N/A"))
    mix = rows.groupBy("taxpayer", code.alias("code"), name.alias("name")).agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("transactions")
    )
    return with_share(mix)


def top_products(mix: DataFrame, k: int = 50) -> DataFrame:
    return top_k(mix, ["taxpayer"], [F.col("total").desc(), F.col("code"), F.col("name")], k)


def product_timeline(rows: DataFrame, k: int = 10) -> DataFrame:
    """Monthly amounts of each taxpayer's ``k`` largest products, one row per product and month."""
    months = rows.groupBy("taxpayer", "code", "name", F.trunc("posted", "month").alias("month")).agg(F.sum("amount").alias("month_total"))
    mix = months.groupBy("taxpayer", "code", "name").agg(F.sum("month_total").alias("total"))
    return months.join(top_products(mix, k), ["taxpayer", "code", "name"])
