"""Domain frames read from the driver's star-schema tables, for the registered queries and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; how it is split is the session's setting (spark.sql.files.maxPartitionBytes)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as bank movements; one supplier is one statement, ten statements families are jobs."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    kind = (
        F.when(F.col("l_linestatus") == "O", F.lit("abono"))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 7), F.lit("importe"))
        .otherwise(F.lit("cargo"))
    )
    return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("doc_id"),
        (F.col("l_suppkey") % 10).alias("job_id"),
        F.concat_ws("-", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int")).alias("mov_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("posted"),
        kind.alias("kind"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.concat_ws(" ", F.col("p_name"), F.lower("p_type"), F.col("l_orderkey").cast("string")).alias("description"),
    )


def covers(mov: DataFrame) -> DataFrame:
    """Statement covers whose declared sums miss some movements on purpose."""
    zero = F.lit(0).cast("decimal(18,2)")
    return mov.groupBy("doc_id", "job_id").agg(
        F.min("posted").alias("period_start"),
        F.max("posted").alias("period_end"),
        F.sum(F.when((F.col("kind") == "abono") & (F.col("order_key") % 50 != 0), F.col("amount")).otherwise(zero)).alias("deposits"),
        F.sum(F.when((F.col("kind") == "cargo") & (F.col("order_key") % 40 != 0), F.col("amount")).otherwise(zero)).alias("charges"),
        F.sum(F.when((F.col("kind") == "cargo") & (F.col("line_no") == 1), F.col("amount")).otherwise(zero)).alias("fees"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("paid"))
        .when(F.col("o_orderstatus") == "O", F.lit("open"))
        .otherwise(F.lit("cancelled"))
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("taxpayer"),
        F.col("o_custkey").alias("counterparty"),
        F.col("c_name").alias("name"),
        F.col("o_orderkey").alias("invoice_id"),
        F.col("o_orderdate").cast("date").alias("issued"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        status.alias("status"),
        F.when(F.col("o_orderpriority") < "3", F.lit("PUE")).otherwise(F.lit("PPD")).alias("pay_type"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )


def monthly(inv: DataFrame, mov: DataFrame, supplier: DataFrame) -> DataFrame:
    """Long monthly series (taxpayer, metric, month, amount, n)."""
    billed = inv.groupBy("taxpayer", F.trunc("issued", "month").alias("month")).agg(
        F.sum("total").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    metric = F.when(F.col("kind") == "abono", F.lit("inflow")).when(F.col("kind") == "cargo", F.lit("outflow")).otherwise(F.lit("expenditure"))
    per_doc = mov.groupBy("doc_id", metric.alias("metric"), F.trunc("posted", "month").alias("month")).agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )
    moved = per_doc.join(supplier, F.col("doc_id") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("taxpayer"), "metric", "month"
    ).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    return billed.select("taxpayer", F.lit("revenue").alias("metric"), "month", "amount", "n").unionByName(moved)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines (doc_id, line from 0, text)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def doc_pages(spark: SparkSession, sf_dir: str, size: int = 5, dealt: bool = False) -> DataFrame:
    """Lines with a page number, ``size`` lines to a page.

    With ``dealt``, whole texts are dealt by document before they are split, so that lines and words of a page or document
    lie together and groupings, windows and joins by these keys move none of them again. Such frames go into no union
    that is grouped or joined later: Spark 4.1 takes the parts of its inputs to fit each other, which they need not.
    """
    lines = doc_lines(spark, sf_dir)
    if dealt:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
        lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("page", F.floor(F.col("line") / size).cast("int") + 1)


def doc_words(spark: SparkSession, sf_dir: str, size: int = 5, dealt: bool = True) -> DataFrame:
    """Words with positions: y from the line within its page, x from the place in the line; dealt by document."""
    lines = doc_pages(spark, sf_dir, size, dealt)
    words = lines.select("doc_id", "page", "line", F.posexplode(F.split("text", " ")).alias("place", "text"))
    return words.filter(F.col("text") != "").select(
        "doc_id", "page", "line", "place", "text",
        (F.col("place") * 40).cast("double").alias("x0"),
        ((F.col("line") % size) * 10).cast("double").alias("y0"),
        (F.col("place") * 40 + 30).cast("double").alias("x1"),
        ((F.col("line") % size) * 10 + 8).cast("double").alias("y1"),
    )
