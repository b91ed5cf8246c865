"""Query registry and the SQL text shared by the oracle strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The date the queries take as today.
AS_OF = "2001-08-15"

TX = """tx AS (SELECT l_suppkey AS doc_id, l_suppkey % 10 AS job_id,
 concat_ws('-', l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT)) AS mov_id,
 l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, CAST(l_quantity AS INT) AS quantity,
 CAST(l_shipdate AS DATE) AS posted,
 CASE WHEN l_linestatus = 'O' THEN 'abono' WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'importe' ELSE 'cargo' END AS kind,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
 concat(p_name, ' ', lower(p_type), ' ', CAST(l_orderkey AS VARCHAR)) AS description
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COVER = """cover AS (SELECT doc_id, job_id, min(posted) AS period_start, max(posted) AS period_end,
 sum(CASE WHEN kind = 'abono' AND order_key % 50 <> 0 THEN amount ELSE 0 END) AS deposits,
 sum(CASE WHEN kind = 'cargo' AND order_key % 40 <> 0 THEN amount ELSE 0 END) AS charges,
 sum(CASE WHEN kind = 'cargo' AND line_no = 1 THEN amount ELSE 0 END) AS fees FROM tx GROUP BY doc_id, job_id)"""
INV = """inv AS (SELECT c_nationkey AS taxpayer, o_custkey AS counterparty, c_name AS name, o_orderkey AS invoice_id,
 CAST(o_orderdate AS DATE) AS issued, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
 CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'cancelled' END AS status,
 CASE WHEN o_orderpriority < '3' THEN 'PUE' ELSE 'PPD' END AS pay_type, o_orderpriority AS priority,
 c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey)"""
MONTHLY = """monthly AS (SELECT taxpayer, 'revenue' AS metric, CAST(date_trunc('month', issued) AS DATE) AS month,
 sum(total) AS amount, count(*) AS n FROM inv GROUP BY 1, 3
 UNION ALL SELECT s_nationkey, CASE kind WHEN 'abono' THEN 'inflow' WHEN 'cargo' THEN 'outflow' ELSE 'expenditure' END,
 CAST(date_trunc('month', posted) AS DATE), sum(amount), count(*) FROM tx JOIN supplier ON doc_id = s_suppkey GROUP BY 1, 2, 3)"""
LINES = """doc_lines AS (SELECT doc_id, i - 1 AS line, parts[i] AS text FROM
 (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u)"""
PAGES = """doc_pages AS (SELECT doc_id, line, text, CAST(floor(line / 5) AS INT) + 1 AS page FROM doc_lines)"""
WORDS = """doc_words AS (SELECT doc_id, page, line, i - 1 AS place, parts[i] AS text, (i - 1) * 40.0 AS x0,
 (line % 5) * 10.0 AS y0, (i - 1) * 40.0 + 30 AS x1, (line % 5) * 10.0 + 8 AS y1 FROM
 (SELECT doc_id, page, line, string_split(text, ' ') AS parts FROM doc_pages) d,
 LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u WHERE parts[i] <> '')"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that results compare across engines."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, (T.DateType,)):
            col = col.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers a query; decimals, dates and small integers are put in a plain form."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
