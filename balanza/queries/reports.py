"""Summary sheet: key-value blocks and listings of one taxpayer as one long frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from balanza.functions import dates as D
from balanza.operators import network as N, reports, series as S
from balanza.queries.finance import _BLACK, _INST, _blacklist, _institutions
from balanza.queries.registry import AS_OF, INV, query, with_ctes
from balanza.sources import adapters as A


@query("executive_summary", with_ctes(INV, _BLACK, _INST) + """
, x1 AS (SELECT taxpayer, min(issued) AS registered, count(*) AS invoices, min(name) AS name FROM inv GROUP BY ALL),
h1 AS (SELECT taxpayer, date_trunc('month', issued)::DATE AS month, count(*) AS total FROM inv GROUP BY ALL), h2 AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY month DESC) - 1 AS back FROM h1),
h3 AS (SELECT taxpayer, CASE back WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 5 THEN 6 WHEN 8 THEN 9 WHEN 11 THEN 12 WHEN 23 THEN 24 END AS months_back, total FROM h2 WHERE back IN (0, 2, 5, 8, 11, 23)),
h4 AS (SELECT a.taxpayer, a.months_back, a.total, b.total AS older FROM h3 a LEFT JOIN h3 b ON a.taxpayer = b.taxpayer AND b.months_back = CASE a.months_back WHEN 1 THEN 3 WHEN 3 THEN 6 WHEN 6 THEN 9 WHEN 9 THEN 12 WHEN 12 THEN 24 END),
b1 AS (SELECT taxpayer, counterparty, arg_min(status, side) AS status, sum(amount) AS total FROM rich GROUP BY ALL),
t1 AS (SELECT *, row_number() OVER (PARTITION BY taxpayer ORDER BY total DESC, counterparty) AS rank FROM inst)
SELECT taxpayer, 'identity' AS block, unnest(['business_name', 'registered', 'seniority', 'invoices']) AS name, unnest([name, registered::VARCHAR, (floor((DATE '2001-08-15' - registered) / 365)::BIGINT)::VARCHAR, invoices::VARCHAR]) AS value FROM x1
UNION ALL SELECT taxpayer, 'headcount', concat('month_', months_back), concat_ws(' / ', total, coalesce(total - older, 0), CASE WHEN older IS NULL THEN 'Sin datos previos' WHEN total > older THEN 'Aumentó' WHEN total < older THEN 'Disminuyó' ELSE 'Constante' END) FROM h4
UNION ALL SELECT taxpayer, 'blacklist', counterparty::VARCHAR, concat_ws(' / ', status, total) FROM b1 WHERE status IN ('definitive', 'presumed')
UNION ALL SELECT taxpayer, 'institutions', counterparty::VARCHAR, total::VARCHAR FROM t1 WHERE rank <= 10""")
def executive_summary(spark, d):
    """Identity, headcount, blacklist and institution blocks of every taxpayer."""
    inv = A.invoices(spark, d)
    first = inv.groupBy("taxpayer").agg(F.min("issued").alias("registered"), F.count(F.lit(1)).alias("invoices"), F.min("name").alias("name"))
    identity = reports.key_values(first, "identity", {
        "business_name": F.col("name"), "registered": F.col("registered"), "seniority": D.seniority_days(F.col("registered"), AS_OF), "invoices": F.col("invoices"),
    })
    people = S.headcount_trend(inv.groupBy("taxpayer", F.trunc("issued", "month").alias("month")).agg(F.count(F.lit(1)).alias("total")))
    staff = people.select("taxpayer", F.lit("headcount").alias("block"), F.concat(F.lit("month_"), F.col("months_back").cast("string")).alias("name"),
                          F.concat_ws(" / ", F.col("total").cast("string"), F.col("difference").cast("string"), "trend").alias("value"))
    black = N.blacklist_exposure(_blacklist(spark, d), order="side")
    flags = black.filter("red_flag").select("taxpayer", F.lit("blacklist").alias("block"), F.col("counterparty").cast("string").alias("name"),
                                            F.concat_ws(" / ", "status", F.col("total_amount").cast("string")).alias("value"))
    inst = N.top_counterparties(_institutions(spark, d), 10).select("taxpayer", F.lit("institutions").alias("block"), F.col("counterparty").cast("string").alias("name"), F.col("total").cast("string").alias("value"))
    return identity.unionByName(staff).unionByName(flags).unionByName(inst)


@query("summary_identity", with_ctes(INV) + """
, f AS (SELECT taxpayer, min(issued) AS registered, count(*) AS invoices, min(name) AS name FROM inv GROUP BY ALL)
SELECT taxpayer, 'identity' AS block, unnest(['business_name', 'registered', 'seniority', 'invoices']) AS name, unnest([name, registered::VARCHAR, (floor((DATE '2001-08-15' - registered) / 365)::BIGINT)::VARCHAR, invoices::VARCHAR]) AS value FROM f""")
def summary_identity(spark, d):
    first = A.invoices(spark, d).groupBy("taxpayer").agg(F.min("issued").alias("registered"), F.count(F.lit(1)).alias("invoices"), F.min("name").alias("name"))
    return reports.key_values(first, "identity", {
        "business_name": F.col("name"), "registered": F.col("registered"), "seniority": D.seniority_days(F.col("registered"), AS_OF), "invoices": F.col("invoices"),
    })
