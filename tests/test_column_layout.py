"""Column boxes of pages: broken header words, and that words are read once."""

from pyspark.sql import functions as F

from balanza.operators import layout as L
from balanza.queries import QUERIES, load_all

load_all()


def test_words_are_read_once(spark, sf_dir):
    plan = QUERIES["column_layout"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "split(text" not in plan and "documents.parquet" not in plan


def test_pieces_without_a_name_of_their_own_count(spark):
    row = [(50, 58, "FE"), (60, 78, "CHA"), (150, 170, "CAR"), (172, 180, "GO"), (300, 340, "NADA"), (500, 540, "SALDO"), (600, 640, "SALDO")]
    data = [(1, 1, float(a), 100.0, float(b), 110.0, t) for a, b, t in row] + [(1, 2, 10.0, 100.0, 20.0, 110.0, "NADA")]
    words = spark.createDataFrame(data, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    headers = spark.createDataFrame([(1, 1, 110.0), (1, 2, 110.0), (1, 3, 110.0)], "doc_id int, page int, header_y double")
    got = L.column_layout(words, headers).select("page", "own_header", *[F.col(f"columns.{n}.{c}").alias(n + c) for n in ("FECHA", "CARGO", "ABONO", "SALDO") for c in ("token", "center")])
    want = ("FECHA", 64.0, "CARGO", 165.0, "(IMP)", 342.5, "SALDO", 520.0)
    assert [tuple(r) for r in got.orderBy("page").collect()] == [(1, True, *want), (2, False, *want), (3, False, *want)]
