"""Scalar cases: money, text, dates, ids, parsers."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from balanza.functions import dates as D, ids, money as M, parse as P, text as X


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("raw,want", [("$1234.56", 1234.56), ("500", 500.0), (None, 0.0), ("texto", 0.0), ("  -89.10", -89.1), ("1,234.50", 1234.5), ("", 0.0)])
def test_clean_amount(spark, raw, want):
    assert one(spark, M.clean_amount(F.lit(raw).cast("string"))) == want


def test_sum_amounts(spark):
    assert one(spark, M.sum_amounts(F.array(F.lit("1,000.50"), F.lit(" 2 "), F.lit("x"), F.lit("-1")))) == 1001.5


@pytest.mark.parametrize("text", ["Año  ÑANDÚ\tçedilla", "ﬁn ½ … “x” ™", "ß łódź", "日本 abc", "", "ascii only", "Ａｂｃ", "x²"])
def test_fold_equals_decomposition(spark, text):
    low = unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()
    assert one(spark, X.fold_text(F.lit(text))) == " ".join(low.split())


def test_company(spark):
    assert one(spark, X.clean_company(F.lit("Aceros Ñandú, SA de CV"))) == "aceros nandu"
    assert one(spark, X.clean_company(F.lit("Aceros S.A. DE C.V."))) == "aceros sa de cv"
    assert one(spark, X.clean_company(F.lit("N/A"))) == ""


@pytest.mark.parametrize("raw,start,end,want", [
    ("02/ENE", "2024-12-20", "2025-01-20", "02/01/2025"), ("25/12/23", "2024-01-01", None, "25/12/2023"), ("125", "2024-03-01", "2024-03-31", "25/03/2024"),
    ("999", "2024-03-01", None, "999/??/???? (Inválido)"), ("05", "2024-12-20", "2025-01-19", "05/01/2025"), ("31", "2024-04-01", "2024-04-30", "31/05/2024"),
    ("7", None, None, "07/??/????"), ("abc", "2024-01-01", None, "abc"), ("0", "2024-02-01", None, "01/02/2024"), ("", "2024-02-01", None, ""),
])
def test_complete_date(spark, raw, start, end, want):
    df = spark.createDataFrame([(raw, start, end)], "r string, s string, e string").withColumns({"s": F.col("s").cast("date"), "e": F.col("e").cast("date")})
    assert D.complete_date(df, "r", "s", "e").first().shown == want


@pytest.mark.parametrize("raw,want", [("01-DIC-25 COMISION", ("01-DIC-25", "COMISION")), ("01/12/2025 X", ("01/12/2025", "X")), ("02/ENE PAGO", ("02/ENE", "PAGO")), ("hola", ("hola", ""))])
def test_split_date(spark, raw, want):
    got = one(spark, D.split_date_noise(F.lit(raw)))
    assert (got.day_text, got.noise) == want


@pytest.mark.parametrize("raw,want", [("2025/Sep", "2025-09"), ("2025-9", "2025-09"), ("2025/Ago", "2025-08"), ("", ""), ("2025-01-02", "2025-01-02")])
def test_api_month(spark, raw, want):
    assert one(spark, D.api_month(F.lit(raw))) == want


@pytest.mark.parametrize("rfc,clabe,bank,text,want", [
    ("BBA830831LJ2", "012345678901234567", "", "", False), ("", "012345678901234567", "", "estado de cuenta de inversiones", True),
    ("ABC010101XY1", "", "", "Estado de cuenta de Inversiones", False), ("ABC01", "", "", "", False), ("ABC010101XY1", "", "", "", True), ("", "123456789012345", "American Express", "", True),
])
def test_account_validity(spark, rfc, clabe, bank, text, want):
    assert one(spark, ids.is_valid_account(F.lit(rfc), F.lit(clabe), F.lit(bank), F.lit(text))) is want


def test_taxpayer_type(spark):
    for text, want in (("con curp", "persona_fisica"), ("razón social", "persona_moral"), ("regimen capital", "persona_moral"), ("nada", "desconocido")):
        assert one(spark, ids.taxpayer_type(F.lit(text))) == want


def test_fenced_and_history(spark):
    assert one(spark, P.fenced_object(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, P.fenced_object(F.lit('{"b": 2}'))) == '{"b": 2}'
    assert one(spark, P.fenced_object(F.lit("no json"))) is None
    m = one(spark, P.mop_counts(F.lit("11LC9U-L")))
    assert (m.mop_1, m.mop_9, m.mop_u, m.mop_nd, m.mop_lc) == (2, 1, 1, 1, 1)


def test_recent_proof_and_blanks(spark):
    assert one(spark, D.recent_proof(F.lit("2025-05-20"), "2025-06-20")) is True
    assert one(spark, D.recent_proof(F.lit("2025-02-20"), "2025-06-20")) is False
    assert one(spark, D.recent_proof(F.lit("mal"), "2025-06-20")) is None
    assert one(spark, X.squeeze_blanks(F.lit("a   b\t\tc\nd"))) == "a b c\nd"


def test_complete_date_casts_digits_only(spark):
    """A failed cast costs an exception for each row, so texts without a numeric date are not cast."""
    df = spark.createDataFrame([("abc", None, None)], "r string, s date, e date")
    plan = D.complete_date(df, "r", "s", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert not [i for i in range(len(plan)) if plan.startswith("try_cast(", i) and "as int)" in plan[i : plan.find(" as ", i) + 8]]
