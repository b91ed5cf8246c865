"""Results of jobs written again: nothing doubled, nothing old left, other jobs untouched, and runs that break off."""

import pytest
from pyspark.sql import functions as F

from balanza.operators import reports
from balanza.sources import results


def test_runs_replace_what_a_job_had(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)], "job_id int, k string, v double")
    b = spark.createDataFrame([(1, 10), (2, 20)], "job_id int, n int")
    both = a.select("job_id").distinct()
    for _ in range(2):
        results.write_run({"a": a, "b": b}, both, path, "r1")

    def seen(name, schema, job=None):
        return sorted(tuple(r) for r in results.read_sheet(spark, path, name, schema, job).collect())

    assert seen("a", a.schema) == [(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)] and seen("b", b.schema, 2) == [(2, 20)]
    # job 1 again, now without rows in sheet a; rows of another job in its frames don't count
    again = b.withColumn("n", F.col("n") + 1)
    manifest = results.write_run({"a": a.filter("job_id = 2"), "b": again}, both.filter("job_id = 1"), path, "r2")
    assert sorted(tuple(r) for r in manifest.collect()) == [(1, "a", "r2", 0), (1, "b", "r2", 1)]
    assert seen("a", a.schema) == [(2, "x", 3.0)] and seen("b", b.schema) == [(1, 11), (2, 20)]

    # a run that breaks off before its manifest changes nothing
    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    put, results._put = results._put, lambda df, p, *by: fail() if p.endswith(results.MANIFEST) else put(df, p, *by)
    try:
        with pytest.raises(Broken):
            results.write_run({"a": a, "b": b}, both, path, "r3")
    finally:
        results._put = put
    assert seen("a", a.schema) == [(2, "x", 3.0)] and seen("b", b.schema) == [(1, 11), (2, 20)]


def test_detail_sheets(spark):
    rows = [("m1", "TPV", "abono"), ("m2", "tpv", "abono"), ("m3", None, "cargo"), ("m4", "BASURA_OCR", "cargo"), ("m5", "COMISION_DB", "cargo"), ("m6", "TPV", " Importe "), ("m7", "OTRA", "cargo")]
    df = spark.createDataFrame([(1, 1, m, "B", "01-01-2020", "d", "t", 5.0, k, c) for m, c, k in rows], "job_id int, doc_id int, mov_id string, bank string, period string, posted string, description string, amount double, kind string, category string")
    got = {(r.sheet, r.mov_id): (r.category, r.provider) for r in reports.detail_sheets(df, F.lit("P")).collect()}
    assert {k[1] for k in got if k[0] == "todos_los_movimientos"} == {"m1", "m2", "m3", "m5", "m7"}
    assert {k: v for k, v in got.items() if k[0] != "todos_los_movimientos"} == {("transacciones_tpv", "m1"): ("TPV", "P"), ("transacciones_tpv", "m2"): ("TPV", "P"), ("comisiones_tpv", "m5"): ("COMISION_DB", None)}
    assert got["todos_los_movimientos", "m3"] == ("GENERAL", None) and got["todos_los_movimientos", "m1"] == ("TPV", None)


def test_sheets_are_small(spark, tmp_path):
    """Texts that stand on several sheets are written in zstd."""
    path = tmp_path / "store"
    a = spark.createDataFrame([(1, "x")], "job_id int, k string")
    results.write_run({"a": a}, a.select("job_id"), str(path), "r1")
    files = list((path / "sheet=a").rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
