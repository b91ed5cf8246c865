"""Bank detection, certificates, coverage and congruence, intake, reconciliation."""

from pyspark.sql import functions as F

from balanza.operators import intake, reconcile, screening as S, totals as T
from balanza.plans.screening import screen
from balanza.rules import banks as B


def test_detect_bank(spark):
    df = spark.createDataFrame([
        (1, "Banco Patito. RFC: XYZ123456789 ... abonos $1,500.50"), (2, "nada"), (3, "Banco Nacional de México registro federal de contribuyentes: abc010101xy1 depósitos 2,000.00"),
    ], "doc_id int, text string")
    banks = {"patito": {"alias": ["banco patito"], "rfc": [r"rfc:\s*([a-z0-9]{12})"], "depositos": [r"abonos\s*\$\s*([\d,]+\.\d{2})"]}}
    got = {r.doc_id: r for r in S.detect_bank(df, banks=banks).collect()}
    assert (got[1].bank, got[1].rfc, got[1].deposits, got[1].fees) == ("PATITO", "XYZ123456789", 1500.5, None) and got[2].bank is None
    real = S.detect_bank(df).filter("doc_id = 3").first()
    assert (real.bank, real.rfc, real.deposits) == ("BANAMEX", "ABC010101XY1", 2000.0)


def test_digital(spark):
    df = spark.createDataFrame([("",), (None,), ("x" * 100,), ("estado de cuenta del banco " + "x" * 60,)], "t string")
    assert [r.d for r in df.select(S.is_digital_text(F.col("t")).alias("d")).collect()] == [False, False, False, True]


def test_certificate(spark):
    text = "rfc: abcd010101xy1\ncurp: abcd010101hdfxyz01\nnombre (s): ana\nprimer apellido: perez\n1 comercio al por menor 100 01/01/2019\nrégimen simplificado 01/02/2020 03/04/2021\n"
    df = spark.createDataFrame([(1, text), (2, "curp: sin id")], "doc_id int, text string")
    rows = {r.doc_id: r for r in S.parse_certificates(df).collect()}
    assert rows[1].rfc == "abcd010101xy1" and rows[1].nombre == "ana" and rows[2].rfc is None and rows[2].curp is None
    act = S.certificate_activities(df).first()
    assert (act.position, act.activity, act.share, act.end) == (1, "comercio al por menor", 100.0, None)
    reg = S.certificate_regimes(df).first()
    assert (reg.regime, reg.start, reg.end) == ("régimen simplificado", "01/02/2020", "03/04/2021")


def test_coverage_over_new_year(spark):
    light = spark.createDataFrame([(1, "11-2025"), (1, "12-2025"), (1, "01-2026"), (2, "12-2025"), (3, "10-2025"), (3, "11-2025"), (3, "12-2025")], "job_id int, period string")
    got = {r.job_id: (r.complete, r.message) for r in S.period_coverage(light, "2026-02-10").collect()}
    assert got[1][0] and got[3][0]
    assert got[2] == (False, "Faltan al menos 2 estado(s) de cuenta de los meses: enero 2026, noviembre 2025")


def test_congruence(spark):
    light = spark.createDataFrame([(1, "R1", "N1"), (1, "R2", "N1"), (2, "R1", "N1"), (2, "R1", None)], "job_id int, rfc string, holder string")
    got = S.identity_congruence(light).collect()
    assert {(r.job_id, r.kind, r.value) for r in got} == {(1, "RFC", "R1"), (1, "RFC", "R2")}


def test_three_sources(spark):
    df = spark.sql("""SELECT named_struct('deposits', a, 'rfc', 'A', 'clabe', '12', 'bank', 'x') a, named_struct('deposits', b, 'rfc', 'AB', 'clabe', repeat('1', 18), 'bank', 'y') b,
        named_struct('deposits', rx, 'rfc', 'XYZ123456789', 'clabe', NULL, 'bank', NULL) rx FROM VALUES (1000D, 1000D, 50D), (9999D, 2500D, 2500D), (100D, 500D, 7D), (100D, NULL, NULL) t(a, b, rx)""")
    out = reconcile.reconcile_sources(df, ["deposits"], ["rfc", "clabe"], ["bank"]).collect()
    assert [r.deposits for r in out] == [1000, 2500, 500, 100] and {r.rfc for r in out} == {"XYZ123456789"} and {r.clabe for r in out} == {"1" * 18} and {r.bank for r in out} == {"x"}


def test_kapital(spark):
    parts = {p: float(i) for i, p in enumerate([*B.KAPITAL_DEPOSITS, *B.KAPITAL_CHARGES])}
    df = spark.createDataFrame([("KAPITAL", 1.0, 1.0), ("BBVA", 1.0, 1.0)], "bank string, deposits double, charges double").withColumns({k: F.lit(v) for k, v in parts.items()})
    got = {r.bank: (r.deposits, r.charges) for r in reconcile.kapital_sums(df).collect()}
    assert got == {"KAPITAL": (15.0, float(sum(range(6, 14)))), "BBVA": (1.0, 1.0)}


def test_job_thresholds(spark):
    df = spark.createDataFrame([(1, 300000.0), (2, 150000.0), (3, 250000.0), (4, None)], "job_id int, d double").withColumn("deposits", F.col("d").cast("decimal(18,2)"))
    got = {r.job_id: (r.gate_flag, r.report_flag) for r in T.job_totals(df).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False)}


def test_scan_and_cache(spark, tmp_path):
    from balanza.sources.documents import load_results, save_results, scan_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in" / "b.pdf").write_bytes(b"hello")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF" + b"0" * 500)
    files = scan_documents(spark, str(tmp_path / "in"), max_bytes=100)
    got = {r.file_name: (r.file_type, r.intake_error is None) for r in files.collect()}
    assert got == {"a.pdf": ("pdf", True), "b.pdf": (None, False), "c.pdf": (None, False)}
    good = files.filter("intake_error is null").select(F.lit(7).alias("job_id"), "hash", "file_name")
    save_results(good.withColumn("status", F.lit("done")), str(tmp_path / "out"))
    prior = load_results(spark, str(tmp_path / "out"), 7)
    cached, fresh = intake.split_cached(good.withColumn("file_name", F.lit("renamed")), prior)
    assert cached.first().file_name == "renamed" and cached.first().status == "done" and fresh.isEmpty()


def test_screening_plan(spark):
    body = "estado de cuenta banco santander cliente r.f.c. abc010101xy1 periodo " + "palabras " * 10
    docs = spark.createDataFrame([(1, 1, "edo.pdf", body, False), (1, 2, "csf.pdf", body, False), (1, 3, "edo2.pdf", "estado de cuenta banco " + "x " * 40, False)], "job_id int, doc_id int, name string, text string, has_images boolean")
    fields = spark.createDataFrame([(1, "Santander", "123", "05-2025", "null", "ANA"), (3, "bbva", "null", "04-2025", "N/A", "")], "doc_id int, bank string, clabe string, period string, rfc string, holder string")
    out = screen(docs, fields, "2025-06-10")
    ok = out["accepted"].collect()
    assert [(r.doc_id, r.rfc, r.clabe, r.alert) for r in ok] == [(1, "ABC010101XY1", "0" * 15 + "123", None)]
    assert {r.doc_id for r in out["rejected"].collect()} == {2, 3}
    assert out["coverage"].first().complete is False
