"""Layout cases and brute-force comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from balanza.operators import layout as L
from balanza.plans.layout import extract_movements


@pytest.mark.parametrize("text,low,high", [
    ("FECHA CONCEPTO RETIRO DEPOSITO SALDO", 8, 99), ("FECHA CONCEPTO SALDO ANTERIOR", 0, 0), ("SALDO TOTAL", 1, 99), ("MEDIODIA DESCRIPCION", 1, 1),
])
def test_header_score(spark, text, low, high):
    assert low <= spark.range(1).select(L.header_score(F.lit(text)).alias("s")).first().s <= high


def page_words():
    words = []
    for x, t in ((50, "FECHA"), (150, "DESCRIPCION"), (300, "CARGO"), (400, "ABONO"), (500, "SALDO")):
        words.append((1, 1, float(x), 150.0, float(x + 40), 160.0, t))
    for x, t in ((50, "01/01"), (150, "PAGO"), (180, "DE"), (200, "SERVICIOS"), (305, "500.00"), (505, "1,000.00")):
        words.append((1, 1, float(x), 200.0, float(x + 25), 210.0, t))
    for x, t in ((150, "FOLIO"), (190, "INTERNO")):
        words.append((1, 1, float(x), 212.0, float(x + 25), 222.0, t))
    for x, t in ((50, "02/01"), (150, "DEPOSITO"), (410, "$"), (420, "250.00")):
        words.append((1, 1, float(x), 240.0, float(x + 20), 250.0, t))
    words.append((1, 1, 50.0, 750.0, 90.0, 760.0, "saldo final"))
    # Next page: no header; text before the first date belongs to the last row of page 1.
    for x, t in ((150, "CLIENTE"), (200, "NORTE")):
        words.append((1, 2, float(x), 170.0, float(x + 30), 180.0, t))
    for x, t in ((50, "03/01"), (150, "COMPRA"), (310, "75.25")):
        words.append((1, 2, float(x), 220.0, float(x + 25), 230.0, t))
    return words


def test_one_document(spark):
    words = spark.createDataFrame(page_words(), "doc_id bigint, page bigint, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id bigint, page bigint, width double, height double")
    got = [(r.page, r.posted, r.description, r.amount, r.kind) for r in extract_movements(words, pages).orderBy("page", "row_y").collect()]
    assert got == [
        (1, "01/01", "PAGO DE SERVICIOS\nFOLIO INTERNO", 500.0, "CARGO"), (1, "02/01", "DEPOSITO\nCLIENTE NORTE", 250.0, "ABONO"), (2, "03/01", "COMPRA", 75.25, "CARGO"),
    ]


def test_amount_rows_equal_walk(spark):
    rng = random.Random(5)
    data, want = [], {}
    for page in range(1, 30):
        ys = sorted(round(rng.uniform(0, 120), 1) for _ in range(25))
        xs = [round(rng.uniform(0, 500), 2) for _ in ys]
        data += [(1, page, page, 0.0, x, y, "k", float(i)) for i, (x, y) in enumerate(zip(xs, ys))]
        groups = []
        for x, y in zip(xs, ys):
            if groups and abs(y - groups[-1][0][1]) < 6.0:
                groups[-1].append((x, y))
            else:
                groups.append([(x, y)])
        want[page] = [(g[0][1], min(g)[0]) for g in groups]
    df = spark.createDataFrame(data, "doc_id int, page int, anchor_page int, anchor_y double, x0 double, y0 double, kind string, amount double")
    money = F.struct("kind", "amount", F.lit(False).alias("was_single"), F.lit(False).alias("signed"))
    df = df.withColumns({"money": money, "text": F.col("kind"), "text_from": F.lit(0.0)})
    got = {}
    for r in L.slice_rows(df).orderBy("page", "row_no").collect():
        got.setdefault(r.page, []).append((r.first_y, r.row_x))
    assert got == want


def test_page_headers_equal_walk(spark):
    rng = random.Random(9)
    lines, pages, want = [], [], {}
    for doc in range(12):
        y = None
        for page in range(1, 40):
            pages.append((doc, page, 800.0))
            best = None
            for _ in range(rng.randint(0, 3)):
                score, at = rng.choice([1, 1, 2, 2, 2, 3, 5]), float(rng.choice([100, 120, 135, 300]))
                lines.append((doc, page, at - 5, at, score))
                if best is None or (-score, at) < (-best[0], best[1]):
                    best = (score, at)
            if page == 1:
                y = best[1] if best and best[0] >= 2 else 160.0
            elif best and best[0] >= 3:
                y = best[1]
            elif best and abs(best[1] - y) < 40 and best[0] >= 2:
                y = best[1]
            want[doc, page] = y
    rows = spark.createDataFrame(lines, "doc_id bigint, page bigint, y double, y_max double, text int")
    sizes = spark.createDataFrame(pages, "doc_id bigint, page bigint, height double")
    got = {(r.doc_id, r.page): r.header_y for r in L.page_headers(rows, sizes, F.col("text")).collect()}
    assert got == want


def test_ocr_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.10, 0.14, 0.5), (1, 1, "b", 0.12, 0.16, 0.1), (1, 1, "c", 0.145, 0.185, 0.3), (1, 1, "d", 0.30, 0.34, 0.1)],
                                 "doc_id int, page int, text string, top double, bottom double, left double")
    assert [r.text for r in L.ocr_rows(rows).orderBy("row_no").collect()] == ["b | a", "c", "d"]


def test_band_layout_prefers_more_matches(spark):
    words = [(1, 1, 50.0, 100.0, 90.0, 110.0, "FECHA"), (1, 1, 150.0, 100.0, 190.0, 110.0, "CONCEPTO"), (1, 1, 300.0, 120.0, 340.0, 130.0, "MONTO"), (1, 1, 400.0, 120.0, 440.0, 130.0, "RASTREO"), (1, 1, 500.0, 120.0, 540.0, 130.0, "NOMBRE")]
    df = spark.createDataFrame(words, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")
    start = spark.createDataFrame([(1, 1, 98.0)], "doc_id int, page int, y_start double")
    got = L.band_layout(df, start).first()
    assert (got.profile, got.matches, got.columns.IMPORTE.center) == (1, 5, 320.0)


def walk_ranges(flags):
    open_at, out, n = None, [], len(flags)
    for page, (s, e) in enumerate(flags, 1):
        if open_at is None and s:
            open_at = page
        if open_at is not None:
            done = False
            if e:
                out.append((max(1, open_at - 1), page))
                open_at, done = None, True
            elif page > open_at and s:
                out.append((max(1, open_at - 1), page - 1))
                open_at = page
            if not done and open_at is not None and page == n:
                out.append((max(1, open_at - 1), n))
                open_at = None
    return out or [(1, n)]


def test_page_ranges_equal_walk(spark):
    rng = random.Random(2)
    data, want = [], {}
    for doc in range(60):
        flags = [(rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(1, 15))]
        data += [(doc, p, s, e) for p, (s, e) in enumerate(flags, 1)]
        want[doc] = sorted(walk_ranges(flags))
    df = spark.createDataFrame(data, "doc_id int, page int, s boolean, e boolean")
    got = {}
    for r in L.page_ranges(df, F.col("s"), F.col("e")).collect():
        got.setdefault(r.doc_id, []).append((r.first_page, r.last_page))
    assert {k: sorted(v) for k, v in got.items()} == want


def second_table():
    """A statement whose page 1 has a second table below, with other columns, which page 2 goes on with."""
    words = [(1, 1, float(x), 100.0, float(x + 40), 110.0, t) for x, t in ((50, "FECHA"), (150, "DESCRIPCION"), (300, "CARGO"), (400, "ABONO"), (500, "SALDO"))]
    words += [(1, 1, float(x), 140.0, float(x + 30), 150.0, t) for x, t in ((50, "01/01"), (150, "PAGO"), (305, "500.00"))]
    words += [(1, 1, float(x), 300.0, float(x + 40), 310.0, t) for x, t in ((50, "FECHA"), (150, "CONCEPTO"), (420, "DEPOSITO"), (300, "FOLIO"))]
    words += [(1, 1, float(x), 340.0, float(x + 30), 350.0, t) for x, t in ((50, "02/01"), (150, "ENTRADA"), (425, "70.00"))]
    words += [(1, 2, float(x), 200.0, float(x + 30), 210.0, t) for x, t in ((50, "03/01"), (150, "OTRA"), (425, "80.00"))]
    return words


def test_a_second_table_takes_its_own_columns(spark):
    df = spark.createDataFrame(second_table(), "doc_id bigint, page bigint, x0 double, y0 double, x1 double, y1 double, text string")
    tops = spark.createDataFrame([(1, 1, 110.0), (1, 2, 100.0)], "doc_id bigint, page bigint, top double")
    bands = L.inline_bands(df, tops).collect()
    assert [(b.page, b.y, b.bottom, b.profile) for b in bands] == [(1, 300.0, 310.0, 0)]
    assert bands[0].columns.ABONO.center == 440.0 and bands[0].columns.CARGO is None
    own = spark.createDataFrame([(1, 1)], "doc_id bigint, page bigint").withColumn("columns", F.struct(*[F.lit(None).cast(L._BOX).alias(n) for n in L.R.COLUMN_WORDS]))
    placed = {(r.page, r.y0, r.text): (r.band_page, r.band_y) for r in L.banded_words(df, L.inline_bands(df, tops), own).collect()}
    assert placed[1, 140.0, "PAGO"] == (1, float("-inf")) and placed[1, 340.0, "ENTRADA"] == (1, 290.0) and placed[2, 200.0, "OTRA"] == (1, 290.0)
    assert not any(p == 1 and y == 300.0 for p, y, _ in placed)
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id bigint, page bigint, width double, height double")
    got = sorted((r.page, r.posted, r.description, r.amount, r.kind) for r in extract_movements(df, pages).collect())
    assert [g[:4] for g in got] == [(1, "01/01", "PAGO", 500.0), (1, "02/01", "ENTRADA", 70.0), (2, "03/01", "OTRA", 80.0)]
    assert got[0][4] == "CARGO" and all(g[4] in ("ABONO", "IMPORTE") for g in got[1:])


def test_rows_of_slices(spark):
    """Totals go, lines break, signs and short numbers beside an amount are no text, a lone inherited slice is an orphan."""
    money = "struct<kind:string,amount:double,was_single:boolean,signed:boolean>"
    paid = ("CARGO", 5.0, False, False)
    rows = [
        (1, 1, 1, 10.0, 100.0, 12.0, "PAGO", None), (1, 1, 1, 10.0, 130.0, 12.4, "UNO", None), (1, 1, 1, 10.0, 290.0, 12.0, "$", None), (1, 1, 1, 10.0, 250.0, 12.0, "12345", None), (1, 1, 1, 10.0, 300.0, 12.0, "5.00", paid),
        (1, 1, 1, 10.0, 100.0, 20.0, "segunda", None), (1, 1, 1, 10.0, 100.0, 50.0, "TOTAL", None), (1, 1, 1, 10.0, 300.0, 50.0, "9.00", paid), (1, 1, 1, 10.0, 320.0, 54.0, "8.00", paid),
        (1, 2, 1, 10.0, 100.0, 5.0, "cola", None), (1, 2, 1, 10.0, 100.0, 15.0, "más", None), (1, 2, 2, 40.0, 100.0, 42.0, "solo", None),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, page int, anchor_page int, anchor_y double, x0 double, y0 double, text string, money {money}").withColumn("text_from", F.lit(50.0))
    out = L.slice_rows(df)
    got = {(r.page, r.row_no): (r.amount, r.description, r.orphan) for r in out.collect()}
    assert got == {(1, 1): (5.0, "PAGO UNO\nsegunda", None), (1, 2): (5.0, None, None), (2, 0): (None, None, "cola\nmás")}
    assert [(r.page, r.description) for r in L.stitch_orphans(out).collect()] == [(1, "PAGO UNO\nsegunda\ncola\nmás")]


def test_dates_in_later_blocks_and_no_sections(spark):
    rows = [
        (1, 0, "nada 5.00", 1), (1, 1, "CARGO | 03 | pago | 10.00", 4), (1, 2, "sigue", 1), (1, 3, "a | b | c | 04 | 9.00", 5), (1, 4, "05 sin dinero", 1), (1, 5, "12/01/2024 | x | 1,000.00", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id int, row_no bigint, text string, elements int")
    got = [(r.row_no, r.section, r.slice, r.date_text) for r in L.section_slices(df, (), junk=("ZZZZ",)).orderBy("row_no").collect()]
    assert got == [(1, "PRINCIPAL", 1, "03"), (2, "PRINCIPAL", 1, None), (3, "PRINCIPAL", 1, None), (4, "PRINCIPAL", 1, None), (5, "PRINCIPAL", 2, "12/01/2024")]
    some = L.section_slices(df, (("S", lambda t: t.contains("SIGUE")),), junk=("ZZZZ",), first="A")
    assert [(r.row_no, r.section) for r in some.orderBy("row_no").collect()] == [(1, "A"), (3, "S"), (4, "S"), (5, "S")]
