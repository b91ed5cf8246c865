"""Classification cases: keyword hits, routing, conflicts, totals, labels, transfers."""

import random

import pytest
from pyspark.sql import functions as F

from balanza.operators import classify as C, own_transfer as O, totals as T
from balanza.rules.tags import TAG_RULES, TagRule, with_lender

SMALL = (
    TagRule("EXCLUIDA", 9999, ("comision", "manejo de cuenta")),
    TagRule("EFECTIVO", 30, ("deposito en efectivo", "dep. efectivo")),
    TagRule("TRASPASO", 40, ("traspaso entre cuentas", "spei enviado")),
    TagRule("IVA", 1000, ("iva",)),
)


def decide(spark, rows, rules=TAG_RULES):
    df = spark.createDataFrame(rows, "description string, kind string")
    return {(r.description, r.kind): (r.category, r.reason) for r in C.decide_movements(df, rules).collect()}


def test_small_rules(spark):
    got = decide(spark, [
        ("PAGO DE LUZ", "cargo"), ("RETIRO CAJERO", "retiro"), ("DEPÓSITO EN EFECTIVO SUC 123", "abono"),
        ("TRASPASO ENTRE CUENTAS", "deposito"), ("TRASPASO  ENTRE   CUENTAS", "cargo"), ("PAGO NETPAY SAPI", "abono"), ("manejo de cuenta", "cargo"),
    ], SMALL)
    cats = {d: c for (d, _), (c, _) in got.items()}
    assert cats["PAGO DE LUZ"] is None and cats["RETIRO CAJERO"] is None and cats["PAGO NETPAY SAPI"] is None
    assert cats["DEPÓSITO EN EFECTIVO SUC 123"] == "EFECTIVO"
    assert cats["TRASPASO ENTRE CUENTAS"] == "TRASPASO_ABONO" and cats["TRASPASO  ENTRE   CUENTAS"] == "TRASPASO_CARGO"
    assert cats["manejo de cuenta"] == "GENERAL"


@pytest.mark.parametrize("text,kind,category", [
    ("IVA COMISION", "cargo", "IVA"),
    ("IVA COMISION", "abono", "GENERAL"),
    ("comision descuento cr", "cargo", "COMISION_CR"),
    ("terminales punto de venta", "abono", "TPV"),
    ("terminales punto de venta", "cargo", "COMISION_MIXTA"),
    ("domiciliacion iva comision", "cargo", "PAGO_FINANCIAMIENTO"),
    ("dru123 domiciliacion", "cargo", "PAGO_FINANCIAMIENTO"),
    ("traspaso entre cuentas iva", "cargo", "TRASPASO_CARGO"),
    ("bmrcash ref 1 descuento", "cargo", "BMRCASH"),
    ("prestamo", "abono", "FINANCIAMIENTO"),
    ("prestamo", "cargo", "PAGO_FINANCIAMIENTO"),
    ("prestamo sofom", "abono", "FINANCIAMIENTO"),
    ("deposito efectivo mercadopago", "abono", "EFECTIVO"),
    ("crédito otorgado", "abono", "FINANCIAMIENTO"),
    ("señor pago", "abono", None),
    ("lo que sea", "importe", "BASURA_OCR"),
])
def test_shipped_rules(spark, text, kind, category):
    assert decide(spark, [(text, kind)])[(text, kind)][0] == category


def test_fold_rules_and_lender(spark):
    df = spark.createDataFrame([("señor pago x", "abono"), ("pago acme", "cargo")], "description string, kind string")
    folded = C.decide_movements(df, TAG_RULES, fold_rules=True).orderBy("kind").collect()
    assert [r.category for r in folded] == ["TPV", None]
    own = C.decide_movements(df, with_lender(TAG_RULES, "Acme")).orderBy("kind").collect()
    assert [r.category for r in own] == [None, "PAGO_FINANCIAMIENTO"]


def test_array_form_agrees_with_flags(spark):
    words = [k for r in TAG_RULES for k in r.keywords]
    rng = random.Random(3)
    rows = [(" ".join(rng.sample(words, 2)), rng.choice(["abono", "cargo", "importe", "crédito"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "description string, kind string")
    two_step = C.resolve_tags(C.tag_movements(df)).select("description", "kind", "category", "reason")
    one_step = C.decide_movements(df).select("description", "kind", "category", "reason")
    assert two_step.exceptAll(one_step).isEmpty() and one_step.exceptAll(two_step).isEmpty()


def test_totals_with_bad_amount(spark):
    rows = [(1, "1000.50", "abono", "TPV"), (1, "500.00", "abono", "TPV"), (1, "malo", "abono", "TPV"), (1, "200", "abono", "EFECTIVO"), (1, "9", "cargo", "COMISION_MIXTA")]
    from balanza.functions.money import clean_amount

    df = spark.createDataFrame(rows, "doc_id int, raw string, kind string, category string").withColumn("amount", clean_amount(F.col("raw")).cast("decimal(18,2)"))
    got = T.category_totals(df).first()
    assert float(got.tpv) == 1500.5 and float(got.efectivo) == 200 and float(got.depositos) == 1700.5
    assert (got.n_tpv, got.n_otros, got.n_general) == (3, 1, 1) and float(got.comision_tpv_mixta) == 0
    assert float(T.category_totals(df, fold_mixed=True).first().comision_tpv_mixta) == 9


def test_labels(spark):
    df = spark.createDataFrame([(0, "abono"), (1, "abono"), (2, "cargo"), (3, "cargo")], "id int, kind string").withColumns(
        {"category": F.when(F.col("id") == 3, F.lit("IVA")), "reason": F.lit(None).cast("string")}
    )
    labels = spark.createDataFrame([(0, "general"), (2, " Traspaso Entre Cuentas "), (3, "tpv")], "id int, label string")
    got = {r.id: r.category for r in C.merge_labels(df, labels, "id").collect()}
    assert got == {0: "GENERAL", 1: "GENERAL", 2: "TRASPASO_CARGO", 3: "IVA"}


def brute_own(text, name, fold):
    desc = fold(text)
    if name in desc:
        return True
    words, size = desc.split(), len(name.split())
    runs = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    return any(100 * edits(name, r) <= 15 * max(len(name), len(r)) for r in runs)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_own_transfer_names_equal_brute_force(spark):
    rng = random.Random(7)
    names = ["comercial del norte", "aceros lopez hermanos", "grupo xyz", "maria fernanda gil"]

    def damage(t):
        chars = list(t)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(chars))
            op = rng.random()
            if op < 0.4:
                chars[i] = rng.choice("abcdefghij")
            elif op < 0.7:
                del chars[i]
            else:
                chars.insert(i, rng.choice("abcdefghij"))
        return "".join(chars)

    rows = []
    for i in range(400):
        name = rng.choice(names)
        rows.append((i % 3, f"m{i}", f"SPEI enviado {damage(name)} ref {rng.randint(1, 999)}"))
    mov = spark.createDataFrame(rows, "job_id int, mov_id string, description string")
    pool = spark.createDataFrame([(j, n) for j in range(3) for n in names[: j + 2]], "job_id int, name string")
    exact = {r.mov_id for r in O.own_by_name_exact(mov, pool).collect()}
    fuzzy = {r.mov_id for r in O.own_by_name_fuzzy(mov, pool).collect()}
    want = {m for j, m, t in rows if any(brute_own(t, n, str.lower) for n in names[: j + 2])}
    assert exact | fuzzy == want and 50 < len(want) < 400


def test_own_by_account_and_protection(spark):
    covers = spark.createDataFrame([(1, "0123-4567 8901234567")], "job_id int, clabe string")
    mov = spark.createDataFrame([
        (1, 1, "a", "SPEI 8901234567 x", "abono", "GENERAL", 10.0), (1, 1, "b", "cta 78901234567", "cargo", "TPV", 5.0),
        (1, 1, "c", "otra 1234567890", "abono", "GENERAL", 3.0), (2, 2, "d", "8901234567", "abono", "GENERAL", 4.0),
    ], "job_id int, doc_id int, mov_id string, description string, kind string, category string, amount double")
    own = O.own_by_account(mov, O.account_pool(covers))
    got = {r.mov_id: (r.suspicious, r.category) for r in O.apply_own(mov, own).collect()}
    assert got == {"a": (True, "TRASPASO_ABONO"), "b": (True, "TPV"), "c": (False, "GENERAL"), "d": (False, "GENERAL")}


def test_labels_of_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "abono", None, None), (2, "cargo", None, None), (3, "cargo", "X", "r")], "k int, kind string, category string, reason string")
    labels = spark.createDataFrame([(1, "traspaso entre cuentas", 1), (1, " Financiamiento ", 2), (1, "", 3), (2, None, 1), (3, "a", 1), (3, "b", 2)], "k int, label string, seq int")
    last = {r.k: r.category for r in C.merge_labels(df, labels, "k", order="seq").collect()}
    assert last == {1: "FINANCIAMIENTO", 2: "GENERAL", 3: "X"}
    some = [(r.k, r.category) for r in C.merge_labels(df, labels, "k").orderBy("k").collect()]
    assert some == [(1, "FINANCIAMIENTO"), (2, "GENERAL"), (3, "X")]
