"""The strict running balance against a plain walk, with creeping cents, misreads and documents of many blocks."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from balanza.operators import ordered
from balanza.operators.reconcile import running_balance_strict

ONE = Decimal("0.01")


def walk(rows, opening):
    carried, out = opening, {}
    for n, kind, amount, read in rows:
        expected = carried + {"abono": amount, "cargo": -amount}.get(kind, 0)
        review = read is None or abs(expected - read) > ONE
        carried = expected if review else read
        out[n] = (expected, review, expected if review else None, carried)
    return out


def made(rng, size, opening, creep=0.5):
    rows, true = [], opening
    for n in range(size):
        kind, amount = rng.choice(["abono", "cargo", "importe"]), Decimal(rng.randrange(0, 90000)) / 100
        true += {"abono": amount, "cargo": -amount}.get(kind, 0)
        if rng.random() < creep:
            true += rng.choice([-ONE, ONE])  # the bank's own rounding, which a strict reader follows
        read = rng.choice([true] * 6 + [true + ONE, true - ONE, true + 2 * ONE, true + 7, None, Decimal(rng.randrange(10**6)) / 100])
        rows.append((n, kind, amount, read))
    return rows


def check(spark, docs, block):
    data = [(d, opening, *row) for d, (opening, rows) in docs.items() for row in rows]
    df = spark.createDataFrame(data, "doc string, open decimal(18,2), n int, kind string, amount decimal(18,2), balance decimal(18,2)").repartition(7)
    got = running_balance_strict(df, F.col("open"), ["n"], block, keys=["doc"])
    assert got.columns == [*df.columns, "expected", "review", "inferred", "carried"]
    want = {(d, n): v for d, (opening, rows) in docs.items() for n, v in walk(rows, opening).items()}
    assert {(r.doc, r.n): (r.expected, r.review, r.inferred, r.carried) for r in got.collect()} == want


@pytest.mark.parametrize("span", [3, 1000])
def test_walks(spark, monkeypatch, span):
    monkeypatch.setattr(ordered, "SPAN", span)
    rng = random.Random(span)
    docs = {f"d{k}": (Decimal(rng.randrange(-500, 5000)), made(rng, rng.choice([1, 2, 7, 60]), Decimal(1000), rng.choice([0, 0.5, 0.9]))) for k in range(12)}
    for opening, rows in list(docs.values()):
        assert rows
    docs = {d: (Decimal(1000) if i % 3 else o, rows) for i, (d, (o, rows)) in enumerate(docs.items())}
    check(spark, docs, F.floor(F.col("n") / 5))


def test_hot_document_with_a_long_chain_of_cents(spark):
    """Every read is a cent further: only carrying it on accepts them all; with one gap the rest is up for review."""
    rows = [(n, "abono", Decimal(5), Decimal(1000) + 5 * (n + 1) + (n + 1) * ONE + (5 * ONE if n >= 700 else 0)) for n in range(900)]
    result = walk(rows, Decimal(1000))
    assert not result[699][1] and result[700][1]
    check(spark, {"hot": (Decimal(1000), rows), "short": (Decimal(3), [(0, "cargo", Decimal(1), Decimal(2))])}, F.floor(F.col("n") / 20))


def test_nothing_read(spark):
    check(spark, {"d": (Decimal(0), [(0, "abono", Decimal("1.10"), None), (1, "cargo", Decimal("2.20"), None)])}, F.lit(0))
    df = spark.createDataFrame([], "doc string, n int, kind string, amount decimal(18,2), balance decimal(18,2)")
    assert running_balance_strict(df, F.lit(0), ["n"], F.lit(0), keys=["doc"]).collect() == []


def test_fractions_of_cents(spark):
    """Changes finer than cents are summed up before they are rounded."""
    rows = [(n, "abono", Decimal("0.004"), Decimal(n * 4 // 10 + 1) / 100) for n in range(40)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, n int, kind string, amount decimal(18,3), balance decimal(18,2)")
    got = {r.n: r.carried for r in running_balance_strict(df, F.lit(0), ["n"], F.floor(F.col("n") / 7), keys=["doc"]).collect()}
    assert len(got) == 40 and got[39] == Decimal("0.16")


def test_rows_are_made_once(spark, sf_dir):
    """The movements are read and joined once, and travel once more at the end."""
    from balanza.queries import QUERIES, load_all

    load_all()
    plan = QUERIES["running_balance_strict"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_extendedprice" not in plan
