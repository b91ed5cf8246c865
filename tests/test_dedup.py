"""Fragment matching against nested loops, transfer details, and one bank's declared parts."""

import random

from pyspark.sql import functions as F

from balanza.operators import dedup as D, reconcile, screening

IGNORED = set(D.IGNORED_WORDS)


def words(text):
    return {w for w in text.lower().split() if len(w) > 2 and w not in IGNORED}


def test_fragments_equal_nested_loops(spark):
    rng = random.Random(11)
    vocab = ["pago", "spei", "norte", "sur", "renta", "luz", "gas"]
    rows = [(rng.randint(1, 3), f"m{i:03d}", rng.randint(1, 4), float(rng.choice([10, 20, 30.5])), " ".join(rng.sample(vocab, 2)), rng.choice(["parent", "child", "child", "other"])) for i in range(160)]
    want = {}
    for doc, child, day, amount, text, role in rows:
        if role != "child":
            continue
        parents = [r for r in rows if r[5] == "parent" and r[0] == doc]
        exact = [p for p in parents if p[2] == day and p[3] == amount]
        if len(exact) == 1:
            want[child] = exact[0][1]
            continue
        for p in exact if len(exact) > 1 else parents:
            if p[3] == amount and words(p[4]) & words(text):
                want[child] = p[1]
                break
    df = spark.createDataFrame(rows, "doc_id int, mov_id string, posted int, amt double, description string, role string").withColumn("amount", F.col("amt").cast("decimal(18,2)"))
    assert {r.child: r.parent for r in D.match_fragments(df).collect()} == want and len(want) > 20


def test_transfer_details(spark):
    rows = [(1, "a", "05/01", 10.0, "SPEI enviado", "PRINCIPAL"), (1, "b", "05", 10.0, "renta local", "SPEI_ENVIADOS"), (1, "c", "05", 10.0, "compra", "PRINCIPAL"), (1, "d", "06", 10.0, "renta", "SPEI_RECIBIDOS")]
    df = spark.createDataFrame(rows, "doc_id int, mov_id string, date_text string, amt double, description string, section string").withColumn("amount", F.col("amt").cast("decimal(18,2)"))
    assert [(r.child, r.parent) for r in D.match_transfer_details(df).collect()] == [("b", "a")]


def test_fragment_sums(spark):
    frag = spark.createDataFrame([(1, 1, "x", 4.0, "cred 0300-0447031"), (1, 1, "y", 6.0, "cred 03000447031"), (1, 1, "z", 5.0, "solo 99999999")], "doc_id int, posted int, mov_id string, amt double, description string").withColumn("amount", F.col("amt").cast("decimal(18,2)"))
    parents = spark.createDataFrame([(1, 1, "p", 10.0), (1, 1, "q", 5.0)], "doc_id int, posted int, mov_id string, amt double").withColumn("amount", F.col("amt").cast("decimal(18,2)"))
    got = {(r.child, r.parent, r.ref, r.fragments) for r in D.match_fragment_sums(frag, parents).collect()}
    assert got == {("x", "p", "03000447031", 2), ("y", "p", "03000447031", 2)}


def test_declared_parts(spark):
    text = "kapital depósitos en efectivo $1,000.00 transferencia recibida 500.50 cheques cobrados $ 20.00 ( + ) movimientos del mes $ 7.00"
    df = screening.kapital_parts(spark.createDataFrame([(text,)], "text string")).withColumns({"bank": F.lit("KAPITAL"), "deposits": F.lit(0.0), "charges": F.lit(0.0)})
    r = reconcile.kapital_sums(df).first()
    assert (r.deposits, r.charges) == (1507.5, 20.0)


def test_movements_are_made_once(spark, monkeypatch):
    """Rows, and what the sums leave of them, are written before they are read again."""
    seen = []
    monkeypatch.setattr(D, "cut", lambda df, compression=None: seen.append(df) or df.localCheckpoint())
    rows = spark.range(40).select(
        (F.col("id") % 4).alias("doc_id"), F.concat(F.lit("m"), "id").alias("mov_id"), F.lit("d").alias("posted"), (F.col("id") % 5).cast("decimal(18,2)").alias("amount"),
        (F.col("id") % 3 == 0).alias("fragment"), F.concat(F.lit("word number "), "id").alias("description"), F.when(F.col("id") < 20, "parent").otherwise("child").alias("role"),
    )
    D.apply_fragments(rows).collect()
    assert [f.columns[-1] for f in seen] == ["role", "child", "mov_id", "child"] and seen[0].columns == rows.columns


def test_rows_travel_once(spark, monkeypatch):
    """Rows and their texts are shuffled once, to their document and amount."""
    seen = []
    write = D.cut
    monkeypatch.setattr(D, "cut", lambda df, compression=None: seen.append(df) or write(df, compression))
    data = [(1, "p1", 1, 10.0, "renta norte", "parent", False), (1, "p2", 1, 30.0, "luz", "parent", False), (1, "c1", 1, 10.0, "x", "child", False), (1, "c2", 2, 10.0, "sur norte", "child", False),
            (1, "c3", 2, 10.0, "sur", "child", False), (1, "f1", 1, 10.0, "ref 00000001", "child", True), (1, "f2", 1, 20.0, "ref\n00000001", "child", True), (1, "f3", 1, 20.0, "ref 00000002", "child", True),
            (None, "n1", 1, 10.0, "renta", "child", False), (None, "n1", 1, 10.0, "renta", "child", False), (1, "n2", 1, None, "renta", "child", None), (1, "n3", None, 10.0, None, "child", False)]
    rows = spark.createDataFrame(data, "doc_id int, mov_id string, posted int, amt double, description string, role string, fragment boolean").withColumn("amount", F.col("amt").cast("decimal(18,2)")).drop("amt")
    got = sorted((r.mov_id, r.description) for r in D.apply_fragments(rows).collect())
    assert [g[0] for g in got] == ["c3", "f3", "n1", "n1", "n2", "n3", "p1", "p2"]
    assert [t for m, t in got if m in ("p1", "p2")] == ["renta norte | x | sur norte", "luz | DESGLOSE: ref 00000001 | ref 00000001"]
    last, alone = (f._jdf.queryExecution().executedPlan().toString().splitlines() for f in (seen[-1], D.match_fragments(rows)))
    moved, single = ([line for line in plan if "Exchange hashpartitioning" in line] for plan in (last, alone))
    assert len(moved) == len(single) == 1 and all("_key" in line for line in moved + single)
