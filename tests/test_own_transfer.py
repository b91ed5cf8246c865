"""Similarity of names by matching blocks, and the runs of words that are near a name, against plain versions."""

import difflib
import random

from pyspark.sql import functions as F

from balanza.functions.text import matching_ratio
from balanza.operators.own_transfer import own_by_name_ratio


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def changed(rng, text, letters="abcdxy "):
    out = list(text)
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        i = rng.randrange(len(out) + 1)
        what = rng.random()
        if what < 0.4 and i < len(out):
            del out[i]
        elif what < 0.7:
            out.insert(i, rng.choice(letters))
        elif i < len(out):
            out[i] = rng.choice(letters)
    return "".join(out)


def test_matching_ratio(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("", "a"), ("abc", ""), ("abcd", "bcda"), ("aaaa", "aa"), ("grupo comercial del norte", "grupo comercial norte del"), ("ñandú", "nandu")]
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 18)))
        pairs.append((a, changed(rng, a) if rng.random() < 0.7 else "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12)))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.r for r in df.select("i", matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - plain(a, b)) < 1e-12, (a, b)
    assert spark.range(1).select(matching_ratio(F.lit(None).cast("string"), F.lit("a")).alias("r")).first().r is None


def test_runs_near_a_name(spark):
    rng = random.Random(12)
    words = ["grupo", "norte", "comercial", "sol", "aceros", "del", "valle", "luna"]
    names = sorted({" ".join(rng.sample(words, rng.choice([1, 2, 3]))) for _ in range(14)} - {"sol", "del"})
    texts = []
    for i in range(160):
        base = rng.choice(names) if rng.random() < 0.8 else "otra cosa"
        texts.append((1 + i % 2, f"m{i}", f"pago {changed(rng, base, 'aeoz')} {rng.choice(words)} {rng.randrange(9)}"))
    own = {1: names[::2], 2: names[1::2]}
    want = set()
    for job, key, text in texts:
        parts = text.split()
        for name in own[job]:
            k = len(name.split())
            if any(plain(name, " ".join(parts[i : i + k])) >= 0.85 for i in range(len(parts) - k + 1)):
                want.add((job, key))
    mov = spark.createDataFrame(texts, "job_id int, mov_id string, description string")
    pool = spark.createDataFrame([(j, n) for j, ns in own.items() for n in ns], "job_id int, name string")
    assert {tuple(r) for r in own_by_name_ratio(mov, pool).collect()} == want and len(want) > 40


def test_runs_are_made_once(spark, sf_dir):
    """Pairs and keys read the runs of words that were written; the movements are not read again for either."""
    from balanza.queries import QUERIES, load_all

    load_all()
    for name in ("own_transfer_fuzzy", "own_transfer_ratio"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(array_distinct" not in plan, name
