"""Holder names inside of texts against a plain search; the places of a text don't travel."""

import random

from balanza.operators.own_transfer import own_by_name_exact


def test_exact_names(spark):
    rng = random.Random(4)
    names = [(j, "".join(rng.choice("abc ñ") for _ in range(rng.randrange(4, 9)))) for j in (1, 2) for _ in range(30)]
    names = sorted({(j, n.replace("ñ", "n").strip()) for j, n in names if len(n.strip()) >= 4})
    texts = [(1 + i % 2, f"m{i % 500}", "".join(rng.choice("abc ñ") for _ in range(rng.randrange(0, 30)))) for i in range(600)] + [(1, "none", None)]
    want = {(j, k) for j, k, t in texts if t is not None and any(o == j and n in t.replace("ñ", "n") for o, n in names)}
    mov = spark.createDataFrame(texts, "job_id int, mov_id string, description string")
    out = own_by_name_exact(mov, spark.createDataFrame(names, "job_id int, name string"))
    assert {tuple(r) for r in out.collect()} == want and len(want) > 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_gram" in line]
    assert own_by_name_exact(mov, spark.createDataFrame([], "job_id int, name string")).count() == 0
