"""What travels between tasks: plans in which the words of documents are shuffled fail here."""

import pytest

from balanza.queries import QUERIES, load_all

load_all()


def shuffles(df):
    """The hash shuffles of the plan as it is before it runs."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["word_lines", "ocr_rows", "zone_mode", "page_footers"])
def test_words_do_not_travel(spark, sf_dir, name):
    kinds = {line.split("hashpartitioning(")[1].split("#")[0] + line.split(", ")[-2 if "plan_id" in line else -1] for line in shuffles(QUERIES[name](spark, sf_dir))}
    assert kinds == {"doc_idREPARTITION_BY_COL"}
