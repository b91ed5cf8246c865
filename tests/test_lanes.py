"""Blocks of rows and their lanes: what is held in a task's memory, and rows with many blocks at one place."""

from balanza.queries import QUERIES, layout as Q, load_all

load_all()


def test_blocks_are_not_gathered_by_row(spark, sf_dir):
    plan = QUERIES["nearest_lane"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Aggregate(" in line or "Sort [" in line]
    assert lines and not [line for line in lines if "row_no" in line or "left#" in line and "text#" in line]


def test_rows_count_blocks_at_one_place(spark, tmp_path):
    docs = [(1, " ".join(["w"] * 60) + "\n\n x  y"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.row_no, round(r.left, 6)): r.n for r in Q._blocks(spark, str(tmp_path)).filter("text <> 'texto'").groupBy("doc_id", "row_no", "left").count().withColumnRenamed("count", "n").collect()}
    seen = QUERIES["nearest_lane"](spark, str(tmp_path)).collect()
    assert got and {(r.doc_id, r.row_no, r.x): r.n for r in seen} == got and len(seen) == len(got)
    assert sum(r.n for r in seen if r.row_no == 0) == 40
