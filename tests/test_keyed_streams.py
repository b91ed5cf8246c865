"""Streams with state per key over several input files: the hour of an upload, late movements, and state that goes away."""

import datetime as dt
import os

from balanza.streaming import keyed

START = dt.datetime(2024, 5, 1, 8, 0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run_files(spark, tmp_path, schema, batches, stream):
    """Rows given out for each input file, and the state rows after each micro-batch."""
    keyed.keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, seen = tmp_path / "in", {}
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        os.makedirs(source, exist_ok=True)
        part = next(p for p in (tmp_path / f"w{i}").iterdir() if p.suffix == ".parquet")
        target = source / f"f{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream(files).writeStream.foreachBatch(lambda df, n: seen.__setitem__(n, [tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return [seen.get(i, []) for i in sorted(seen)], [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_an_upload_counts_again_after_an_hour(spark, tmp_path):
    batches = [
        [(1, "a", at(0)), (1, "a", at(5)), (2, "a", at(6)), (1, "b", at(7))],
        [(1, "a", at(60)), (1, "b", at(50))],  # an hour is not over
        [(1, "a", at(61)), (2, "c", at(400))],
        [(2, "c", at(405)), (1, "b", at(410))],
    ]
    got, state = run_files(spark, tmp_path, "job_id long, hash string, ts timestamp", batches, keyed.stream_first_sights)
    minutes = [sorted((j, h, int((t - START).total_seconds() // 60)) for j, h, t in rows) for rows in got]
    assert minutes[:4] == [[(1, "a", 0), (1, "b", 7), (2, "a", 6)], [], [(1, "a", 61), (2, "c", 400)], [(1, "b", 410)]]
    assert max(state) > state[-1]  # keys of the morning have left


def test_a_late_movement_corrects_the_balances_after_it(spark, tmp_path):
    batches = [
        [("d", "m1", at(0), 10.0, 10.0), ("d", "m3", at(20), 5.0, 22.0), ("e", "x1", at(1), 1.0, None)],
        [("d", "m2", at(10), 7.0, 17.0)],  # late, within the limit
        [("d", "m4", at(60 * 24 * 9), -2.0, 20.0)],
        [("d", "m5", at(60 * 24 * 9 + 1), 1.0, 21.0)],
    ]
    got, state = run_files(
        spark, tmp_path, "doc_id string, mov_id string, ts timestamp, change double, balance double", batches, lambda files: keyed.stream_balance_corrected(files, late="2 days")
    )
    rows = [sorted(r) for r in got if r]
    assert rows[0] == [("d", "m1", 1000, False, False), ("d", "m3", 1500, True, False), ("e", "x1", 100, True, False)]
    assert rows[1] == [("d", "m2", 1700, False, False), ("d", "m3", 2200, False, True)]
    assert rows[2] == [("d", "m4", 2000, False, False)] and rows[3] == [("d", "m5", 2100, False, False)]
    assert state[-1] < max(state)  # settled movements are one number
