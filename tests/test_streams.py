"""Streams over many batches: counters kept as a log of changes, deliveries told apart by state that leaves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from briefwerk.session import fresh_path
from briefwerk.streaming import deliveries, jobs

SCHEMA = "engine string, status string, k int"


@pytest.fixture
def folder(spark):
    """Twenty-three files, one after the other."""
    path = fresh_path(spark, "in")
    for k in range(23):
        rows = spark.range(5).select(
            F.concat(F.lit("e"), (F.col("id") + k) % 3).alias("engine"), F.when(F.col("id") > 3, None).otherwise(F.lit("s")).alias("status"), F.lit(k).alias("k")
        )
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


def counted(spark, folder):
    return Counter((r.engine, r.status) for r in spark.read.parquet(folder).collect())


def test_counters_stay_bounded_and_batches_may_be_repeated(spark, folder):
    path = fresh_path(spark, "counters")
    stream = jobs.table_stream(spark, folder, "*.parquet", SCHEMA, files_per_batch=1)
    jobs.keep_counters(jobs.outcome_counts(stream), path, fresh_path(spark, "check"), every=4).awaitTermination()

    def held():
        return {(r.engine, r.status): r.n for r in jobs.current_counters(spark, path).collect()}

    assert held() == counted(spark, folder)
    assert len(jobs._written(spark, f"{path}/snapshot")) <= 2 and len(jobs._written(spark, f"{path}/delta")) <= 8
    # the last batch once more, and one that ends in a snapshot
    last = jobs._written(spark, f"{path}/delta")[-1]
    again = spark.createDataFrame(
        spark.read.parquet(f"{path}/delta/batch={last}").collect(), "engine string, status string, n bigint"
    )
    jobs.write_changes(again, last, path, every=4)
    assert held() == counted(spark, folder)
    snapshot = jobs._written(spark, f"{path}/snapshot")[-1]
    same = spark.createDataFrame(spark.read.parquet(f"{path}/delta/batch={snapshot}").collect(), "engine string, status string, n bigint") \
        if snapshot in jobs._written(spark, f"{path}/delta") else None
    if same is not None:
        jobs.write_changes(same, snapshot, path, every=4)
        assert held() == counted(spark, folder)


def test_state_of_deliveries_leaves_and_late_rows_are_told(spark):
    folder, path = fresh_path(spark, "log"), fresh_path(spark, "told")
    batches = [
        [(1, "a", 0), (2, "b", 1), (3, "a", 2)],
        [(4, "a", 9), (5, "c", 40)],  # "a" again after its window
        [(6, "b", 1), (7, "b", 60), (8, "c", 43)],  # the first one is late by now
        [(9, "d", 200)],
        [(10, "e", 400)],
    ]
    for rows in batches:
        made = spark.createDataFrame(rows, "id bigint, file string, h int")
        made.selectExpr("id", "file", "timestamp_seconds(1700000000 + h * 3600) as ts").coalesce(1).write.mode("append").parquet(folder)
    log = jobs.table_stream(spark, folder, "*.parquet", "id bigint, file string, ts timestamp", files_per_batch=1)
    query = deliveries.append_deliveries(deliveries.deliveries(log, "id", within="5 hours", late="4 hours"), path, fresh_path(spark, "check"))
    query.awaitTermination()
    kinds = {r.id: r.kind for r in spark.read.parquet(path).collect()}
    assert kinds == {1: "first", 2: "first", 3: "copy", 4: "first", 5: "first", 6: "late", 7: "first", 8: "copy", 9: "first", 10: "first"}
    # of five files those are left whose window the watermark has not passed
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_files_share_the_state_of_a_bucket(spark):
    folder, path = fresh_path(spark, "log"), fresh_path(spark, "told")
    for k in range(2):
        rows = spark.range(300).selectExpr(f"id + {300 * k} as id", "concat('f', id) as file", f"timestamp_seconds(1700000000 + {k} * 60 + id) as ts")
        rows.coalesce(1).write.mode("append").parquet(folder)
    log = jobs.table_stream(spark, folder, "*.parquet", "id bigint, file string, ts timestamp", files_per_batch=1)
    query = deliveries.append_deliveries(deliveries.deliveries(log, "id", buckets=8), path, fresh_path(spark, "check"))
    query.awaitTermination()
    told = Counter((r.kind, r.id < 300) for r in spark.read.parquet(path).collect())
    assert told == {("first", True): 300, ("copy", False): 300}
    # one call into Python and one state per bucket, not per file
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_state_over_runs_equals_the_whole_log_and_reads_little(spark):
    from briefwerk.operators import latest
    from briefwerk.operators.runlog import latest as whole

    schema = "file string, timestamp string, status string"
    path = fresh_path(spark, "state")
    logs = [[(f"f{k}", f"2024-01-{run + 1:02d}", f"s{run}") for k in range(0, 300, step)] for run, step in enumerate((1, 70, 90, 110))]
    logs[2].append(("f7", "2023-12-31", "older"))
    touched = [latest.update_latest(spark.createDataFrame(rows, schema), path, run) for run, rows in enumerate(logs)]
    assert len(touched[0]) > 150 and all(len(t) < 8 for t in touched[1:])

    def state():
        return sorted(map(tuple, latest.current_state(spark, path, schema).collect()))

    wanted = sorted(map(tuple, whole(spark.createDataFrame(sum(logs, []), schema)).collect()))
    assert state() == wanted
    # the last run once more
    latest.update_latest(spark.createDataFrame(logs[3], schema), path, 3)
    assert state() == wanted


def test_pending_files_are_those_without_a_finished_row(spark):
    from briefwerk.operators.runlog import pending

    log = spark.createDataFrame([(f"f{k}", "renamed" if k % 2 else "skipped") for k in range(200)], "file string, status string")
    inbox = spark.createDataFrame([(f"f{k}", k) for k in range(0, 400, 3)] + [(None, -1)], "file string, n int")
    want = {k for k in range(0, 400, 3) if k >= 200 or k % 2 == 0} | {-1}
    assert {r.n for r in pending(inbox, log).collect()} == want
    assert pending(inbox, log.limit(0)).count() == inbox.count()
