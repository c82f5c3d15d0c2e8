"""The current state of an ever-growing log, kept from run to run.

Working the state out anew reads the whole log each time. Here it lies in hash buckets of files; a run reads what the log
has gained, and of the state only the buckets that this touches, and writes those anew under its own number. Which
version of a bucket counts is the newest finished run that wrote it. A run that is repeated writes the same again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, store
from .runlog import latest

BUCKETS = 256


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("file"), F.lit(buckets)).cast("int"))


def _versions(spark: SparkSession, path: str, before: int | None) -> dict[int, list[int]]:
    """Finished runs that wrote a bucket, the oldest first: two at most of each bucket, as older ones are cleared away."""
    files, at = store(spark, path)
    out: dict[int, list[int]] = {}
    if not files.exists(at):
        return out
    runs = [f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith("run=")]
    for run in sorted(int(name.split("=")[1]) for name in runs):
        _, folder = store(spark, f"{path}/run={run}")
        if (before is not None and run >= before) or not files.exists(store(spark, f"{path}/run={run}/_SUCCESS")[1]):
            continue
        for f in files.listStatus(folder):
            name = f.getPath().getName()
            if name.startswith("_bucket="):
                out.setdefault(int(name.split("=")[1]), []).append(run)
    return out


def _read(spark: SparkSession, path: str, schema, versions: dict[int, list[int]], buckets: list[int]) -> DataFrame | None:
    paths = [f"{path}/run={versions[b][-1]}/_bucket={b}" for b in buckets if b in versions]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def update_latest(gained: DataFrame, path: str, run: int, buckets: int = BUCKETS) -> list[int]:
    """Take what the log has gained into the state; gives the buckets that were read and written."""
    spark = gained.sparkSession
    fresh = settle(_bucketed(latest(gained), buckets), "gained")
    # at most ``buckets`` numbers
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
    known = _versions(spark, path, run)
    held = _read(spark, path, gained.schema, known, touched)
    rows = fresh.drop("_bucket")
    state = latest(rows if held is None else held.unionByName(rows))
    _bucketed(state, buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/run={run}")
    # the version before this one stays for those who are reading it
    for bucket in touched:
        for old in known.get(bucket, [])[:-1]:
            files, at = store(spark, f"{path}/run={old}/_bucket={bucket}")
            files.delete(at, True)
    return touched


def current_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The last log row of each file, as ``latest`` gives it over the whole log."""
    known = _versions(spark, path, None)
    rows = _read(spark, path, schema, known, list(known))
    return spark.createDataFrame([], schema) if rows is None else rows
