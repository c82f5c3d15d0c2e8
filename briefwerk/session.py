"""Session settings and the shared folder for intermediate tables."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.briefwerk.spreadInput"


def local_session(cpus: str = "8", app: str = "briefwerk") -> SparkSession:
    """A local session with the settings the jobs expect; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # text work is bound by the processor, and one small file with a single row group makes one task
        .config(SPREAD, "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder for intermediate tables, below one that all executors can reach.

    That is ``spark.checkpoint.dir``, or the checkpoint folder that was set, or else, in a local session, the warehouse.
    The folder goes when the session's JVM ends; the tables in it are of use to this session only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/briefwerk-work-{spark.sparkContext.applicationId}"
    if path not in _WORK:
        _WORK.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


_WORK: set[str] = set()


def store(spark: SparkSession, path: str):
    """(file system, path) of the store that Spark reads there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark makes no method for a stage that the JVM would leave uncompiled for its size.

    The JVM interprets methods of over 8,000 bytes, several times slower. Long projections become such methods.
    """
    before = spark.conf.get(_METHOD_LIMIT, None)
    spark.conf.set(_METHOD_LIMIT, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_METHOD_LIMIT)
        else:
            spark.conf.set(_METHOD_LIMIT, before)


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; dealt out to all cores if the session says so.

    Only sessions over a few small files should: on large tables the shuffle costs more than it gives.
    """
    table = spark.read.parquet(path)
    if spark.conf.get(SPREAD, "false") != "true":
        return table
    return table.repartition(spark.sparkContext.defaultParallelism)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lost executors then cost a re-read instead of a recomputation, and later passes
    read only the columns they need.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
