"""Writing the run log and the filing manifest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requests as q
from ..operators.routing import destination


def log_rows(outcomes: DataFrame) -> DataFrame:
    """Outcomes in the shape of the run log, measures rounded as logged."""
    return outcomes.select(
        "file",
        "status",
        "suggested",
        "confidence",
        "engine",
        q.logged_cost(F.col("cost_chf")).alias("cost_chf"),
        q.logged_elapsed(F.col("elapsed_s")).alias("elapsed_s"),
        q.logged_phases(F.col("phases")).alias("phases"),
        "error_reason",
        "done_category",
        F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


def append_log(log: DataFrame, path: str) -> None:
    """Append log rows as JSON lines, one object per document."""
    log.write.mode("append").json(path)


def manifest(outcomes: DataFrame) -> DataFrame:
    """Which file goes where; moving it is up to whoever owns the store."""
    return outcomes.select(
        "file",
        "status",
        "done_category",
        destination(F.col("status"), F.col("done_category"), F.col("final_name")).alias("dest_path"),
    )


def write_manifest(rows: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """The manifest, partitioned by outcome, so one folder's moves are one read.

    Rows are brought together by folder, so that not every task writes to every folder; a folder with many of the rows is
    split again by the size of its parts, and no file has more than ``file_rows``.
    """
    dealt = rows.hint("rebalance", "status", "done_category")
    dealt.write.mode("append").option("maxRecordsPerFile", file_rows).partitionBy("status", "done_category").parquet(path)
