"""Deliveries told apart on arrival: the first one of a file, copies of it, and those that come too late to tell.

A file's first delivery is remembered until no copy of it can come any more: for ``within`` after it, by the
watermark. Then the next rows of its bucket or a timer drop it, so the state holds the files of the last while and not
all there ever were. What is
later than the watermark is not dropped silently but passed on as such, so that nothing is lost without a count.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FIRST, COPY, LATE = "first", "copy", "late"
BUCKETS = 1024  # files share a bucket's state; more of them for more files within the window
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Deliveries(StatefulProcessor):
    """State of a bucket of files: when the first delivery of each was, in milliseconds."""

    def __init__(self, within_ms: int) -> None:
        self.within = within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "files array<string>, at array<bigint>")

    def _known(self) -> dict:
        files, at = self.first.get() if self.first.exists() else ((), ())
        return dict(zip(files, at))

    def _keep(self, known: dict, passed: int, timer: int | None) -> None:
        """Remember what a copy can still come of, with one timer for the last of it."""
        known = {file: at for file, at in known.items() if at + self.within > passed}
        if timer is not None:
            self.handle.deleteTimer(timer)
        if known:
            self.first.update((list(known), list(known.values())))
            self.handle.registerTimer(max(known.values()) + self.within)
        elif timer is not None:
            self.first.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # a bucket's rows of one batch; what its files had in earlier ones is one number each
        come = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        known = self._known()
        timer, kinds = max(known.values()) + self.within if known else None, []
        for file, at in zip(come["file"].tolist(), come["ms"].tolist()):
            before = known.get(file)
            if at <= passed:
                kinds.append(LATE)
            elif before is not None and at <= before + self.within:
                kinds.append(COPY)
            else:
                kinds.append(FIRST)
                known[file] = at
        self._keep(known, passed, timer)
        yield pd.DataFrame({"file": come["file"], "id": come["id"], "kind": pd.Series(kinds, index=come.index, dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        yield pd.DataFrame({"file": pd.Series([], dtype=str), "id": pd.Series([], dtype="int64"), "kind": pd.Series([], dtype=str)})

    def close(self) -> None:
        pass


def deliveries(
    log: DataFrame, id: str, ts: str = "ts", within: str = "2 hours", late: str = "2 hours", key: str = "file", buckets: int = BUCKETS
) -> DataFrame:
    """(file, id, kind) of a stream of deliveries, one row per delivery; ``id`` orders those of a moment.

    A delivery is late if it is not after the watermark: the latest moment of all batches before, less ``late``. Files share
    the state of a bucket, so a batch calls into Python once per bucket, not once per file; a checkpoint keeps its ``buckets``.
    """
    seconds = log.sparkSession.range(1).selectExpr(f"cast(interval {within} as interval second) as s").first().s.total_seconds()
    moment = F.col(ts).cast("timestamp")
    # the watermark's own column stays behind, as rows before it would be dropped before they are seen
    timed = log.select(F.col(key).alias("file"), F.col(id).cast("bigint").alias("id"), F.unix_millis(moment).alias("ms"), moment.alias("_ts"))
    bucket = F.pmod(F.xxhash64("file"), F.lit(buckets)).alias("bucket")
    marked = timed.withWatermark("_ts", late).select(bucket, "file", "id", "ms")
    return marked.groupBy("bucket").transformWithStateInPandas(
        _Deliveries(int(seconds * 1000)), "file string, id bigint, kind string", "Append", "EventTime"
    )


def append_deliveries(told: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over everything available and append the rows to a table."""
    spark = told.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return (
            told.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
    finally:
        # the query keeps the settings that it was started with
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
