"""Gated running sums: a row counts only while fewer rows than its gate have counted before it.

Whether a row counts depends on all rows before it, yet it can be worked out in parallel. From a number ``m`` of rows
that counted before a run of rows, the run makes ``m + (how many of its thresholds are above m)``: one threshold per
row, all different. The threshold of the first row is its gate; that of a later one is the smallest ``m`` from which
the rows before it in the run reach its gate. So

* runs, one per range partition, find their thresholds one row after the other, each run on its own;
* two neighbouring runs become one by carrying the thresholds of the second one back through the first: a rank among
  its thresholds, hence a running sum over the rows of both;
* after a doubling for each bit of the number of partitions, every threshold is one for the whole group, and a row counts
  if it is above zero.

No group is ever in one place; a group with most of the rows is spread like any other.
"""

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .running import running

CHUNK = 2048


class Thresholds:
    """The thresholds of a run, sorted, in chunks that stay short."""

    def __init__(self) -> None:
        self.chunks: list[list[int]] = []
        self.n = 0

    def add(self, gate: int) -> int:
        """The smallest number from which the rows so far reach ``gate``; it is the next row's threshold."""
        above, found = self.n, None
        for chunk in self.chunks:
            above -= len(chunk)
            # what is reached from just a threshold: itself and the thresholds above it
            if chunk[-1] + above >= gate:
                found = gate - (above + len(chunk) - bisect_left(range(len(chunk)), gate, key=lambda k: chunk[k] + above + len(chunk) - 1 - k))
                break
        if found is None:
            found = gate
        at = next((k for k, chunk in enumerate(self.chunks) if chunk[-1] >= found), len(self.chunks) - 1)
        if not self.chunks:
            self.chunks.append([found])
        else:
            insort(self.chunks[at], found)
            if len(self.chunks[at]) > CHUNK:
                half = len(self.chunks[at]) // 2
                self.chunks[at : at + 1] = [self.chunks[at][:half], self.chunks[at][half:]]
        self.n += 1
        return found


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Thresholds within runs: the rows of a group in this partition, which come sorted."""
    run, known = None, Thresholds()
    for batch in batches:
        out = []
        for group, gate in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if group != run:
                run, known = group, Thresholds()
            out.append(known.add(gate))
        columns = [*batch.columns[2:], pa.array(out, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[2:], "_threshold"])


def _through(rows: DataFrame, groups: list[str], order: list[str], level: int) -> DataFrame:
    """Thresholds of every second block of runs, carried back through the block before it."""
    pair = [*groups, "_pair"]
    blocks = rows.withColumns({"_pair": F.expr(f"shiftright(_run, {level + 1})"), "_second": F.expr(f"shiftright(_run, {level}) & 1")})
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    first = running(blocks.where("_second = 0").withColumn("_down", -F.col("_threshold")), pair, ["_down"], ordinal="_above")
    # what is reached from just a threshold, from the greatest down
    first = first.select(*pair, (-(F.col("_threshold") + F.col("_above") - 1)).alias("_at"), F.lit(0).alias("_side"), one.alias("_one"))
    second = blocks.where("_second = 1").withColumns({"_at": -F.col("_threshold"), "_side": F.lit(1), "_one": zero})
    both = second.unionByName(first, allowMissingColumns=True)
    counted = running(both, pair, ["_at", "_side", *order], totals={"_reached": "_one"})
    moved = counted.where("_side = 1").withColumn("_threshold", F.col("_threshold") - F.col("_reached"))
    return settle(blocks.where("_second = 0").select(*rows.columns).unionByName(moved.select(*rows.columns)), "thresholds")


def gated(df: DataFrame, groups: list[str], order: list[str], gate: str, into: str = "counts", partitions: int | None = None) -> DataFrame:
    """Add whether each row counts; ``order`` tells the rows of a group apart, ``gate`` is a bigint.

    The rows are dealt to ranges, ``partitions`` of them or as many as the session takes.
    """
    kept, by = df.columns, [F.col(c) for c in [*groups, *order]]
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *by).sortWithinPartitions(*by)
    fed = dealt.select(F.to_json(F.struct(*groups)).alias("_of"), F.col(gate).alias("_gate"), *kept, F.spark_partition_id().alias("_run"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.schema.fields[2:])
    rows = settle(fed.mapInArrow(_in_runs, f"{fields}, _threshold bigint"), "thresholds")
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    level = 0
    while 1 << level < runs:
        rows = _through(rows, groups, order, level)
        level += 1
    return rows.select(*kept, (F.col("_threshold") > 0).alias(into))
