"""The run log as a table: what is done, what is pending, the current state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .running import running


def terminal_files(log: DataFrame) -> DataFrame:
    """Distinct files whose work is finished."""
    return log.where(F.col("status").isin(*fixed.TERMINAL_STATUSES)).select("file").distinct()


FLAGS = 1 << 23  # bits of the filter over finished files: 1 MB, whatever the length of the log


def finished_flags(log: DataFrame) -> DataFrame:
    """A Bloom filter over finished files, a row per 64 bits: (_word, _bits).

    Filters of several logs, or of segments of one, are merged by ``bit_or`` of the bits of a word.
    """
    slots = [F.pmod(F.xxhash64(F.lit(seed), "file"), F.lit(FLAGS)) for seed in (1, 2)]
    done = log.where(F.col("status").isin(*fixed.TERMINAL_STATUSES)).select(F.explode(F.array(*slots)).alias("_slot"))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    return done.groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def pending(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files without a finished log row.

    What the filter does not know is surely pending and stays where it is; the rest is looked up in the log.
    """
    kept, maybe = files.columns, files
    words = finished_flags(log)
    for seed in (1, 2):
        slot = f"pmod(xxhash64({seed}, file), {FLAGS})"
        # FLAGS / 64 rows at most: 2 MB
        found = F.broadcast(words.select(F.col("_word").alias(f"_word{seed}"), F.col("_bits").alias(f"_bits{seed}")))
        maybe = maybe.withColumn(f"_word{seed}", F.expr(f"{slot} div 64")).join(found, f"_word{seed}", "left")
        bit = F.expr(f"_bits{seed} & shiftleft(1L, cast({slot} % 64 as int)) <> 0")
        maybe = maybe.withColumn(f"_known{seed}", F.coalesce(bit, F.lit(False)))
    possible = F.col("_known1") & F.col("_known2")
    sure = maybe.where(~possible).select(*kept)
    return sure.unionByName(maybe.where(possible).select(*kept).join(terminal_files(log), "file", "left_anti"))


def reprocessed(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files that are there although the log says they are finished."""
    return files.join(terminal_files(log), "file", "left_semi")


def latest(log: DataFrame) -> DataFrame:
    """The last log row per file; on a tie the larger row, so the outcome is fixed.

    An aggregate rather than a window: a file logged very often is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c not in ("file", "timestamp", "phases")]
    row = F.struct("timestamp", *rest, *(["phases"] if "phases" in log.columns else []))
    rank = F.struct("timestamp", *rest)  # maps cannot be compared
    best = log.groupBy("file").agg(F.max_by(row, rank).alias("_row"))
    return best.select("file", "_row.*").select(*log.columns)


def running_eta(log: DataFrame, run: str, seq: str, elapsed: str = "elapsed_s") -> DataFrame:
    """After each document of a run: average time so far and time left; none for the last one."""
    exact = log.withColumn("_t", F.col(elapsed).cast("decimal(20,6)"))
    counted = running(exact, [run], [seq], "done", {"_sum": "_t"})
    sizes = log.groupBy(run).agg(F.count("*").alias("total"))
    # one row per run; runs can be many, so the optimizer picks the join by measured size
    mean = F.col("_sum").cast("double") / F.col("done")
    return (
        counted.join(sizes, run)
        .where(F.col("done") < F.col("total"))
        .select(
            *log.columns,
            "done",
            "total",
            mean.alias("avg_s"),
            (mean * (F.col("total") - F.col("done"))).alias("eta_s"),
        )
    )
