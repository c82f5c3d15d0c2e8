"""Reports over the run log, as tidy tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..operators.scoring import calibration, model_accuracy, model_cost, rename_quality
from ..session import settle


# money and seconds are summed as decimals: the order of the rows does not show in the result
def _cost() -> Column:
    return F.col("cost_chf").cast("decimal(28,9)")


def _time() -> Column:
    return F.col("elapsed_s").cast("decimal(28,6)")


def _timed() -> Column:
    return F.col("elapsed_s") > 0


def _domain(log: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """All values of a fixed domain with their place in the report."""
    rows = [(i, v) for i, v in enumerate(values, 1)]
    return log.sparkSession.createDataFrame(rows, f"place BIGINT, {column} STRING")


def status_distribution(log: DataFrame) -> DataFrame:
    """Count and share per status, statuses without rows included, and the total (place 5)."""
    counts = log.groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = _domain(log, "status", fixed.STATUSES).join(counts, "status", "left")
    all_rows = total.select(
        F.lit(len(fixed.STATUSES) + 1).cast("bigint").alias("place"),
        F.lit("total").alias("status"),
        F.col("total").alias("n"),
    )
    rows = known.select("place", "status", F.coalesce("n", F.lit(0)).alias("n")).unionByName(all_rows)
    return rows.select(
        "place",
        "status",
        F.col("n").cast("bigint").alias("n"),
        F.try_divide(F.col("n"), total.scalar()).alias("share"),
    )


def confidence_distribution(log: DataFrame) -> DataFrame:
    """Count per confidence, zero-filled; a missing confidence counts as n/a."""
    counts = log.groupBy(F.coalesce("confidence", F.lit("n/a")).alias("confidence")).agg(F.count("*").alias("n"))
    known = _domain(log, "confidence", fixed.CONFIDENCES).join(counts, "confidence", "left")
    return known.select("place", "confidence", F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(log: DataFrame) -> DataFrame:
    filled = log.where("done_category IS NOT NULL AND done_category <> ''")
    return filled.groupBy("done_category").agg(F.count("*").alias("n")).orderBy("done_category")


def error_reasons(log: DataFrame) -> DataFrame:
    filled = log.where("error_reason IS NOT NULL AND error_reason <> ''")
    return filled.groupBy("error_reason").agg(F.count("*").alias("n")).orderBy("error_reason")


def timing_stats(log: DataFrame) -> DataFrame:
    """Over rows with a time above zero; NULL minimum and maximum, zero average without any."""
    return log.where(_timed()).agg(
        F.min("elapsed_s").alias("min_s"),
        F.max("elapsed_s").alias("max_s"),
        F.coalesce(F.sum(_time()).cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_s"),
        F.coalesce(F.sum(_time()).cast("double"), F.lit(0.0)).alias("total_s"),
    )


def phase_stats(log: DataFrame) -> DataFrame:
    seconds = log.select(F.explode("phases").alias("phase", "s")).where("s IS NOT NULL")
    exact = F.sum(F.col("s").cast("decimal(28,6)")).cast("double")
    return (
        seconds.groupBy("phase")
        .agg(
            F.min("s").alias("min_s"),
            F.max("s").alias("max_s"),
            (exact / F.count("*")).alias("avg_s"),
            exact.alias("total_s"),
        )
        .orderBy("phase")
    )


def cost_totals(log: DataFrame) -> DataFrame:
    """Total cost and cost per row, rows without cost included."""
    total = F.coalesce(F.sum(_cost()).cast("double"), F.lit(0.0))
    return log.agg(total.alias("total_chf"), F.try_divide(total, F.count("*")).alias("avg_chf"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of a run; whatever is none of the first three statuses was skipped."""
    status = F.col("status")
    three = fixed.TERMINAL_STATUSES
    exact = F.sum(_time()).cast("double")
    return outcomes.agg(
        F.count("*").alias("processed"),
        *[F.count_if(status == s).alias(s) for s in three],
        F.count_if(~F.coalesce(status, F.lit("")).isin(*three)).alias("skipped"),
        F.coalesce(F.sum(_cost()).cast("double"), F.lit(0.0)).alias("total_chf"),
        exact.alias("total_s"),
        (exact / F.nullif(F.count("*"), F.lit(0))).alias("avg_s"),
    )


def outcome_counters(log: DataFrame) -> DataFrame:
    """Rows per engine and status."""
    return log.groupBy("engine", "status").agg(F.count("*").alias("n"))


def run_report(log: DataFrame, expectations: DataFrame | None = None) -> DataFrame:
    """The report of a run as (section, key, metric, value).

    One pass reduces the log to its distinct combinations of status, confidence, topic and
    error; all sections but the phases are made from that small table.
    """
    small = log.groupBy(
        "status",
        F.coalesce("confidence", F.lit("n/a")).alias("confidence"),
        F.coalesce("done_category", F.lit("")).alias("category"),
        F.coalesce("error_reason", F.lit("")).alias("error"),
    ).agg(
        F.count("*").alias("n"),
        F.sum(_cost()).alias("cost"),
        F.count_if(_timed()).alias("n_timed"),
        F.min(F.when(_timed(), F.col("elapsed_s"))).alias("min_s"),
        F.max(F.when(_timed(), F.col("elapsed_s"))).alias("max_s"),
        F.sum(F.when(_timed(), _time())).alias("sum_s"),
    )
    places = [("status", F.col("status")), ("confidence", F.col("confidence")),
              ("category", F.col("category")), ("error", F.col("error")), ("run", F.lit("all"))]
    spread = small.select(
        "n", "cost", "n_timed", "min_s", "max_s", "sum_s",
        F.inline(F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in places])),
    ).where("key <> ''")
    fixed_keys = [("status", s) for s in fixed.STATUSES] + [("confidence", c) for c in fixed.CONFIDENCES]
    empty = log.sparkSession.createDataFrame([(*k, 0) for k in fixed_keys], "section STRING, key STRING, n BIGINT")
    sections = (
        spread.unionByName(empty, allowMissingColumns=True)
        .groupBy("section", "key")
        .agg(
            F.sum("n").alias("n"),
            F.sum("cost").cast("double").alias("cost"),
            F.sum("n_timed").alias("n_timed"),
            F.min("min_s").alias("min_s"),
            F.max("max_s").alias("max_s"),
            F.coalesce(F.sum("sum_s").cast("double"), F.lit(0.0)).alias("sum_s"),
        )
    )
    known = F.col("key").isin(*fixed.STATUSES, *fixed.CONFIDENCES) | ~F.col("section").isin("status", "confidence")
    sections = sections.where(known)
    # over the finished sections: a few dozen rows, whatever the size of the log
    total = F.max(F.when(F.col("section") == "run", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    n = F.col("n").cast("double")

    def metric(when, name, value):
        return F.struct(
            F.when(when, F.lit(name)).alias("metric"), value.cast("double").alias("value")
        )

    is_run, is_status = F.col("section") == "run", F.col("section") == "status"
    metrics = F.array(
        metric(F.lit(True), "n", n),
        metric(is_status, "share", F.try_divide(n, F.col("total"))),
        metric(is_run, "min_s", F.col("min_s")),
        metric(is_run, "max_s", F.col("max_s")),
        metric(is_run, "avg_s", F.coalesce(F.try_divide(F.col("sum_s"), F.col("n_timed")), F.lit(0.0))),
        metric(is_run, "total_s", F.col("sum_s")),
        metric(is_run, "total_chf", F.col("cost")),
        metric(is_run, "avg_chf", F.try_divide(F.col("cost"), F.col("n"))),
    )
    report = (
        sections.withColumn("total", total)
        .select("section", "key", F.inline(F.filter(metrics, lambda m: m["metric"].isNotNull())))
        .unionByName(_rows(phase_stats(log), "phase", "phase"))
    )
    if expectations is not None:
        report = report.unionByName(
            _rows(rename_quality(log, expectations).withColumn("key", F.lit("all")), "quality", "key")
        )
    return report


def _rows(df: DataFrame, section: str, key: str) -> DataFrame:
    """A wide table as metric rows."""
    names = [c for c in df.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(F.lit(section).alias("section"), F.col(key).alias("key"), F.inline(pairs))


def eval_report(results: DataFrame) -> DataFrame:
    """The comparison of models as (section, key, metric, value); the results are worked out once."""
    results = settle(results, "results")
    return (
        _rows(model_accuracy(results), "accuracy", "model")
        .unionByName(_rows(calibration(results), "calibration", "model"))
        .unionByName(_rows(model_cost(results), "cost", "model"))
    )
