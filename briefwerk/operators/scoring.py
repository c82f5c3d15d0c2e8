"""Scoring extractions against expectations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import field_match, quality_key


def score_fields(df: DataFrame) -> DataFrame:
    """Add sender_ok, content_ok, date_ok (NULL where nothing is expected) and all_ok.

    Reads sender, content, date and sender_any, content_any, exp_date.
    """
    scored = df.withColumns(
        {
            "sender_ok": field_match(F.col("sender"), F.col("sender_any")),
            "content_ok": field_match(F.col("content"), F.col("content_any")),
            "date_ok": F.when(
                F.coalesce("exp_date", F.lit("")) != "", F.col("date").eqNullSafe(F.col("exp_date"))
            ),
        }
    )
    checked = [F.col("sender_ok"), F.col("content_ok"), F.col("date_ok")]
    any_checked = F.coalesce(*checked).isNotNull()
    none_wrong = F.lit(True)
    for ok in checked:
        none_wrong = none_wrong & F.coalesce(ok, F.lit(True))
    return scored.withColumn("all_ok", any_checked & none_wrong)


def model_accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Accuracy per model: field rates over scored rows, all-fields rate over all rows."""
    scored = F.col("error").isNull()

    def rate(column: str) -> Column:
        return (F.avg(F.when(scored, F.col(column).cast("int"))) * 100).alias(f"{column[:-3]}_pct")

    n_ok = F.count_if(scored & F.col("all_ok"))
    return results.groupBy(*(by or ("model",))).agg(
        rate("sender_ok"),
        rate("content_ok"),
        rate("date_ok"),
        F.when(F.count_if(scored) > 0, n_ok / F.count("*") * 100).alias("all_pct"),
        n_ok.alias("n_all_ok"),
        F.count_if(~scored).alias("errors"),
        F.avg(F.when(scored, F.col("time_s"))).alias("avg_time_s"),
        F.count_if(scored).alias("evaluated"),
        F.count("*").alias("cases"),
    )


def calibration(results: DataFrame, *by: str) -> DataFrame:
    """How often "high" is right, and anything else; NULL for a model without a scored row."""
    scored = F.col("error").isNull()
    high = scored & F.col("confidence").eqNullSafe("high")
    low = scored & ~F.col("confidence").eqNullSafe("high")
    right = F.col("all_ok").cast("int")
    any_scored = F.count_if(scored) > 0

    def share(of: Column) -> Column:
        return F.when(any_scored, F.coalesce(F.avg(F.when(of, right)) * 100, F.lit(0.0)))

    return results.groupBy(*(by or ("model",))).agg(
        F.when(any_scored, F.count_if(high) / F.count_if(scored) * 100).alias("high_rate_pct"),
        share(high).alias("high_correct_pct"),
        share(low).alias("low_correct_pct"),
    )


def model_cost(results: DataFrame, label_part: str = fixed.CLOUD) -> DataFrame:
    """Cost of the first model whose label contains ``label_part``; no row if none was scored.

    ``model_no`` gives the order of the models.
    """
    matching = results.where(F.contains(F.col("model"), F.lit(label_part)))
    scored = F.col("error").isNull()
    per_model = matching.groupBy("model_no", "model").agg(
        F.sum(F.when(scored, F.col("cost_chf").cast("decimal(20,9)"))).cast("double").alias("total_chf"),
        F.count_if(scored).alias("n"),
    )
    first = per_model.agg(F.min_by(F.struct("model", "total_chf", "n"), "model_no").alias("m"))
    return first.select("m.*").where("n > 0").select(
        "model", "total_chf", (F.col("total_chf") / F.col("n")).alias("avg_chf")
    )


def rename_quality(log: DataFrame, expectations: DataFrame) -> DataFrame:
    """Renamed files against expected sender, content and date; no row if no file is expected."""
    rows = log.join(expectations, "file").withColumn("_key", quality_key(F.col("suggested")))

    def any_in_key(column: str) -> Column:
        return F.exists(F.col(column), lambda v: F.contains(F.col("_key"), quality_key(v)))

    match = (
        (F.col("status") == "renamed")
        & any_in_key("sender_any")
        & any_in_key("content_any")
        & F.contains(F.col("_key"), F.col("exp_date"))
    )
    counted = rows.agg(
        F.count("*").alias("evaluated"),
        F.count_if(match).alias("matches"),
        F.count_if(F.col("confidence") == "high").alias("high_conf"),
    )
    return counted.where("evaluated > 0").select(
        "evaluated",
        "matches",
        (F.col("matches") / F.col("evaluated")).alias("match_rate"),
        "high_conf",
        (F.col("high_conf") / F.col("evaluated")).alias("high_conf_rate"),
        F.lit(fixed.HIGH_CONFIDENCE_TARGET).alias("target_high_conf_rate"),
    )
