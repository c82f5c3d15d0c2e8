"""Comparing models on a corpus with known answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import requests as q
from ..functions.text import is_blank, letter_date
from ..operators.redact import redact
from ..operators.scoring import score_fields


def model_labels(local_models: list[str], cloud_model: str | None = None) -> list[tuple[int, str, str]]:
    """(number, label, engine) per model, local ones first."""
    named = [(m, fixed.LOCAL) for m in local_models]
    if cloud_model:
        named.append((cloud_model, fixed.CLOUD))
    return [(i, f"{m} ({engine})", engine) for i, (m, engine) in enumerate(named, 1)]


def allowed_grid(cases: DataFrame, models: list[tuple[int, str, str]]) -> DataFrame:
    """Cases times models; cloud models only if every case is marked safe for them."""
    listed = F.array(
        *[
            F.struct(F.lit(n).alias("model_no"), F.lit(label).alias("model"), F.lit(engine).alias("engine"))
            for n, label, engine in models
        ]
    )
    all_safe = cases.agg(F.coalesce(F.bool_and("cloud_safe"), F.lit(False))).scalar()
    grid = cases.select("*", F.inline(listed))
    return grid.where((F.col("engine") != fixed.CLOUD) | all_safe)


def evaluate(
    cases: DataFrame,
    texts: DataFrame,
    responses: DataFrame,
    models: list[tuple[int, str, str]],
    blocklist: tuple[str, ...] = (),
) -> DataFrame:
    """One result row per model and case.

    ``texts`` holds (file, text); ``responses`` (file, model, response, input_tokens,
    output_tokens, time_s, error), one row per answered request.
    """
    prepared = redact(texts.select("file", "text"), "text", blocklist).select(
        "file",
        is_blank(F.col("text")).alias("_blank"),
        letter_date(F.col("redacted_text")).alias("_hint"),
    )
    grid = allowed_grid(cases.join(prepared, "file"), models)
    answered = grid.join(responses, ["file", "model"], "left").withColumn(
        "_answer", q.parse_response(F.col("response"))
    )
    local = F.col("engine") == fixed.LOCAL
    parsed = answered.withColumns(
        {
            "_error": F.when(F.col("_blank"), F.lit("no-text"))
            .when(F.col("error").isNotNull(), F.substring("error", 1, 100))
            .otherwise(F.col("_answer.error")),
            "sender": F.col("_answer.sender"),
            "content": F.col("_answer.content"),
            "date": F.when(local, q.with_date_hint(F.col("_answer.date"), F.col("_hint"))).otherwise(
                F.col("_answer.date")
            ),
        }
    )
    scored = score_fields(parsed)
    fine = F.col("_error").isNull()
    cost = q.token_cost_chf(F.col("input_tokens"), F.col("output_tokens"))
    return scored.select(
        "model_no",
        "model",
        "file",
        *[F.when(fine, F.col(c)).alias(c) for c in ("sender_ok", "content_ok", "date_ok", "all_ok")],
        F.when(fine, F.col("_answer.confidence")).alias("confidence"),
        F.when(fine, F.coalesce("time_s", F.lit(0.0))).otherwise(F.lit(0.0)).alias("time_s"),
        F.when(fine & ~local, F.coalesce(cost, F.lit(0.0))).otherwise(F.lit(0.0)).alias("cost_chf"),
        F.col("_error").alias("error"),
    )
