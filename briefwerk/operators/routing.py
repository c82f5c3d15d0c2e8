"""From an analysed letter to its outcome."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import redaction as r
from ..functions import requests as q
from ..functions.once import once
from ..functions.text import is_blank, letter_date, proposed_name, safe_filename, strip

# what an analysed letter brings along; further columns pass through
LETTER_COLUMNS = (
    "file", "engine", "text", "redacted_text", "anonymized_text", "read_message", "read_type",
    "analysis_message", "analysis_type", "response", "input_tokens", "output_tokens",
)


def _no_text_in_hybrid() -> Column:
    # the engine reports this as "Scan-PDFs are not supported"
    return F.concat(F.lit("analyse:"), F.lit("pdf-read-error"))


def route(df: DataFrame) -> DataFrame:
    """Add status, confidence, error_reason, proposed_name, cost_chf, the parsed fields, and the last step reached.

    ``proposed_name`` is NULL unless the letter is renamed. ``reached`` is ``read`` for letters that stop before
    anything is taken from their text, ``checked`` for those that stop at the leak check, else ``extracted``.
    """
    kept = df.columns
    engine = F.col("engine")
    hybrid, local = engine == fixed.HYBRID, engine == fixed.LOCAL

    def with_date(answer: Column) -> Column:
        # the redacted text is searched, and unless it is kept made, only where the model gave no usable date
        hint = F.when(local & q.takes_date_hint(answer["date"]), letter_date(F.col("redacted_text")))
        # named: Spark makes the text where it is used only as long as it is used in one place
        date = once(hint, lambda h: q.with_date_hint(answer["date"], h))
        return F.struct(answer.alias("answer"), date.alias("date"))

    staged = df.withColumns(
        {
            "_blank": is_blank(F.col("text")),
            "_leaks": F.when(hybrid, r.leak_labels(F.coalesce("anonymized_text", F.lit("")))),
            "_analysed": once(q.parse_response(F.col("response")), with_date),
        }
    ).withColumns(
        {
            "_answer": F.col("_analysed.answer"),
            "_date": F.col("_analysed.date"),
            "_read_class": q.error_class(F.col("read_message"), F.col("read_type")),
            "_analysis_class": F.when(
                F.col("analysis_message").isNotNull(),
                q.error_class(F.col("analysis_message"), F.col("analysis_type")),
            ).otherwise(F.col("_analysed.answer.error")),
        }
    )
    # the first reason that applies decides
    error = (
        F.when(
            F.col("read_message").isNotNull(),
            F.concat(F.when(hybrid, F.lit("analyse:")).otherwise(F.lit("lesen:")), F.col("_read_class")),
        )
        .when(hybrid & F.col("_blank"), _no_text_in_hybrid())
        .when((engine == fixed.CLOUD) & F.col("_blank"), F.lit("review"))
        .when(hybrid & (F.col("_leaks") != ""), F.lit("review"))
        .when(F.col("_analysis_class").isNotNull(), F.concat(F.lit("analyse:"), F.col("_analysis_class")))
        .otherwise(F.lit(""))
    )
    decided = staged.withColumn("_stop", error).withColumn(
        "status",
        F.when(F.col("_stop") == "review", F.lit("review"))
        .when(F.col("_stop") != "", F.lit("skipped"))
        .when(F.col("_answer.confidence") == "low", F.lit("unrecognized"))
        .otherwise(F.lit("renamed")),
    )
    status = F.col("status")
    early = F.col("read_message").isNotNull() | (engine.isin(fixed.HYBRID, fixed.CLOUD) & F.col("_blank"))
    analysed = status.isin("renamed", "unrecognized")
    cost = q.token_cost_chf(F.col("input_tokens"), F.col("output_tokens"))
    return decided.select(
        *kept,
        "status",
        F.when(status == "renamed", F.lit("high"))
        .when(status == "unrecognized", F.lit("low"))
        .otherwise(F.lit("n/a"))
        .alias("confidence"),
        F.when(status == "skipped", F.col("_stop")).otherwise(F.lit("")).alias("error_reason"),
        F.when(
            status == "renamed",
            proposed_name(F.col("_answer.sender"), F.col("_answer.content"), F.col("_date")),
        ).alias("proposed_name"),
        F.when(analysed & ~local, F.coalesce(cost, F.lit(0.0))).otherwise(F.lit(0.0)).alias("cost_chf"),
        F.when(analysed, F.col("_answer.sender")).alias("sender"),
        F.when(analysed, F.col("_answer.content")).alias("content"),
        F.when(analysed, F.col("_date")).alias("date"),
        F.when(
            status == "unrecognized",
            q.uncertain_fields(F.col("_answer.sender"), F.col("_answer.content"), F.col("_date")),
        ).alias("uncertain_reason"),
        F.when(early, F.lit("read"))
        .when(hybrid & (F.col("_leaks") != ""), F.lit("checked"))
        .otherwise(F.lit("extracted"))
        .alias("reached"),
    )


def decide_by_hand(routed: DataFrame, answer: Column) -> DataFrame:
    """What a person made of the proposed names: nothing (NULL) accepts, a blank answer skips, any other renames.

    A letter skipped by hand keeps its proposal and its high confidence; a typed name is made portable.
    """
    asked, typed = F.col("status") == "renamed", strip(answer)
    skipped = asked & answer.isNotNull() & (typed == "")
    return routed.withColumns(
        {
            "status": F.when(skipped, F.lit("skipped")).otherwise(F.col("status")),
            "error_reason": F.when(skipped, F.lit("manual-skip")).otherwise(F.col("error_reason")),
            "proposed_name": F.when(asked & (typed != ""), safe_filename(F.concat(typed, F.lit(fixed.SUFFIX)))).otherwise(
                F.col("proposed_name")
            ),
        }
    )


def may_leave(df: DataFrame) -> DataFrame:
    """Privacy gate: only letters with text, and without a known leak in what would be sent."""
    outgoing = F.when(F.col("engine") == fixed.HYBRID, F.col("anonymized_text")).otherwise(
        F.col("redacted_text")
    )
    # redacted text went through the rules; only anonymised text has to be checked
    clean = F.when(
        F.col("engine") == fixed.HYBRID,
        r.leak_labels(F.coalesce("anonymized_text", F.lit(""))) == "",
    ).otherwise(F.lit(True))
    return (
        df.where(F.col("read_message").isNull() & ~is_blank(F.col("text")) & clean)
        .withColumn("outgoing_text", outgoing)
    )


def request_table(df: DataFrame, instructions: str = q.INSTRUCTIONS) -> DataFrame:
    """One request per letter that may leave: (file, engine, request)."""
    hint = F.when(F.col("engine") == fixed.LOCAL, letter_date(F.col("outgoing_text")))
    return may_leave(df).select(
        "file",
        "engine",
        q.request_text(F.col("outgoing_text"), hint, instructions).alias("request"),
    )


def destination(status: Column, category: Column, name: Column) -> Column:
    """Where a letter goes, relative to the source folder."""
    folders = F.create_map(*[F.lit(x) for pair in fixed.STATUS_FOLDER.items() for x in pair])
    return F.when(status == "renamed", F.concat_ws("/", F.lit("done"), category, name)).otherwise(
        F.concat_ws("/", F.element_at(folders, status), name)
    )
