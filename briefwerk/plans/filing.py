"""A whole run: letters in, outcomes, log rows and filing manifest out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators.category import assign_category
from ..operators.naming import unique_names, unique_original_names
from ..operators.redact import redact
from ..operators.routing import route
from ..session import settle


def analyse(letters: DataFrame, blocklist: tuple[str, ...] = ()) -> DataFrame:
    """Redact and route: every letter with its outcome, before names are given."""
    return route(redact(letters, "text", blocklist))


def _phases() -> Column:
    """Seconds per phase, as far as a letter got."""
    hybrid = F.col("engine") == fixed.HYBRID
    analysed = F.col("status").isin("renamed", "unrecognized")
    anonymized = F.map_from_arrays(
        F.array(F.lit("anonymize"), F.lit("regex")), F.array("t_anonymize", "t_regex")
    )
    extracted = F.create_map(F.when(hybrid, F.lit("claude")).otherwise(F.lit("analysis")), F.col("t_extract"))
    nothing = F.create_map().cast("map<string,double>")
    return F.map_concat(
        F.when(hybrid & (F.col("status") != "skipped"), anonymized).otherwise(nothing),
        F.when(analysed, extracted).otherwise(nothing),
    )


def _elapsed() -> Column:
    """Seconds of the steps a letter reached."""
    checked = F.when(
        (F.col("engine") == fixed.HYBRID) & (F.col("reached") != "read"), F.col("t_anonymize") + F.col("t_regex")
    ).otherwise(F.lit(0.0))
    return checked + F.when(F.col("reached") == "extracted", F.col("t_extract")).otherwise(F.lit(0.0))


def outcomes(
    letters: DataFrame,
    blocklist: tuple[str, ...] = (),
    rules=fixed.DEFAULT_CATEGORIES,
    taken: DataFrame | None = None,
) -> DataFrame:
    """One row per letter with status, final name and measures.

    ``taken`` lists names filed earlier as (dir, name), dir being the topic for renamed
    letters, else the outcome's folder. Letter files are unique, so without earlier names
    a letter that keeps its name keeps it as it is.
    """
    routed = analyse(letters, blocklist).select(
        "file",
        "engine",
        "status",
        "confidence",
        "error_reason",
        "proposed_name",
        "cost_chf",
        _elapsed().alias("elapsed_s"),
        _phases().alias("phases"),
        F.col("ordered_at").alias("finished_at"),
    )
    # texts are read and redacted once; everything below works on these narrow rows
    routed = settle(assign_category(routed, "proposed_name", rules, "done_category"), "routed")
    renamed = unique_names(
        routed.where("status = 'renamed'"), "done_category", "proposed_name", "file", taken
    )
    rest = routed.where("status <> 'renamed'").withColumn("done_category", F.lit(""))
    if taken is None:
        rest = rest.withColumn("final_name", F.col("file"))
    else:
        folders = F.create_map(*[F.lit(x) for pair in fixed.STATUS_FOLDER.items() for x in pair])
        rest = unique_original_names(
            rest.withColumn("_folder", F.element_at(folders, F.col("status"))), "_folder", "file", "file", taken
        ).drop("_folder")
    # the log names a renamed letter by its new name, any other by its own
    return (
        renamed.unionByName(rest)
        .withColumn("suggested", F.when(F.col("status") == "renamed", F.col("final_name")).otherwise(F.col("file")))
        .drop("proposed_name")
    )
