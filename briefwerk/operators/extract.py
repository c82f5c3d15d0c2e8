"""Sender, content and date of a letter by rule, for runs without any model."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java
from ..functions.text import letter_date, strip

# What a letter is: (label, kind); the first label found in the text counts.
DOCUMENT_TYPES = (
    ("Kontoauszug", "statement"),
    ("Kreditkartenabrechnung", "statement"),
    ("Vorsorgeausweis", "certificate"),
    ("Jahresabschluss", "certificate"),
    ("Prämienrechnung", "letter"),
    ("Stromrechnung", "letter"),
    ("Steuerrechnung", "letter"),
    ("Mahnung", "letter"),
    ("Vollmacht", "letter"),
    ("Vertragsänderung", "letter"),
    ("Infoblatt", "letter"),
    ("Rechnung", "letter"),
)
LEGAL_SUFFIXES = ("AG", "GmbH", "SA", "KG")

_PERIOD_END = java(
    r"\d{1,2}\.\d{1,2}\.(?:\d{4})?\s*[–\-]\s*(\d{1,2})\.(\d{1,2})\.(\d{4})"
)


def sender_of(text: Column) -> Column:
    """The first line that is not blank, without legal suffix, words joined by hyphens."""
    line = strip(F.regexp_extract(text, java(r"([^\s][^\n]*)"), 1))
    plain = F.regexp_replace(line, java(rf"(?:\s+(?:{'|'.join(LEGAL_SUFFIXES)}))+\s*$"), "")
    joined = F.regexp_replace(plain, java(r"\s+"), "-")
    return F.nullif(joined, F.lit(""))


def _by_type(text: Column, pick: int) -> Column:
    low = F.lower(text)
    chosen = F
    for row in DOCUMENT_TYPES:
        chosen = chosen.when(F.contains(low, F.lit(row[0].lower())), F.lit(row[pick]))
    return chosen.otherwise(F.lit(None).cast("string"))


def rule_extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Add sender, content, date (NULL if not found) and confidence.

    A statement is dated by the end of its period, a yearly certificate by the end of its
    year, any other letter by its head.
    """
    kept = df.columns
    t = F.col(text)
    staged = df.withColumns(
        {"_sender": sender_of(t), "_content": _by_type(t, 0), "_kind": _by_type(t, 1)}
    )
    period = F.regexp_substr(t, F.lit(_PERIOD_END))
    end = [F.regexp_extract(period, _PERIOD_END, i).try_cast("int") for i in (3, 2, 1)]
    year = F.regexp_extract(t, java(r"(?:Vorsorgeausweis|Jahresabschluss)[^0-9]{0,20}(20\d{2})", True), 1)
    date = (
        F.when(F.col("_kind") == "statement", F.format_string("%d%02d%02d", *end))
        .when(F.col("_kind") == "certificate", F.concat(F.nullif(year, F.lit("")), F.lit("1231")))
        .otherwise(letter_date(t))
    )
    found = F.when((F.col("_kind") == "statement") & period.isNull(), F.lit(None)).otherwise(date)
    return staged.withColumn("_date", found).select(
        *kept,
        F.col("_sender").alias("sender"),
        F.col("_content").alias("content"),
        F.col("_date").alias("date"),
        F.when(
            F.col("_sender").isNotNull() & F.col("_content").isNotNull() & F.col("_date").isNotNull(),
            F.lit("high"),
        )
        .otherwise(F.lit("low"))
        .alias("confidence"),
    )


def extract(df: DataFrame, extractor: Callable[[DataFrame], DataFrame] = rule_extract) -> DataFrame:
    """Extraction by any function that adds sender, content, date and confidence.

    Instead of the rules it may join a table of recorded model responses.
    """
    done = extractor(df)
    missing = {"sender", "content", "date", "confidence"} - set(done.columns)
    if missing:
        raise ValueError(f"the extractor must add {sorted(missing)}")
    return done
