"""The redaction chain over a table of texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import redaction as r
from ..functions.text import is_blank

def count_column(label: str) -> str:
    return f"n_{label.strip('[]').lower()}"


COUNT_COLUMNS = {label: count_column(label) for label in r.LABELS}


def redact(df: DataFrame, text: str = "text", blocklist: tuple[str, ...] = ()) -> DataFrame:
    """Add ``redacted_text`` and one count column per label.

    Each rule works on the text the rule before it left; every text is scanned once per
    rule that may match, and the hits are counted from the labels put in.
    """
    out = df.withColumn("_chain", r.chain(F.col(text)))
    final, hits = F.col("_chain.text"), F.lit(0)
    if any(blocklist):
        # if no term occurs before the first replacement, none is ever inserted
        out = out.withColumn("_listed", r.listed_patterns(F.col("_chain.text"), blocklist)).withColumn(
            "_folded", F.when(F.col("_listed").isNotNull(), r.fold_terms(F.col("_chain.text"), F.col("_listed")))
        )
        final = F.coalesce("_folded.text", "_chain.text")
        hits = F.coalesce("_folded.hits", F.lit(0))
    return out.select(
        *df.columns,
        final.alias("redacted_text"),
        *[F.coalesce(F.col("_chain")[label], F.lit(0)).alias(COUNT_COLUMNS[label]) for label in r.PATTERNS],
        hits.alias(COUNT_COLUMNS[fixed.BLOCKLIST_LABEL]),
    )


def redaction_map() -> Column:
    """Label → count over the count columns, labels without a hit left out."""
    full = F.map_from_arrays(
        F.array(*[F.lit(label) for label in COUNT_COLUMNS]),
        F.array(*[F.col(c) for c in COUNT_COLUMNS.values()]),
    )
    return F.map_filter(full, lambda _, n: n > 0)


def redaction_rows(df: DataFrame, *id: str) -> DataFrame:
    """The count columns as rows (id, label, n), labels without a hit left out."""
    # outer: a plain explode would be preceded by a filter that computes the map a second time
    rows = df.select(*id, redaction_map().alias("_counts")).select(
        *id, F.explode_outer("_counts").alias("label", "n")
    )
    return rows.where("label IS NOT NULL")


def map_total(counts: Column) -> Column:
    """Sum of the values of a count map."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, n: a + n)


def redaction_total() -> Column:
    columns = [F.col(c).cast("bigint") for c in COUNT_COLUMNS.values()]
    return sum(columns[1:], columns[0])


def prepare(df: DataFrame, text: str = "text", blocklist: tuple[str, ...] = ()) -> DataFrame:
    """Redacted text, counts as a map, and the scan flag.

    A scan has no text, so it gets no redacted text and an empty map.
    """
    # counts of a blank text are zero anyway, so nothing needs masking but the text
    done = redact(df, text, blocklist).withColumn("is_scanned", is_blank(F.col(text)))
    return done.select(
        *df.columns,
        "is_scanned",
        F.when(~F.col("is_scanned"), F.col("redacted_text")).alias("redacted_text"),
        redaction_map().alias("redactions"),
        redaction_total().alias("n_redactions"),
    )


def redaction_summary(df: DataFrame, *by: str, text: str = "text", blocklist=()) -> DataFrame:
    """Hits per label (and group): columns ``by``, label, n_docs, n_hits.

    The counts are summed side by side before they are turned into rows, so the
    shuffle carries one row per task and group, not one per document and label.
    """
    done = redact(df, text, blocklist)
    sums = []
    for column in COUNT_COLUMNS.values():
        sums.append(F.count_if(F.col(column) > 0).alias(f"docs_{column}"))
        sums.append(F.sum(F.col(column).cast("bigint")).alias(f"hits_{column}"))
    per_group = done.groupBy(*by).agg(*sums)
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("label"),
                    F.col(f"docs_{column}").alias("n_docs"),
                    F.col(f"hits_{column}").alias("n_hits"),
                )
                for label, column in COUNT_COLUMNS.items()
            ]
        )
    )
    return per_group.select(*by, rows).where("n_hits > 0")


def placeholder_tally(df: DataFrame, *by: str, text: str = "anonymized_text") -> DataFrame:
    """How often each placeholder occurs in already anonymised texts."""
    tokens = df.select(*by, F.explode(r.placeholders(F.col(text))).alias("label"))
    return tokens.groupBy(*by, "label").agg(F.count("*").alias("n"))
