"""From raw documents to a training mixture: five stages, each one operator of ``briefwerk.llm``.

Every stage works on all that the one before kept. The first four return the columns of documents; the last one
returns a row per use of a document in the mixture, with its block and its place in the block.
"""

from pyspark.sql import DataFrame, SparkSession

from briefwerk.llm.common import table
from briefwerk.llm.decontaminate import decontaminated
from briefwerk.llm.jaccard import deduplicated
from briefwerk.llm.mixture import mixture
from briefwerk.llm.personal import masked
from briefwerk.llm.quality import accepted, fit
from briefwerk.session import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, the one with the smallest id."""
    return deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return masked(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by tempered weights, in permuted blocks; texts come along to their places."""
    return mixture(docs, carry=("text", "lang", "n_chars"))


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", personal_stage),
    ("mixture", mixture_stage),
]

ORACLE_SQL = None  # the quality stage learns a model; a brute-force version is in the tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
