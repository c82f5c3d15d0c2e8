"""Reading folders of documents, the run log, rules, blocklists and expectations."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import name_stem, strip
from ..operators.running import running
from ..schemas import RUN_LOG
from .json_arrays import JsonArray


def _base_name(path):
    return F.element_at(F.split(path, "/"), -1)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files directly in a folder: file, path, bytes. Contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .option("recursiveFileLookup", "false")
        .load(folder)
    )
    return files.select(_base_name(F.col("path")).alias("file"), "path", F.col("length").alias("bytes"))


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Text files as documents: file, text; a whole file is one document."""
    # wholetext must be an argument: the option of that name is overridden by its default
    texts = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The run log; blank and malformed lines are left out."""
    log = spark.read.schema(RUN_LOG).json(path)
    return log.where(F.col("file").isNotNull() & F.col("status").isNotNull())


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Blocklist terms (line_no, term) in file order, without comments and blank lines.

    Lines are read one by one and numbered by their place, so a list may have millions of them.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # line breaks that the reader does not know
    parts = lines.select("_file", "_block", "_row", F.posexplode(F.split("value", "[\x0B\f\x1C-\x1E\x85\u2028\u2029]")).alias("_part", "line"))
    numbered = running(parts, [], ["_file", "_block", "_row", "_part"], "_n")
    return numbered.select((F.col("_n") - 1).alias("line_no"), strip(F.col("line")).alias("term")).where(
        (F.col("term") != "") & ~F.startswith(F.col("term"), F.lit("#"))
    )


def default_rules(spark: SparkSession, rules=fixed.DEFAULT_CATEGORIES) -> DataFrame:
    """Topic rules as a table: priority, category, keywords (lower-cased, accents kept)."""
    rows = [(i, category, [k.lower() for k in keywords]) for i, (category, keywords) in enumerate(rules, 1)]
    return spark.createDataFrame(rows, "priority INT, category STRING, keywords ARRAY<STRING>")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Topic rules from a JSON list of {key, keywords}; the order in the list is the priority.

    The list is read by ranges, so it may be of any length.
    """
    rules = JsonArray(spark, path).elements()
    field = "array<string>"
    return rules.where(F.startswith(F.schema_of_variant("element"), F.lit("OBJECT"))).select(
        (F.col("pos") + 1).cast("int").alias("priority"),
        F.try_variant_get("element", "$.key", "string").alias("category"),
        F.transform(
            F.coalesce(F.try_variant_get("element", "$.keywords", field), F.array().cast(field)), lambda k: F.lower(k)
        ).alias("keywords"),
    )


def _text_field(case, key: str):
    return F.coalesce(F.try_variant_get(case, f"$.{key}", "string"), F.lit(""))


def expectation_values(case, key: str):
    """A scalar or a list as a list of non-empty strings."""
    kind = F.schema_of_variant(F.try_variant_get(case, f"$.{key}", "variant"))
    listed = F.try_variant_get(case, f"$.{key}", "array<string>")
    single = F.array(_text_field(case, key))
    values = F.when(F.startswith(kind, F.lit("ARRAY")), listed).otherwise(single)
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def read_expectations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases from JSON, as (usable, rejected with reject_reason).

    The file holds a list of cases, or an object with ``cases`` and a ``cloud_safe`` default. It is read by ranges, so the
    list may be of any length.
    """
    listed = JsonArray(spark, path, "cases")
    safe = listed.scalars().where("key = 'cloud_safe'").agg(F.coalesce(F.max(F.col("value") == "true"), F.lit(False)).alias("safe"))
    cases = listed.elements().withColumn("all_safe", safe.scalar())
    return _cases(cases.select("all_safe", "pos", F.col("element").alias("case")))


def read_expectation_rows(spark: SparkSession, path: str, cloud_safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same from JSON rows, one case each, for tables of any size; a row may number itself as ``case_no``."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("case"))
    number = F.coalesce(F.try_variant_get("case", "$.case_no", "int"), F.lit(1)) - 1
    return _cases(rows.select(F.lit(cloud_safe).alias("all_safe"), number.alias("pos"), "case"))


def _cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) of rows (all_safe, pos, case)."""
    case = F.col("case")
    file = _text_field(case, "file")
    guessed = F.when(F.lower(file).endswith(".txt"), F.lit("text")).otherwise(F.lit("pdf"))
    given_type = _text_field(case, "input_type")
    given_id = _text_field(case, "id")
    rows = cases.select(
        (F.col("pos") + 1).alias("case_no"),
        F.startswith(F.schema_of_variant(case), F.lit("OBJECT")).alias("_is_object"),
        F.when(given_id != "", given_id).otherwise(name_stem(_base_name(file))).alias("id"),
        file.alias("file"),
        F.when(given_type != "", given_type).otherwise(guessed).alias("input_type"),
        expectation_values(case, "sender_any").alias("sender_any"),
        expectation_values(case, "content_any").alias("content_any"),
        _text_field(case, "date").alias("exp_date"),
        _text_field(case, "date_source").alias("date_source"),
        F.coalesce(F.try_variant_get(case, "$.cloud_safe", "boolean"), F.col("all_safe")).alias("cloud_safe"),
    ).withColumn(
        "reject_reason",
        F.when(~F.col("_is_object"), F.lit("no object"))
        .when(F.col("file") == "", F.lit("no file"))
        .when(~F.col("input_type").isin("text", "pdf"), F.lit("input type"))
        .when(
            (F.size("sender_any") == 0) & (F.size("content_any") == 0) & (F.col("exp_date") == ""),
            F.lit("no expectations"),
        ),
    )
    usable = rows.where("reject_reason IS NULL").drop("_is_object", "reject_reason")
    rejected = rows.where("reject_reason IS NOT NULL").select("case_no", "file", "reject_reason")
    return usable, rejected


def built_in_cases(expectations: DataFrame, files: DataFrame) -> DataFrame:
    """Cases from a fixed expectation table, for the files that exist; all may go to a cloud model."""
    return expectations.join(files.select("file").distinct(), "file", "left_semi").select(
        F.col("file").alias("id"),
        "file",
        F.lit("pdf").alias("input_type"),
        "sender_any",
        "content_any",
        "exp_date",
        F.lit("document").alias("date_source"),
        F.lit(True).alias("cloud_safe"),
    )
