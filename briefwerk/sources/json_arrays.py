"""JSON arrays of any length, read by as many tasks as the file has ranges.

A file with one array is one value to a JSON reader, hence one cell of one task. Here it is read as text that ends at
each ``}``, which any range of it can be. Whether such a piece begins within a string depends on the quotes before it,
how deep it is nested on the brackets before it: running sums over the pieces. Pieces from one element's end to the
next one's are put together again, and each element is parsed on its own.

Elements that are no objects end without a brace; they come along with the element after them, or with the array's
end, and are told apart there. The order in the file is kept.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import once
from ..operators.running import running
from ..session import settle

# a string (the last one may be open), a bracket, or what lies between
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[\[\]{}]|[^"\[\]{}]++'
_OPENED = "array<struct<key:string,at:int,depth:int>>"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces in order, with their tokens: a piece within a string begins with a quote put before it."""
    lines = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
        F.regexp_count(F.regexp_replace("value", r"(?s)\\.", ""), F.lit('"')).cast("bigint").alias("_quotes"),
    )
    counted = running(lines, ["_file"], ["_block", "_row"], ordinal="_no", totals={"_upto": "_quotes"})
    within = (F.col("_upto") - F.col("_quotes")) % 2 == 1
    tokens = F.regexp_extract_all(F.when(within, F.concat(F.lit('"'), "value")).otherwise(F.col("value")), F.lit(_TOKEN), F.lit(0))
    known = counted.select(
        "_file", "_no", "value", within.cast("int").alias("_put"), tokens.alias("_tokens"), (F.col("_upto") % 2 == 0).alias("_closed")
    )
    opens = F.size(F.filter("_tokens", lambda t: t.isin("{", "[")))
    closes = F.size(F.filter("_tokens", lambda t: t.isin("}", "]"))) + F.col("_closed").cast("int")
    deep = running(known.withColumn("_by", (opens - closes).cast("bigint")), ["_file"], ["_no"], totals={"_depth": "_by"})
    return deep.withColumn("_before", (F.col("_depth") - F.col("_by")).cast("int"))


def _read(tokens: Column, depth: Column, put: Column) -> Column:
    """What a piece has of the outer levels: arrays opened, where the array of a depth ends, scalars of the outer object."""
    start = F.struct(
        depth.alias("depth"), (-put).alias("at"), F.lit("").alias("said"),
        F.array().cast(_OPENED).alias("opened"),
        F.array().cast("array<struct<at:int,depth:int>>").alias("ended"),
        F.array().cast("array<struct<key:string,value:string>>").alias("scalars"),
    )

    def step(acc: Column, token: Column) -> Column:
        depth, at = acc["depth"], acc["at"]
        opened = F.struct(acc["said"].alias("key"), at.alias("at"), (depth + 1).alias("depth"))
        ended = F.struct(at.alias("at"), depth.alias("depth"))
        plain = F.regexp_extract(token, r"^\s*:\s*(true|false)\b", 1)
        scalar = F.struct(acc["said"].alias("key"), plain.alias("value"))
        outer = depth <= 1
        return F.struct(
            F.when(token.isin("{", "["), depth + 1).when(token.isin("}", "]"), depth - 1).otherwise(depth).alias("depth"),
            (at + F.length(token)).alias("at"),
            F.when(F.startswith(token, F.lit('"')), token).otherwise(acc["said"]).alias("said"),
            F.when((token == "[") & outer, F.array_append(acc["opened"], opened)).otherwise(acc["opened"]).alias("opened"),
            F.when((token == "]") & (depth <= 2), F.array_append(acc["ended"], ended)).otherwise(acc["ended"]).alias("ended"),
            F.when((depth == 1) & (plain != ""), F.array_append(acc["scalars"], scalar)).otherwise(acc["scalars"]).alias("scalars"),
        )

    return F.aggregate(tokens, start, step)


class JsonArray:
    """The array of a file (or of each file of a folder): the whole value, or the entry ``key`` of an object.

    Each file is read on its own; ``elements`` numbers them through.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None) -> None:
        read = _pieces(spark, path).withColumn("_seen", _read(F.col("_tokens"), F.col("_before"), F.col("_put")))
        self._pieces = settle(
            read.select("_file", "_no", "value", "_depth", "_closed", "_seen.opened", "_seen.ended", "_seen.scalars"), "json"
        )
        self._key = None if key is None else f'"{key}"'
        outer = self._pieces.where("size(opened) > 0").select("_file", "_no", F.explode("opened").alias("o"))
        mine = F.col("o.depth") == 1 if self._key is None else (F.col("o.depth") == 1) | ((F.col("o.depth") == 2) & (F.col("o.key") == self._key))
        # one row per file: where its array begins
        self._start = outer.where(mine).groupBy("_file").agg(F.min(F.struct("_no", "o.at", "o.depth")).alias("start"))

    def scalars(self) -> DataFrame:
        """Entries true or false of the outer object: _file, key, value."""
        told = self._pieces.where("size(scalars) > 0").select("_file", F.inline("scalars"))
        return told.select("_file", F.btrim("key", F.lit('"')).alias("key"), "value")

    def elements(self) -> DataFrame:
        """_file, pos (from 0, through all files), element (a variant, NULL if it is malformed)."""
        depth, begin = F.col("start.depth"), F.col("start._no")
        rows = self._pieces.join(self._start, "_file").where(F.col("_no") >= begin)
        # where the array closes within a piece, if it does
        closing = F.filter("ended", lambda e: (e["depth"] == depth) & ((F.col("_no") > begin) | (e["at"] > F.col("start.at"))))
        cut = once(
            F.get(closing, 0)["at"],
            lambda at: F.when(at.isNull(), F.col("value")).otherwise(F.substring("value", F.lit(1), at)),
        )
        first = F.when(F.col("_no") == begin, F.substr(cut, F.col("start.at") + 2)).otherwise(cut)
        is_end = F.get(closing, 0).isNotNull()
        told = rows.select(
            "_file", "_no", first.alias("text"), is_end.alias("_is_end"),
            # an element ends with the brace that leads back into the array
            ((F.col("_depth") == depth) & F.col("_closed") & ~is_end).cast("bigint").alias("_ends"), is_end.cast("bigint").alias("_over"),
        )
        numbered = running(told, ["_file"], ["_no"], totals={"_done": "_ends", "_gone": "_over"})
        # after its end nothing belongs to the array
        inside = numbered.where(F.col("_gone") - F.col("_over") == 0).withColumn("_elem", F.col("_done") - F.col("_ends"))
        piece = F.struct("_no", F.concat("text", F.when(F.col("_is_end"), F.lit("")).otherwise(F.lit("}"))).alias("text"))
        whole = inside.groupBy("_file", "_elem").agg(F.array_sort(F.collect_list(piece)).alias("_parts"))
        text = F.regexp_replace(F.array_join(F.col("_parts.text"), ""), r"\A\s*,", "")
        some = whole.select("_file", "_elem", text.alias("text")).where(F.btrim("text", F.lit(" \t\r\n")) != "")
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))), "$", "array<variant>")
        parsed = some.select("_file", "_elem", F.posexplode_outer(listed).alias("_in", "element"))
        # variants neither order nor group: only their places are numbered
        numbered = running(parsed.select("_file", "_elem", "_in", F.to_json("element").alias("_json")), [], ["_file", "_elem", "_in"], "pos")
        return numbered.select("_file", (F.col("pos") - 1).alias("pos"), F.try_parse_json("_json").alias("element"))
