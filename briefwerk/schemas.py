"""Schemas of the tables that are read from files."""

from pyspark.sql import types as T

RUN_LOG = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("suggested", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("cost_chf", T.DoubleType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("phases", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("error_reason", T.StringType()),
        T.StructField("done_category", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

RULES = "priority INT, category STRING, keywords ARRAY<STRING>"
EXPECTATIONS = "file STRING, sender_any ARRAY<STRING>, content_any ARRAY<STRING>, exp_date STRING"
METRICS = "section STRING, key STRING, metric STRING, value DOUBLE"
