"""Letters derived from the order tables.

The order and customer tables become letters by projection, so their number grows with
the tables and every rule has something to find. The expressions use only what Spark SQL
and the checking engine read alike; ``SQL`` is the same derivation as one statement.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import fresh_path, small_methods

_NL = "chr(10)"

# orders are narrow and letters are not: a small file of orders is a lot of work, so tasks are cut by rows
ROWS_PER_TASK = 50_000


def _case(on: str, values: dict, default: str) -> str:
    arms = " ".join(f"when {k} then {v}" for k, v in values.items())
    return f"case {on} {arms} else {default} end"


def _pick(on: str, values: list[str]) -> str:
    quoted = [f"'{v}'" for v in values]
    return _case(on, dict(enumerate(quoted[:-1])), quoted[-1])


_SENDERS = [
    "Kantonales Steueramt Auenfeld", "Regionalbank Hügelau AG", "Krankenkasse Vitalis",
    "Alpina Versicherungen AG", "Stromwerk Brünnen GmbH", "Sägerei Holzer GmbH",
    "Bildungszentrum Tannegg", "Garage Blitz AG", "Kiosk Möckli & Söhne", "Notariat Zwyssig",
    "Pflanzenhof Kübler", "Weinhandlung Chêne SA",
]
_CITIES = ["Bern", "St. Gallen", "Biel/Bienne", "Zürich", "Musterstadt", "Chur", "La Punt"]
_STREETS = ["Lindenstrasse", "Seegasse", "Kirchweg", "Gartenplatz", "Bahnhofstr.", "General-Guisan-Strasse"]
_PEOPLE = [
    "Dr. med. Anna Keller", "Prof. Dr. Jonas Meier", "PD Dr. Lea Frei", "lic. phil. Nora Graf",
    "Frau Rita Moser", "Dr. Max Huber-Frey",
]
_MONTHS = [
    "", "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September",
    "Oktober", "November",
]
_SHORT_MONTHS = ["", "Jan.", "Feb.", "Mär.", "Apr", "Mai", "Jun.", "Jul.", "Aug", "Sep.", "Okt.", "Nov."]

# (column, expression) in three steps; each step sees the columns of the one before
_FACTS = [
    ("k", "o_orderkey"),
    ("ck", "o_custkey"),
    ("nk", "c_nationkey"),
    ("prio", "o_orderpriority"),
    ("engine", "case o_orderstatus when 'F' then 'claude' when 'O' then 'ollama' else 'hybrid' end"),
    ("price", "cast(cast(o_totalprice as decimal(14,2)) as string)"),
    ("y", "cast(year(o_orderdate) as bigint)"),
    ("m", "cast(month(o_orderdate) as bigint)"),
    ("d", "cast(day(o_orderdate) as bigint)"),
    ("ordered_at", "o_orderdate"),
]
_PARTS = [
    "k", "ck", "engine", "prio", "ordered_at", "y", "m", "d",
    ("file", "concat('brief_', lpad(cast(k as string), 12, '0'), '.pdf')"),
    ("sender_line", _pick("nk % 12", _SENDERS)),
    (
        "label",
        "case when k % 5 = 0 then 'Infoblatt' else "
        + _case(
            "prio",
            {"'1-URGENT'": "'Mahnung'", "'2-HIGH'": "'Kontoauszug'", "'3-MEDIUM'": "'Prämienrechnung'",
             "'4-NOT SPECIFIED'": "'Vollmacht'"},
            "'Vertragsänderung'",
        )
        + " end",
    ),
    ("city", _pick("nk % 7", _CITIES)),
    ("street", _pick("ck % 6", _STREETS)),
    ("person", _pick("ck % 6", _PEOPLE)),
    (
        "amount",
        "case when length(price) > 6 and k % 3 <> 0 then "
        "concat(substr(price, 1, length(price) - 6), chr(39), substr(price, length(price) - 5)) "
        "else price end",
    ),
    (
        "iban",
        "case k % 3 when 0 then concat('CH', lpad(cast(k % 100 as string), 2, '0'), ' 0483 5012 ', "
        "lpad(cast(ck % 10000 as string), 4, '0'), ' 7800 9') "
        "when 1 then concat('BE', lpad(cast(k % 100 as string), 2, '0'), ' 5390 0754 ', "
        "lpad(cast(ck % 10000 as string), 4, '0')) "
        "else concat('CH5604835012', lpad(cast(ck % 100000 as string), 5, '0'), '8009') end",
    ),
    (
        "ahv",
        "concat('756.', lpad(cast(ck % 10000 as string), 4, '0'), '.', "
        "lpad(cast(k % 10000 as string), 4, '0'), '.', lpad(cast(k % 100 as string), 2, '0'))",
    ),
    (
        "phone",
        "case k % 4 when 0 then concat('+41 44 ', lpad(cast(k % 1000 as string), 3, '0'), ' 31 11') "
        "when 1 then concat('044 ', lpad(cast(k % 1000 as string), 3, '0'), ' 62 07') "
        "when 2 then concat('079 ', lpad(cast(k % 1000 as string), 3, '0'), ' 45 67') "
        "else concat('+1 (743) 555-', lpad(cast(k % 10000 as string), 4, '0')) end",
    ),
    ("email", "concat('kunde', cast(ck as string), '@beispiel.ch')"),
    (
        "month_name",
        "case when m = 12 then 'Dezember' when k % 6 = 0 then " + _pick("m", _SHORT_MONTHS)
        + " else " + _pick("m", _MONTHS) + " end",
    ),
    ("day_no", "case when k % 41 = 0 then 45 else d end"),
    ("year_no", "case when k % 43 = 0 then y else y + 27 end"),
    ("zip", "cast(1000 + ck % 9000 as string)"),
]
_LETTERS = [
    "k", "file", "engine", "ordered_at", "sender_line", "label",
    (
        "text",
        f"case when k % 29 = 0 then concat('  ', {_NL}, ' ') else concat("
        f"sender_line, {_NL}, "
        f"case when k % 13 = 0 then concat(repeat('x', 900), {_NL}) else '' end, "
        f"case when prio = '2-HIGH' then 'Periode: 01.01.2025 - 31.01.2025' else "
        f"concat(city, ', ', cast(day_no as string), '. ', month_name, ' ', cast(year_no as string)) end, {_NL}, "
        f"person, {_NL}, street, ' ', cast(1 + k % 90 as string), "
        f"case when k % 2 = 0 then ', ' else {_NL} end, zip, ' ', city, {_NL}, "
        f"label, {_NL}, 'Total CHF ', amount, {_NL}, 'IBAN: ', iban, {_NL}, "
        f"case when k % 7 = 0 then concat('AHV-Nr. ', ahv, {_NL}) else '' end, "
        f"'Telefon ', phone, ' oder ', email, {_NL}) end",
    ),
    (
        "anonymized_text",
        f"case when k % 29 = 0 then '' else concat(sender_line, {_NL}, 'Guten Tag [NAME], [ADRESSE]', {_NL}, "
        f"label, ' [BETRAG] an [KONTO]', {_NL}, "
        f"case when k % 17 = 0 then ahv when k % 19 = 0 then concat('Mobil 079 ', "
        f"lpad(cast(k % 1000 as string), 3, '0'), ' 45 67') else '[TELEFON] [EMAIL]' end, "
        f"case when k % 3 = 0 then ' [BETRAG]' else '' end) end",
    ),
    (
        "date_text",
        "case when k % 11 = 0 then 'unknown' else "
        "cast((y + 27) * 10000 + m * 100 + d as string) end",
    ),
    (
        "answer",
        "concat('{\"sender\": \"', replace(sender_line, ' ', '-'), '\", \"content\": \"', label, '\", \"date\": ', "
        "case when k % 11 = 0 then '\"unknown\"' when k % 9 = 0 then "
        "cast((y + 27) * 10000 + m * 100 + d as string) else "
        "concat('\"', cast((y + 27) * 10000 + m * 100 + d as string), '\"') end, "
        "case when k % 14 = 0 then '' when k % 8 = 0 then ', \"confidence\": \"low\"' "
        "when k % 10 = 0 then ', \"confidence\": \"medium\"' else ', \"confidence\": \"high\"' end, '}')",
    ),
    ("input_tokens", "cast(250 + k % 900 as bigint)"),
    ("output_tokens", "cast(30 + k % 50 as bigint)"),
    ("read_message", "case when k % 97 = 0 then 'EOF marker not found' end"),
    ("read_type", "case when k % 97 = 0 then 'PdfStreamError' end"),
    (
        "analysis_message",
        "case k % 61 when 1 then 'Request timed out.' when 2 then 'Error code: 429 - rate limit' "
        "when 3 then 'Error code: 529 - Overloaded' when 4 then 'Could not resolve authentication method' "
        "when 5 then 'connection refused' end",
    ),
    ("analysis_type", "case when k % 61 between 1 and 5 then 'ApiError' end"),
    ("t_anonymize", "cast(k % 389 as double) / cast(16 as double)"),
    ("t_regex", "cast(k % 7 as double) / cast(32 as double)"),
    ("t_extract", "cast(k % 101 as double) / cast(8 as double)"),
]
_RESPONSE = (
    "case k % 23 when 1 then concat('Gerne: ', answer, ' Ende') when 2 then substr(answer, 1, length(answer) - 1) "
    "when 3 then '[1, 2]' when 4 then concat('{oops} ', answer) else answer end"
)


def _select(step) -> list[str]:
    return [s if isinstance(s, str) else f"{s[1]} as {s[0]}" for s in step]


_COLUMNS = [
    "k", "file", "engine", "ordered_at", "sender_line", "label", "text", "anonymized_text",
    f"{_RESPONSE} as response", "input_tokens", "output_tokens", "read_message", "read_type",
    "analysis_message", "analysis_type", "t_anonymize", "t_regex", "t_extract", "date_text",
]


def _nested(source: str) -> str:
    sql = source
    for step in (_FACTS, _PARTS, _LETTERS):
        sql = f"select {', '.join(_select(step))} from ({sql}) t"
    return f"select {', '.join(_COLUMNS)} from ({sql}) t"


SQL = _nested("select * from orders join customer on o_custkey = c_custkey")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    df = orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(*_select(_FACTS))
    df = df.repartition(max(spark.sparkContext.defaultParallelism, -(-orders.count() // ROWS_PER_TASK)))
    for step in (_PARTS, _LETTERS):
        df = df.selectExpr(*_select(step))
    return df.selectExpr(*_COLUMNS)


_TABLES: dict[tuple[str, str], str] = {}
_SCHEMAS: dict[str, StructType] = {}


def letter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters as a table: written to the shared folder once per application, then read."""
    folder = letter_folder(spark, sf_dir)
    return spark.read.schema(_SCHEMAS[folder]).parquet(folder)


def letter_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where that table is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = fresh_path(spark, "letters")
        made = letters(spark, sf_dir)
        with small_methods(spark):
            made.write.parquet(path)
        _TABLES[key], _SCHEMAS[path] = path, made.schema
    return _TABLES[key]


# --- run-log rows from the event table -------------------------------------------------------

_LOG_FACTS = [
    "event_id", "ts", "user_id", "event_type", "value",
    (
        "status",
        "case when event_type = 'error' then 'skipped' when event_type = 'signup' then 'review' "
        "when value < 10 then 'unrecognized' else 'renamed' end",
    ),
    ("engine", "case user_id % 3 when 0 then 'claude' when 1 then 'ollama' else 'hybrid' end"),
]
_LOG = [
    ("event_id", "event_id"),
    ("user_id", "user_id"),
    ("ts", "ts"),
    ("file", "concat('brief_', cast(user_id * 7 + event_id % 40 as string), '.pdf')"),
    ("status", "status"),
    (
        "suggested",
        "case when status = 'renamed' then concat('Absender-', event_type, '-2024', "
        "lpad(cast(user_id as string), 4, '0'), '.pdf') "
        "else concat('brief_', cast(user_id * 7 + event_id % 40 as string), '.pdf') end",
    ),
    ("confidence", "case status when 'renamed' then 'high' when 'unrecognized' then 'low' else 'n/a' end"),
    ("engine", "engine"),
    (
        "cost_chf",
        "case when engine = 'ollama' or status in ('review', 'skipped') then cast(0 as double) "
        "else cast(event_id % 1000 as double) / cast(1000000 as double) end",
    ),
    (
        "elapsed_s",
        "case when event_type = 'signup' and engine = 'claude' then cast(0 as double) "
        "else cast(event_id % 512 as double) / cast(10 as double) end",
    ),
    ("t_anonymize", "case when engine = 'hybrid' then cast(event_id % 64 as double) / cast(4 as double) end"),
    ("t_regex", "case when engine = 'hybrid' then cast(event_id % 16 as double) / cast(8 as double) end"),
    (
        "t_claude",
        "case when engine = 'hybrid' and status in ('renamed', 'unrecognized') "
        "then cast(event_id % 32 as double) / cast(2 as double) end",
    ),
    (
        "t_analysis",
        "case when engine <> 'hybrid' and status in ('renamed', 'unrecognized') "
        "then cast(event_id % 128 as double) / cast(4 as double) end",
    ),
    (
        "error_reason",
        "case when status <> 'skipped' then '' when event_id % 4 = 0 then 'lesen:pdf-read-error' "
        "when event_id % 4 = 1 then 'analyse:timeout' when event_id % 4 = 2 then 'analyse:rate-limit' "
        "else 'manual-skip' end",
    ),
    (
        "done_category",
        "case when status <> 'renamed' then '' when event_type = 'click' then '02_Banking-Pension' "
        "when event_type = 'view' then '05_Housing-Utilities' else '99_Other' end",
    ),
]

LOG_SQL = (
    f"select {', '.join(_select(_LOG))} from (select {', '.join(_select(_LOG_FACTS))} from events) e"
)
PHASES = ("anonymize", "regex", "claude", "analysis")


def shape_events(events: DataFrame) -> DataFrame:
    """Run-log rows from event rows; works on a stream as well."""
    return events.selectExpr(*_select(_LOG_FACTS)).selectExpr(*_select(_LOG))


def with_phases(log: DataFrame) -> DataFrame:
    """The phase columns as a map that holds only the phases a row has."""
    full = F.map_from_arrays(
        F.array(*[F.lit(p) for p in PHASES]), F.array(*[F.col(f"t_{p}") for p in PHASES])
    )
    return log.withColumn("phases", F.map_filter(full, lambda _, t: t.isNotNull())).drop(
        *[f"t_{p}" for p in PHASES]
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run-log row per event."""
    return with_phases(shape_events(spark.read.parquet(f"{sf_dir}/events.parquet")))
