"""One runnable query per operator, over the driver's tables.

Every function takes (spark, sf_dir) and returns a flat DataFrame. ``oracle`` holds the
same queries as SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction as r
from ..functions import requests as q
from ..functions import text as t
from ..operators.running import running
from ..operators import blocklist, category, extract, latest, naming, redact, routing, runlog, scoring
from ..schemas import DOCUMENTS, EVENTS
from ..session import fresh_path, read_table
from ..sources import files, sinks
from ..streaming import deliveries, jobs
from . import evaluation, filing, reports
from .letters import letter_folder, letter_table, letters, run_log, shape_events, with_phases

# terms for the short blocklist: one inside another, one that a label holds, one with regex signs
TERMS = ("Meier", "Keller", "frau rita", "Rita Moser", "(743)", "IBAN", "Möckli & Söhne")

MODELS = evaluation.model_labels(["modell-a", "modell-b"], "claude-test")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


def _long(n: Column) -> Column:
    return n.cast("bigint")


# --- redaction ---------------------------------------------------------------------------------

def redaction_counts_by_lang(spark, sf):
    """Redaction hits per language and label over the document corpus."""
    return redact.redaction_summary(_documents(spark, sf), "lang")


def redaction_counts_by_engine(spark, sf):
    """Redaction hits per engine and label over the letters."""
    return redact.redaction_summary(letter_table(spark, sf), "engine")


def _one_rule(label: str):
    def on_letters(spark, sf):
        text = F.col("text")
        redacted = r.redact_rule(text, label)
        staged = letter_table(spark, sf).select("file", "text", redacted.alias("redacted"))
        return staged.select("file", "redacted", _long(r.count_inserted(text, F.col("redacted"), label)).alias("n"))

    on_letters.__doc__ = f"The {label} rule alone, on each letter."
    return on_letters


def _chain_columns():
    return [_long(F.col(c)).alias(c) for c in redact.COUNT_COLUMNS.values()]


def redact_chain(spark, sf):
    """All rules in order on each letter, with the count of each stage."""
    return redact.redact(letter_table(spark, sf)).select("file", "redacted_text", *_chain_columns())


def redact_documents(spark, sf):
    """All rules in order on each document of the corpus."""
    return redact.redact(_documents(spark, sf)).select("doc_id", "redacted_text", *_chain_columns())


def redact_pages(spark, sf):
    """All rules in order on raw web pages."""
    return redact.redact(read_table(spark, f"{sf}/pages.parquet"), "html").select("page_id", "redacted_text", *_chain_columns())


def redact_conversations(spark, sf):
    """Turns and redaction hits per role of the conversations, zeros included."""
    done = redact.redact(read_table(spark, f"{sf}/conversations.parquet"))
    hits = [F.sum(_long(F.col(c))).alias(c) for c in redact.COUNT_COLUMNS.values()]
    return done.groupBy("role").agg(F.count("*").alias("turns"), *hits)


def redaction_map(spark, sf):
    """The count map of each letter, one row per label."""
    done = redact.redaction_rows(redact.redact(letter_table(spark, sf)), "file")
    return done.withColumn("n", _long(F.col("n")))


def redaction_totals(spark, sf):
    """Redactions per letter as the sum of its count map."""
    done = redact.prepare(letter_table(spark, sf), "text", TERMS)
    return done.select("file", redact.map_total(F.col("redactions")).alias("n_redactions"))


def scan_detection(spark, sf):
    """Letters without any text; they get no redacted text."""
    done = redact.prepare(letter_table(spark, sf))
    return done.select("file", "is_scanned", "redacted_text")


def blocklist_redact(spark, sf):
    """Rules, then a short blocklist in list order."""
    done = redact.redact(letter_table(spark, sf), "text", TERMS)
    return done.select("file", "redacted_text", _long(F.col("n_name")).alias("n_name"))


def benchmark_terms(spark, sf):
    """Every benchmark passage, whole, as a blocklist table."""
    passages = _table(spark, sf, "benchmark")
    return passages.select(F.col("item_id").alias("line_no"), F.col("text").alias("term")).where("term <> ''")


def blocklist_table_redact(spark, sf):
    """A blocklist held in a table, looked up in the documents by parts."""
    docs = _documents(spark, sf).select("doc_id", "text")
    done = blocklist.redact_terms(docs, benchmark_terms(spark, sf), "doc_id", "text")
    return done.select("doc_id", "redacted_text", _long(F.col("n_name")).alias("n_name"))


def leak_verify(spark, sf):
    """Leak rules on the anonymised letters: verdict, labels and the first number found."""
    hits = letter_table(spark, sf).select("file", r.leak_hits(F.col("anonymized_text")).alias("hits"))

    def snippet(label: str) -> Column:
        return F.get(F.filter("hits", lambda h: h["label"] == label), 0)["snippet"]

    return hits.select(
        "file",
        F.array_join(F.transform("hits", lambda h: h["label"]), ", ").alias("labels"),
        F.when(F.size("hits") > 0, F.lit("REVIEW")).otherwise(F.lit("CLEAN")).alias("verdict"),
        snippet("AHV").alias("ahv_snippet"),
        snippet("Telefon (CH)").alias("phone_snippet"),
    )


def leak_verify_documents(spark, sf):
    """Leak labels of the documents as they are."""
    return _documents(spark, sf).select("doc_id", r.leak_labels(F.col("text")).alias("labels"))


def placeholder_tally(spark, sf):
    """Placeholders in anonymised letters, per engine."""
    return redact.placeholder_tally(letter_table(spark, sf), "engine")


# --- dates and names ---------------------------------------------------------------------------

def letter_dates(spark, sf):
    """Issue date in the head of each letter."""
    return letter_table(spark, sf).select("file", t.letter_date(F.col("text")).alias("letter_date"))


def month_numbers(spark, sf):
    """Letters per month name as written, with its number."""
    word = F.regexp_extract("text", r"\n[^\n]*, \d{1,2}\. (\S+) \d{4}\n", 1)
    named = letter_table(spark, sf).select(word.alias("month_name")).where("month_name <> ''")
    counted = named.groupBy("month_name").agg(F.count("*").alias("n"))
    return counted.select("month_name", _long(t.month_number(F.col("month_name"))).alias("month_no"), "n")


def ascii_part(spark, sf):
    """Whole documents as portable name parts."""
    return _documents(spark, sf).select("doc_id", t.ascii_part(F.col("text")).alias("part"))


def safe_filename(spark, sf):
    """Portable file names from whole documents."""
    return _documents(spark, sf).select("doc_id", t.safe_filename(F.col("text")).alias("name"))


def quality_keys(spark, sf):
    """Comparison keys of letter senders and labels, counted."""
    keys = letter_table(spark, sf).select(
        t.quality_key(F.col("sender_line")).alias("sender_key"), t.quality_key(F.col("label")).alias("label_key")
    )
    return keys.groupBy("sender_key", "label_key").agg(F.count("*").alias("n"))


def _proposed(spark, sf):
    named = t.proposed_name(F.col("sender_line"), F.col("label"), F.col("date_text"))
    return letter_table(spark, sf).select("file", named.alias("name"))


def proposed_names(spark, sf):
    """Names composed of sender, content and date."""
    return _proposed(spark, sf)


def unique_names(spark, sf):
    """Collision-free names per topic folder."""
    asked = category.assign_category(_proposed(spark, sf), "name")
    done = naming.unique_names(asked, "category", "name", "file")
    return done.select("file", "category", "final_name")


def _sources(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", F.lit("inbox").alias("dir"), F.concat("source", F.lit(".txt")).alias("name")
    )


def unique_original_names(spark, sf):
    """Files that share an original name, numbered."""
    done = naming.unique_original_names(_sources(spark, sf), "dir", "name", "doc_id")
    return done.select("doc_id", "final_name")


def earlier_names(spark, sf):
    """Names filed earlier, with gaps: name, name-2 and name-5 for some."""
    nations = _table(spark, sf, "nation")
    number = F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("slot")) for n in (1, 2, 5)]))
    held = nations.select("n_nationkey", "n_regionkey", number).where("slot <> 1 or n_regionkey <> 2")
    marker = F.when(F.col("slot") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("slot").cast("string")))
    return held.select(
        F.lit("inbox").alias("dir"),
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), marker, F.lit(".txt")).alias("name"),
    )


def names_after_earlier_runs(spark, sf):
    """Numbering that goes round the names of earlier runs."""
    done = naming.unique_original_names(
        _sources(spark, sf), "dir", "name", "doc_id", earlier_names(spark, sf)
    )
    return done.select("doc_id", "final_name")


def clashing_names(spark, sf):
    """Plain names beside names that look like their numbered ones, all asked for many times."""
    group, number = F.col("doc_id") % 50, F.col("doc_id") % 9
    marker = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (number + 2).cast("string")))
    asked = _documents(spark, sf).select(
        "doc_id", F.lit("inbox").alias("dir"), F.concat(F.lit("brief"), group.cast("string"), marker, F.lit(".pdf")).alias("name")
    )
    return naming.unique_names(asked, "dir", "name", "doc_id").select("doc_id", "final_name")


# --- topics ------------------------------------------------------------------------------------

def category_assign(spark, sf):
    """Topic of each proposed name."""
    return category.assign_category(_proposed(spark, sf), "name")


def category_by_table(spark, sf):
    """The same topics from a rule table by equality lookups."""
    return category.assign_category_by_table(_proposed(spark, sf), files.default_rules(spark), "file", "name")


def category_documents(spark, sf):
    """Topics of whole documents, counted per language."""
    topics = category.assign_category(_documents(spark, sf), "text").groupBy("lang", "category")
    return topics.agg(F.count("*").alias("n"))


def category_counts(spark, sf):
    """Letters per topic."""
    named = category.assign_category(_proposed(spark, sf), "name", into="done_category")
    return reports.category_counts(named)


# --- requests and responses ----------------------------------------------------------------------

def parse_responses(spark, sf):
    """Recorded model responses as fields or an error class."""
    return letter_table(spark, sf).select("file", q.parse_response(F.col("response")).alias("a")).select("file", "a.*")


def date_override(spark, sf):
    """The rule-based date in place of an unusable model date."""
    done = letter_table(spark, sf).select(
        "file", t.letter_date(F.col("text")).alias("hint"), q.parse_response(F.col("response")).alias("a")
    )
    return done.select("file", "hint", q.with_date_hint(F.col("a.date"), F.col("hint")).alias("date"))


def request_table(spark, sf):
    """Requests of the letters that may leave."""
    return routing.request_table(redact.redact(letter_table(spark, sf)))


def token_cost(spark, sf):
    """Cost of each request from its tokens."""
    cost = q.token_cost_chf(F.col("input_tokens"), F.col("output_tokens"))
    return letter_table(spark, sf).select("file", F.round(cost, 9).alias("cost_chf"))


def rule_extract(spark, sf):
    """Fields by rule, without a model."""
    return extract.extract(letter_table(spark, sf)).select("file", "sender", "content", "date", "confidence")


# --- outcomes ------------------------------------------------------------------------------------

def route_outcomes(spark, sf):
    """Outcome of every letter before names are given."""
    done = filing.analyse(letter_table(spark, sf))
    return done.select(
        "file", "engine", "status", "confidence", "error_reason", "proposed_name",
        F.round("cost_chf", 9).alias("cost_chf"),
    )


def uncertain_fields(spark, sf):
    """Why letters went to unrecognized."""
    done = filing.analyse(letter_table(spark, sf)).where("status = 'unrecognized'")
    return done.select("file", "sender", "content", "date", "uncertain_reason")


def _failures(spark, sf):
    """Failed requests from the event table: a message, a type, a server hint, an attempt."""
    message = F.expr(
        "case event_id % 9 when 0 then 'Invalid API_KEY' when 1 then 'Read timed out' "
        "when 2 then 'HTTP 429, timeout' when 3 then 'status 429' when 4 then 'OVERLOADED' "
        "when 5 then 'could not parse JSON' when 6 then 'broken PDF' when 7 then 'EOF marker not found' "
        "else 'disk full' end"
    )
    after = F.expr(
        "case event_id % 5 when 0 then '0.5' when 1 then '17' when 2 then 'soon' when 3 then '' end"
    )
    return _table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id", message.alias("message"), F.lit("OSError").alias("type_name"),
        after.alias("retry_after"), (F.col("user_id") % 7).alias("attempt"),
    )


def manual_decisions(spark, sf):
    """Proposed names accepted, skipped or typed anew by hand."""
    answer = F.expr("case when k % 5 = 0 then '  ' when k % 5 = 1 then concat(' ', label, ' von Hand ') end")
    done = routing.decide_by_hand(filing.analyse(letter_table(spark, sf)), answer)
    return done.select("file", "status", "confidence", "error_reason", "proposed_name")


def error_classes(spark, sf):
    """Failures per class."""
    classes = _failures(spark, sf).select(q.error_class(F.col("message"), F.col("type_name")).alias("error"))
    return classes.groupBy("error").agg(F.count("*").alias("n"))


def retry_plan(spark, sf):
    """Which failures to repeat, and after how long."""
    classed = _failures(spark, sf).withColumn("error", q.error_class(F.col("message"), F.col("type_name")))
    return classed.select(
        "event_id", "error", q.is_retryable(F.col("error")).alias("is_retryable"),
        q.retry_delay_s(F.col("retry_after"), F.col("attempt")).alias("delay_s"),
    )


def filing_run(spark, sf):
    """A whole run: the log row of every letter (phases apart)."""
    log = sinks.log_rows(filing.outcomes(letter_table(spark, sf)))
    return log.drop("phases")


def filing_phases(spark, sf):
    """Phase times of a whole run."""
    return reports.phase_stats(sinks.log_rows(filing.outcomes(letter_table(spark, sf))))


def filing_manifest(spark, sf):
    """Where every letter goes."""
    return sinks.manifest(filing.outcomes(letter_table(spark, sf)))


# --- files written and read back ---------------------------------------------------------------

_SCANS = 4


def folder_scan(spark, sf):
    """A folder of files named like scans, made from the documents: how many scans, and how many bytes.

    A file is written by one task, so each scan comes in parts: brief0.0.pdf, brief1.0.PDF, ..., brief0.1.pdf, ...
    """
    path = fresh_path(spark, "inbox")
    # not dealt out on reading, so that the ranges read tell how large the table is; there are as many parts
    texts = _table(spark, sf, "documents").select("text")
    texts.repartition(max(_SCANS, texts.rdd.getNumPartitions())).write.text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder = at(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, found in enumerate(store.globStatus(at(folder, "part-*"))):
        part, scan = divmod(k, _SCANS)
        store.rename(found.getPath(), at(folder, f"brief{scan}.{part}.{'PDF' if scan % 2 else 'pdf'}"))
    name = F.substring_index("file", ".", 1)
    return files.scan_folder(spark, path).agg(F.count_distinct(name).alias("n_files"), F.sum("bytes").alias("bytes"))


def text_files(spark, sf):
    """Documents written as text files, a few to a file: characters read back, a line feed after each document."""
    path = fresh_path(spark, "texts")
    # a file is read as one value, so it must not grow with the table
    _documents(spark, sf).select(F.translate("text", "\r", " ")).write.option("maxRecordsPerFile", 64).text(path)
    return files.read_texts(spark, path, "part-*").agg(F.sum(F.length("text")).alias("n_chars"))


def blocklist_file(spark, sf):
    """Blocklist terms written as a file with a comment on top, and read back."""
    path = fresh_path(spark, "blocklist")
    terms = benchmark_terms(spark, sf).withColumn("term", F.translate("term", "\n", " "))
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("line_no"), F.lit("# terms").alias("term"))
    # files follow one another by their names, so there may be as many as there are ranges
    lines = head.unionByName(terms).repartitionByRange("line_no").sortWithinPartitions("line_no")
    lines.select(F.concat(F.lit("  "), "term")).write.text(path)
    return files.read_blocklist(spark, path).select(_long(F.col("line_no")).alias("line_no"), "term")


# a file is written by one task, so it must not grow with the table; readers take files by their names
_LIST_ROWS = 200_000


def _json_list(rows: DataFrame, order: str, path: str, head: str = "[", foot: str = "]", file_rows: int = _LIST_ROWS) -> None:
    """Rows (``order``, value) as JSON lists over many lines, one after the other: each file holds one, of ``file_rows`` at most."""
    numbered = running(rows, [], [order], "_n")
    last = numbered.agg(F.max("_n").alias("_last"))
    is_first, is_last = F.col("_n") % file_rows == 1 % file_rows, (F.col("_n") % file_rows == 0) | (F.col("_n") == last.scalar())
    opened = F.when(is_first, F.lit(head)).otherwise(F.lit(""))
    closed = F.when(is_last, F.lit(foot)).otherwise(F.lit(","))
    file_no = F.floor((F.col("_n") - 1) / file_rows).alias("_file")
    lines = numbered.select(file_no, "_n", F.concat(opened, "value", closed).alias("value"))
    # a task that gets several lists writes each to a file of its own, as all but the last have that many rows
    dealt = lines.repartitionByRange("_file").sortWithinPartitions("_n")
    dealt.select("value").write.option("maxRecordsPerFile", file_rows).text(path)


def rules_file(spark, sf):
    """Topic rules written as a JSON list, one per part, and read back by ranges: a part is found by words of its name."""
    path = fresh_path(spark, "rules")
    rules = _table(spark, sf, "part").select(
        "p_partkey",
        F.to_json(F.struct(
            F.concat(F.lit("[{"), F.col("p_partkey").cast("string"), F.lit('}] "'), F.col("p_type")).alias("key"),
            F.split("p_name", " ").alias("keywords"),
        )).alias("value"),
    )
    _json_list(rules, "p_partkey", path)
    back = files.read_rules(spark, path)
    return back.select(_long(F.col("priority")).alias("priority"), "category", F.array_join("keywords", "|").alias("keywords"))


def expectations_object(spark, sf):
    """Expectations as an object with a default and a list of cases: the usable ones, and why others are rejected."""
    path = fresh_path(spark, "cases")
    letter = letter_table(spark, sf).select("file", "k", "sender_line", "label", "date_text")
    case = F.when(F.col("k") % 13 == 5, F.to_json(F.array("file"))).otherwise(F.to_json(F.struct(
        F.when(F.col("k") % 7 != 3, F.col("file")).alias("file"),
        F.when(F.col("k") % 5 != 2, F.col("sender_line")).alias("sender_any"),
        F.when(F.col("k") % 3 == 0, F.array("label")).alias("content_any"),
        F.when(F.col("k") % 11 == 4, F.lit("video")).alias("input_type"),
        F.when(F.col("k") % 4 == 0, F.lit(False)).alias("cloud_safe"),
        F.struct(F.lit("a } and ] and \\\" in it").alias("note")).alias("more"),
    )))
    _json_list(letter.select("file", case.alias("value")), "file", path, '{"about": {"by": ["x"]}, "cloud_safe": true, "cases": [', '], "end": {}}')
    usable, rejected = files.read_expectations(spark, path)
    kept = usable.select(
        "case_no", "file", "id", F.array_join("sender_any", "|").alias("sender_any"), F.array_join("content_any", "|").alias("content_any"),
        "input_type", "cloud_safe", F.lit("").alias("reject_reason"),
    )
    out = rejected.select(
        "case_no", "file", F.lit("").alias("id"), F.lit("").alias("sender_any"), F.lit("").alias("content_any"), F.lit("").alias("input_type"),
        F.lit(False).alias("cloud_safe"), "reject_reason",
    )
    return kept.unionByName(out).withColumn("case_no", _long(F.col("case_no")))


def expectations_file(spark, sf):
    """Expectations of letters written as JSON rows, a scalar or a list each, and read back; those without any are out."""
    path = fresh_path(spark, "cases")
    cases = letter_table(spark, sf).selectExpr(
        "file", "case when k % 6 = 0 then null when k % 2 = 0 then sender_line end as sender_one", "k",
        "case when k % 2 = 1 then array('', sender_line) end as sender_list",
        "case when k % 10 = 4 then array() else array(label) end as content_any",
        "case when k % 6 = 0 then '' else date_text end as date", "k % 4 = 0 as cloud_safe",
    )
    shared = ["file", "content_any", "date", "cloud_safe"]
    lists = cases.where("k % 2 = 1").select(F.to_json(F.struct(*shared, F.col("sender_list").alias("sender_any"))).alias("value"))
    ones = cases.where("k % 2 = 0").select(F.to_json(F.struct(*shared, F.col("sender_one").alias("sender_any"))).alias("value"))
    lists.unionByName(ones).write.text(path)
    usable, _ = files.read_expectation_rows(spark, path)
    return usable.select(
        "file", "id", "input_type", F.array_join("sender_any", "|").alias("sender_any"),
        F.array_join("content_any", "|").alias("content_any"), "exp_date", "cloud_safe",
    )


def manifest_partitions(spark, sf):
    """The manifest written in partitions and read back: moves per outcome and topic."""
    path = fresh_path(spark, "manifest")
    rows = filing_manifest(spark, sf)
    sinks.write_manifest(rows, path)
    back = spark.read.parquet(path)
    topic = F.coalesce(F.col("done_category").cast("string"), F.lit(""))
    return back.groupBy("status", topic.alias("done_category")).agg(
        F.count("*").alias("n"), F.min("dest_path").alias("first_path")
    )


# --- run log and reports ---------------------------------------------------------------------------

def log_roundtrip(spark, sf):
    """The run log written as JSON lines, read back, finished files listed."""
    path = fresh_path(spark, "log")
    log = run_log(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    sinks.append_log(log.drop("event_id", "user_id", "ts"), path)
    return runlog.terminal_files(files.read_log(spark, path))


def _inbox(spark, sf):
    """Files that wait, one per customer; the log knows some of them."""
    number = F.col("c_custkey").cast("string")
    return _table(spark, sf, "customer").select(F.concat(F.lit("brief_"), number, F.lit(".pdf")).alias("file"))


def pending_docs(spark, sf):
    """Files in the inbox without a finished log row."""
    return runlog.pending(_inbox(spark, sf), run_log(spark, sf))


def reprocess_notice(spark, sf):
    """Files in the inbox that the log calls finished."""
    return runlog.reprocessed(_inbox(spark, sf), run_log(spark, sf))


def latest_log(spark, sf):
    """The current state of each file."""
    log = run_log(spark, sf).withColumn("timestamp", F.col("ts"))
    return runlog.latest(log.select("file", "timestamp", "event_id", "status", "engine", "suggested"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def latest_by_runs(spark, sf):
    """The current state of each file, kept over runs that each take what the log has gained."""
    path = fresh_path(spark, "state")
    log = run_log(spark, sf).withColumn("timestamp", F.col("ts"))
    # the second run brings rows of few users, so it leaves most of the state alone
    later = (F.col("event_id") % 4 == 3) & (F.col("user_id") % 97 == 0)
    log = log.select("file", "timestamp", "event_id", "status", "engine", "suggested", later.alias("later"))
    for run in (0, 1):
        latest.update_latest(log.where(F.col("later") == bool(run)).drop("later"), path, run)
    return latest.current_state(spark, path, log.drop("later").schema)


def running_eta(spark, sf):
    """Average time so far and time left, per engine's run."""
    log = run_log(spark, sf).select("engine", "event_id", "elapsed_s")
    return runlog.running_eta(log, "engine", "event_id")


def status_distribution(spark, sf):
    return _rounded(reports.status_distribution(run_log(spark, sf)), "share")


def confidence_distribution(spark, sf):
    return reports.confidence_distribution(run_log(spark, sf))


def log_category_counts(spark, sf):
    return reports.category_counts(run_log(spark, sf))


def error_reasons(spark, sf):
    return reports.error_reasons(run_log(spark, sf))


def timing_stats(spark, sf):
    return _rounded(reports.timing_stats(run_log(spark, sf)), "avg_s", "total_s")


def phase_stats(spark, sf):
    return _rounded(reports.phase_stats(run_log(spark, sf)), "avg_s", "total_s")


def cost_totals(spark, sf):
    return _rounded(reports.cost_totals(run_log(spark, sf)), "total_chf", "avg_chf", digits=9)


def run_summary(spark, sf):
    return _rounded(reports.run_summary(run_log(spark, sf)), "total_chf", "total_s", "avg_s")


def outcome_counters(spark, sf):
    return reports.outcome_counters(run_log(spark, sf))


def run_report(spark, sf):
    """The report of a run as one tidy table."""
    return _rounded(reports.run_report(run_log(spark, sf)), "value")


# --- evaluation --------------------------------------------------------------------------------------

def _expected(spark, sf):
    """Expected sender, content and date of each letter; some letters lack some of them."""
    return letter_table(spark, sf).select(
        "file",
        F.expr("case when k % 6 = 0 then array() else array('Niemand', split(sender_line, ' ')[0]) end").alias("sender_any"),
        F.expr("case when k % 10 = 3 then array() when k % 4 = 0 then array('Rechnung', 'Vollmacht') else array(label) end").alias("content_any"),
        F.expr("case when k % 6 = 0 then '' when k % 15 = 2 then '20200101' else date_text end").alias("exp_date"),
        F.lit(True).alias("cloud_safe"),
    )


def _responses(spark, sf):
    """What three models answered: the first as recorded, the others vary it."""
    models = F.explode(F.array(*[F.lit(label) for _, label, _ in MODELS])).alias("model")
    rows = letter_table(spark, sf).select(
        "file", "k", "label", "response", "analysis_message", "input_tokens", "output_tokens",
        "t_extract", models,
    )
    second, third = F.lit(MODELS[1][1]), F.lit(MODELS[2][1])
    response = (
        F.when(F.col("model") == second, F.replace("response", F.col("label"), F.lit("Rechnung")))
        .when(F.col("model") == third, F.replace("response", F.lit('"unknown"'), F.lit('"20240101"')))
        .otherwise(F.col("response"))
    )
    return rows.select(
        "file", "model", response.alias("response"), "input_tokens", "output_tokens",
        F.col("t_extract").alias("time_s"),
        F.when(F.col("model") == second, F.col("analysis_message")).alias("error"),
    )


def _results(spark, sf):
    texts = letter_table(spark, sf).select("file", "text")
    return evaluation.evaluate(_expected(spark, sf), texts, _responses(spark, sf), MODELS)


def field_scores(spark, sf):
    """Each model's answer to each letter, scored."""
    done = _results(spark, sf)
    return done.select(
        "model", "file", "sender_ok", "content_ok", "date_ok", "all_ok", "confidence", "time_s",
        F.round("cost_chf", 9).alias("cost_chf"), "error",
    )


def model_accuracy(spark, sf):
    done = scoring.model_accuracy(_results(spark, sf))
    return _rounded(done, "sender_pct", "content_pct", "date_pct", "all_pct", "avg_time_s")


def calibration(spark, sf):
    done = scoring.calibration(_results(spark, sf))
    return _rounded(done, "high_rate_pct", "high_correct_pct", "low_correct_pct")


def model_cost(spark, sf):
    return _rounded(scoring.model_cost(_results(spark, sf)), "total_chf", "avg_chf")


def eval_report(spark, sf):
    return _rounded(reports.eval_report(_results(spark, sf)), "value")


def label_calibration(spark, sf):
    """Do letters that redaction leaves untouched carry the good-quality label?"""
    docs = redact.redact(_documents(spark, sf)).select(
        "doc_id", (redact.redaction_total() == 0).alias("untouched")
    )
    results = docs.join(_table(spark, sf, "labels"), "doc_id").select(
        F.lit("untouched").alias("model"),
        (F.col("quality") == 1).alias("all_ok"),
        F.when(F.col("untouched"), F.lit("high")).otherwise(F.lit("low")).alias("confidence"),
        F.lit(None).cast("string").alias("error"),
    )
    return _rounded(scoring.calibration(results), "high_rate_pct", "high_correct_pct", "low_correct_pct")


def scores_without_cloud(spark, sf):
    """The same scores where some cases must not go to a cloud model: none of them does."""
    cases = _expected(spark, sf).withColumn("cloud_safe", ~F.contains("file", F.lit("7")))
    texts = letter_table(spark, sf).select("file", "text")
    done = evaluation.evaluate(cases, texts, _responses(spark, sf), MODELS)
    return done.select("model", "file", "all_ok", "confidence", F.round("cost_chf", 9).alias("cost_chf"), "error")


def run_report_quality(spark, sf):
    """The quality section of a run's report, from the letters' expectations."""
    log = sinks.log_rows(filing.outcomes(letter_table(spark, sf)))
    report = reports.run_report(log, _wanted(spark, sf)).where("section = 'quality'")
    return _rounded(report, "value")


def _wanted(spark, sf):
    return letter_table(spark, sf).select(
        "file",
        F.expr("array('Niemand', split(sender_line, ' ')[0])").alias("sender_any"),
        F.expr("case when k % 4 = 0 then array('Rechnung', 'Vollmacht') else array(label) end").alias("content_any"),
        F.expr("date_text").alias("exp_date"),
    )


def rename_quality(spark, sf):
    """Renamed letters against expected sender, content and date."""
    log = filing.outcomes(letter_table(spark, sf))
    return _rounded(scoring.rename_quality(log, _wanted(spark, sf)), "match_rate", "high_conf_rate")


# --- streaming -----------------------------------------------------------------------------------------

def _streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is, and read what it appended."""
    path = fresh_path(spark, name)
    jobs.append_parquet(stream, path, fresh_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_log_stream(spark, sf):
    return with_phases(shape_events(jobs.table_stream(spark, sf, "events.parquet", EVENTS)))


def stream_redact_counts(spark, sf):
    """Documents redacted as a stream; hits per language from the appended table."""
    docs = jobs.table_stream(spark, sf, "documents.parquet", DOCUMENTS)
    done = _streamed(spark, jobs.redacted_stream(docs).select("doc_id", "lang", *redact.COUNT_COLUMNS.values()), "redacted")
    return done.groupBy("lang").agg(*[F.sum(_long(F.col(c))).alias(c) for c in redact.COUNT_COLUMNS.values()])


def stream_counters(spark, sf):
    """Live counters per engine and status."""
    path = fresh_path(spark, "counters")
    counts = jobs.outcome_counts(_event_log_stream(spark, sf))
    jobs.keep_counters(counts, path, fresh_path(spark, "counters-checkpoint")).awaitTermination()
    return jobs.current_counters(spark, path)


def stream_window_stats(spark, sf):
    """Hourly statistics; hours the watermark has not passed yet are still open."""
    done = _streamed(spark, jobs.hourly_stats(_event_log_stream(spark, sf)), "hourly")
    done = done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return _rounded(done, "total_chf", "avg_s")


def stream_first_deliveries(spark, sf):
    """Files delivered, each once."""
    log = _event_log_stream(spark, sf).select("file", "ts")
    done = _streamed(spark, jobs.first_deliveries(log, within="60 days"), "deliveries")
    return done.select("file")


ARRIVALS, WITHIN, LATE = 6, "3 days", "2 days"


def arrivals(spark, sf, folder: str) -> None:
    """The log as it came in: one file after the other, some rows two files later than their time says."""
    log = run_log(spark, sf).select("file", "event_id", "ts")
    moment = F.unix_millis(F.col("ts").cast("timestamp"))
    ends = log.agg(F.min(moment).alias("lo"), F.max(moment).alias("hi")).first()
    if ends.lo is None:
        return
    part = F.floor((moment - ends.lo) * ARRIVALS / (ends.hi - ends.lo + 1)).cast("int")
    come = log.withColumn("part", F.least(part + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0), F.lit(ARRIVALS - 1)))
    dealt = fresh_path(spark, "dealt")
    come.write.partitionBy("part").parquet(dealt)
    # each file is written from its own rows, not from all
    for k in range(ARRIVALS):
        spark.read.schema(come.schema).parquet(dealt).where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(folder)


def stream_deliveries(spark, sf):
    """Deliveries over a window shorter than the data: first ones, copies, and those too late to tell."""
    folder, path = fresh_path(spark, "arrivals"), fresh_path(spark, "deliveries")
    arrivals(spark, sf, folder)
    log = jobs.table_stream(spark, folder, "*.parquet", run_log(spark, sf).select("file", "event_id", "ts").schema, files_per_batch=1)
    told = deliveries.deliveries(log, "event_id", within=WITHIN, late=LATE)
    deliveries.append_deliveries(told, path, fresh_path(spark, "deliveries-checkpoint")).awaitTermination()
    return spark.read.schema(told.schema).parquet(path)


def stream_filing(spark, sf):
    """Letters filed as a stream; outcomes per engine, status and topic."""
    stream = jobs.table_stream(spark, letter_folder(spark, sf), "*.parquet", letter_table(spark, sf).schema)
    done = _streamed(spark, jobs.filed_stream(stream), "filed")
    return done.groupBy("engine", "status", "done_category").agg(F.count("*").alias("n"))


QUERIES = {
    "redaction_counts_by_lang": redaction_counts_by_lang,
    "redaction_counts_by_engine": redaction_counts_by_engine,
    "letters": letters,
    "redact_iban": _one_rule("[IBAN]"),
    "redact_ahv": _one_rule("[AHV]"),
    "redact_email": _one_rule("[EMAIL]"),
    "redact_phone": _one_rule("[TELEFON]"),
    "redact_amount": _one_rule("[BETRAG]"),
    "redact_address": _one_rule("[ADRESSE]"),
    "redact_title": _one_rule("[BEHANDLER]"),
    "redact_chain": redact_chain,
    "redact_documents": redact_documents,
    "redact_pages": redact_pages,
    "redact_conversations": redact_conversations,
    "redaction_map": redaction_map,
    "redaction_totals": redaction_totals,
    "scan_detection": scan_detection,
    "blocklist_redact": blocklist_redact,
    "blocklist_table_redact": blocklist_table_redact,
    "leak_verify": leak_verify,
    "leak_verify_documents": leak_verify_documents,
    "placeholder_tally": placeholder_tally,
    "letter_dates": letter_dates,
    "month_numbers": month_numbers,
    "ascii_part": ascii_part,
    "safe_filename": safe_filename,
    "quality_keys": quality_keys,
    "proposed_names": proposed_names,
    "unique_names": unique_names,
    "original_unique_names": unique_original_names,
    "names_after_earlier_runs": names_after_earlier_runs,
    "clashing_names": clashing_names,
    "category_assign": category_assign,
    "category_by_table": category_by_table,
    "category_documents": category_documents,
    "category_counts": category_counts,
    "parse_responses": parse_responses,
    "date_override": date_override,
    "request_table": request_table,
    "token_cost": token_cost,
    "rule_extract": rule_extract,
    "route_outcomes": route_outcomes,
    "manual_decisions": manual_decisions,
    "uncertain_fields": uncertain_fields,
    "error_classes": error_classes,
    "retry_plan": retry_plan,
    "filing_run": filing_run,
    "filing_phases": filing_phases,
    "filing_manifest": filing_manifest,
    "folder_scan": folder_scan,
    "text_files": text_files,
    "blocklist_file": blocklist_file,
    "rules_file": rules_file,
    "expectations_file": expectations_file,
    "expectations_object": expectations_object,
    "manifest_partitions": manifest_partitions,
    "log_roundtrip": log_roundtrip,
    "pending_docs": pending_docs,
    "reprocess_notice": reprocess_notice,
    "latest_log": latest_log,
    "latest_by_runs": latest_by_runs,
    "running_eta": running_eta,
    "status_distribution": status_distribution,
    "confidence_distribution": confidence_distribution,
    "log_category_counts": log_category_counts,
    "error_reasons": error_reasons,
    "timing_stats": timing_stats,
    "phase_stats": phase_stats,
    "cost_totals": cost_totals,
    "run_summary": run_summary,
    "outcome_counters": outcome_counters,
    "run_report": run_report,
    "run_report_quality": run_report_quality,
    "rename_quality": rename_quality,
    "scores_without_cloud": scores_without_cloud,
    "field_scores": field_scores,
    "model_accuracy": model_accuracy,
    "calibration": calibration,
    "model_cost": model_cost,
    "eval_report": eval_report,
    "label_calibration": label_calibration,
    "stream_redact_counts": stream_redact_counts,
    "stream_counters": stream_counters,
    "stream_window_stats": stream_window_stats,
    "stream_first_deliveries": stream_first_deliveries,
    "stream_deliveries": stream_deliveries,
    "stream_filing": stream_filing,
}
