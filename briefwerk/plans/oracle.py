"""The registered queries in SQL, for the checking engine."""

from functools import reduce

from .. import fixed
from ..functions import requests as q
from ..functions.dialect import re2
from ..operators.extract import DOCUMENT_TYPES, LEGAL_SUFFIXES
from . import queries as Q
from .letters import LOG_SQL, PHASES
from .letters import SQL as LETTERS


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = {label: _lit(re2(p, ic)) for label, ic, p in fixed.REDACTION_RULES}
_COLUMN = {label: f"n_{label.strip('[]').lower()}" for label in [*_RULES, fixed.BLOCKLIST_LABEL]}


def _count(text: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, {pattern})), 0)"


def _replace(text: str, pattern: str, label: str) -> str:
    return f"regexp_replace({text}, {pattern}, '{label}', 'g')"


def _chain(source: str, text: str, terms=()) -> str:
    """source plus redacted_text and the count columns."""
    steps = [(label, pattern) for label, pattern in _RULES.items()]
    steps += [(fixed.BLOCKLIST_LABEL, _lit("(?i)" + _quote(t))) for t in terms]
    sql = f"select *, {text} as s0 from ({source})"
    for i, (label, pattern) in enumerate(steps):
        sql = (
            f"select *, {_replace(f's{i}', pattern, label)} as s{i + 1}, "
            f"{_count(f's{i}', pattern)} as c{i} from ({sql})"
        )
    counts = {label: [f"c{i}" for i, (name, _) in enumerate(steps) if name == label] for label in _COLUMN}
    out = [f"cast({' + '.join(cs) if cs else 0} as bigint) as {_COLUMN[label]}" for label, cs in counts.items()]
    return f"select *, s{len(steps)} as redacted_text, {', '.join(out)} from ({sql})"


def _quote(term: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|&" else c for c in term)


def _summary(source: str, by: str, text: str) -> str:
    parts = [
        f"select {by}, '{label}' as label, count(*) filter ({c} > 0) as n_docs, cast(sum({c}) as bigint) as n_hits "
        f"from r group by {by}"
        for label, c in _COLUMN.items()
    ]
    return (
        f"with r as materialized ({_chain(source, text)}) "
        f"select * from ({' union all '.join(parts)}) where n_hits > 0"
    )


def _one_rule(label: str) -> str:
    p = _RULES[label]
    return f"select file, {_replace('text', p, label)} as redacted, cast({_count('text', p)} as bigint) as n from ({LETTERS})"


_COUNTS = ", ".join(_COLUMN.values())
_TOTAL = " + ".join(_COLUMN.values())
_SPACE = re2(r"\s")
_BLANK = f"(text is null or not regexp_matches(text, {_lit(re2('[^\\s]'))}))"

# --- leak check; look-behind becomes an alternative that may take the character before
_AHV, _PHONE = (p for _, p in fixed.LEAK_RULES)
_PHONE = _PHONE.replace(r"(?<!\d)", r"(?:^|\P{Nd})")
_LEAKS = (
    "concat_ws(', ', case when regexp_matches({t}, " + _lit(re2(_AHV)) + ") then 'AHV' end, "
    "case when regexp_matches({t}, " + _lit(re2(_PHONE)) + ") then 'Telefon (CH)' end)"
)


def _leaks(text: str) -> str:
    return _LEAKS.replace("{t}", text)


# --- names
def _fold(text: str) -> str:
    return f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"


def _part(text: str) -> str:
    return (
        f"coalesce(nullif(trim(regexp_replace({_fold(text)}, '[^A-Za-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"
    )


def _key(text: str) -> str:
    return f"lower({_part(text)})"


def _safe(name: str) -> str:
    stem = _part(f"regexp_replace({name}, '(?i)\\.pdf$', '')")
    return f"rtrim(substr({stem}, 1, 176), '-') || '.pdf'"


def _proposed(sender: str, content: str, date: str) -> str:
    return _safe(f"({sender} || '-' || {content} || '-' || {date} || '.pdf')")


_PROPOSED = f"select file, {_proposed('sender_line', 'label', 'date_text')} as name from ({LETTERS})"


def _category(key: str) -> str:
    arms = " ".join(
        "when " + " or ".join(f"contains({key}, {_lit(k)})" for k in keywords) + f" then {_lit(name)}"
        for name, keywords in fixed.DEFAULT_CATEGORIES
        if keywords
    )
    return f"case {arms} else '{fixed.DEFAULT_CATEGORIES[-1][0]}' end"


_CATEGORISED = f"select file, name, {_category('k')} as category from (select *, {_key('name')} as k from ({_PROPOSED}))"


def _numbered(stem: str, n: str, suffix: str, base: str) -> str:
    marker = f"('-' || cast({n} as varchar))"
    return (
        f"case when {n} = 1 then {base} else "
        f"rtrim(substr({stem}, 1, 176 - length({marker})), '-') || {marker} || '{suffix}' end"
    )


# --- dates
_DATE = _lit(re2(fixed.LETTER_DATE, True))
_MONTHS = "case {m} " + " ".join(f"when '{k}' then {v}" for k, v in fixed.MONTHS.items()) + " end"


def _month(name: str) -> str:
    raw = f"lower(rtrim({name}, '.'))"
    folded = f"translate({raw}, 'äöü', 'aou')"
    return f"coalesce({_MONTHS.replace('{m}', folded)}, {_MONTHS.replace('{m}', raw)})"


def _dated(source: str, text: str, into: str) -> str:
    """source plus the date in the head of a text."""
    head = f"substr({text}, 1, {fixed.LETTER_HEAD_CHARS})"
    a = f"select *, regexp_extract({head}, {_DATE}, ['d', 'm', 'y']) as g from ({source})"
    b = f"select *, try_cast(g.y as int) as yy, try_cast(g.d as int) as dd, {_month('g.m')} as mm from ({a})"
    return (
        f"select *, case when mm is not null and yy between {fixed.YEAR_MIN} and {fixed.YEAR_MAX} "
        f"and dd between 1 and 31 then cast(yy as varchar) || lpad(cast(mm as varchar), 2, '0') "
        f"|| lpad(cast(dd as varchar), 2, '0') end as {into} from ({b})"
    )


# --- responses
# the message of a response without an object quotes it; the message is classed like any other
_NO_OBJECT, _TYPE = "'kein json-objekt: ' || coalesce(response, '')", "'ValueError'"


def _answers(source: str) -> str:
    """source plus sender, content, date0, confidence0 and answer_error."""
    fragment = "nullif(regexp_extract(response, '(?s)\\{[^{}]+\\}'), '')"
    a = f"select *, try_cast(response as json) as whole, {fragment} as fragment from ({source})"
    b = f"select *, coalesce(whole, try_cast(fragment as json)) as a from ({a})"
    c = f"select *, json_type(a) = 'OBJECT' as is_object from ({b})"

    def field(key: str, default: str) -> str:
        return f"case when is_object then coalesce(json_extract_string(a, '$.{key}'), '{default}') end"

    return (
        f"select *, {field('sender', 'unknown')} as sender, {field('content', 'unknown')} as content, "
        f"{field('date', 'unknown')} as date0, {field('confidence', 'low')} as confidence0, "
        f"case when whole is null and fragment is null then {_error_class(_NO_OBJECT, _TYPE)} when a is null then 'JSONDecodeError' "
        f"when not is_object then 'AttributeError' end as answer_error from ({c})"
    )


def _with_hint(date: str, hint: str) -> str:
    return f"case when {hint} is not null and not regexp_matches({date}, '^[0-9]{{8}}$') then {hint} else {date} end"


_COST = (
    f"(input_tokens * cast({fixed.PRICE_IN} as double) + output_tokens * cast({fixed.PRICE_OUT} as double)) "
    f"/ 1e6 * cast({fixed.CHF_PER_USD} as double)"
)


def _error_class(message: str, type_name: str) -> str:
    arms = " ".join(
        "when " + " or ".join(f"contains(lower({message}), '{m}')" for m in marks) + f" then '{name}'"
        for name, marks in fixed.ERROR_CLASSES
    )
    return f"case {arms} else {type_name} end"


# --- routing
_REDACTED = _chain(LETTERS, "text")
_ROUTED = f"""
select *, case when stop = 'review' then 'review' when stop <> '' then 'skipped'
  when confidence0 = 'low' then 'unrecognized' else 'renamed' end as status
from (
  select *,
    case when read_message is not null
           then case when engine = 'hybrid' then 'analyse:' else 'lesen:' end || {_error_class('read_message', 'read_type')}
         when engine = 'hybrid' and {_BLANK} then 'analyse:pdf-read-error'
         when engine = 'claude' and {_BLANK} then 'review'
         when engine = 'hybrid' and {_leaks('anonymized_text')} <> '' then 'review'
         when analysis_message is not null then 'analyse:' || {_error_class('analysis_message', 'analysis_type')}
         when answer_error is not null then 'analyse:' || answer_error
         else '' end as stop,
    case when read_message is not null then 0
         when engine = 'hybrid' then case when {_BLANK} then 0 else t_anonymize + t_regex
           + case when {_leaks('anonymized_text')} <> '' then 0 else t_extract end end
         when engine = 'claude' and {_BLANK} then 0
         else t_extract end as took,
    {_with_hint('date0', "case when engine = 'ollama' then hint end")} as date
  from ({_dated(_answers(_REDACTED), 'redacted_text', 'hint')})
)"""
_OUTCOMES = f"""
select *, case status when 'renamed' then 'high' when 'unrecognized' then 'low' else 'n/a' end as confidence,
  case when status = 'skipped' then stop else '' end as error_reason,
  case when status = 'renamed' then {_proposed('sender', 'content', 'date')} end as proposed_name,
  case when status in ('renamed', 'unrecognized') and engine <> 'ollama' then {_COST} else 0 end as cost_chf
from ({_ROUTED})"""
_FILED = f"""
select *, case when status = 'renamed' then {_numbered("substr(proposed_name, 1, length(proposed_name) - 4)", 'n', '.pdf', 'proposed_name')}
    else file end as final_name
from (select *, row_number() over (partition by status = 'renamed', done_category, proposed_name order by file) as n
  from (select *, case when status = 'renamed' then {_category(_key('proposed_name'))} else '' end as done_category
    from ({_OUTCOMES})))"""
# one entry per phase a letter went through
_FILED_PHASES = f"""
select 'anonymize' as phase, round_even(t_anonymize, 2) as s from f where engine = 'hybrid' and status <> 'skipped'
union all select 'regex', round_even(t_regex, 2) from f where engine = 'hybrid' and status <> 'skipped'
union all select case when engine = 'hybrid' then 'claude' else 'analysis' end, round_even(t_extract, 2)
  from f where status in ('renamed', 'unrecognized')"""


# --- reports
def _log(sql: str) -> str:
    return f"with log as ({LOG_SQL}) {sql}"


_PHASE_ROWS = " union all ".join(
    f"select '{p}' as phase, t_{p} as s from log where t_{p} is not null" for p in PHASES
)
_PHASE_STATS = f"""select phase, min(s) as min_s, max(s) as max_s, round(avg(s), 6) as avg_s, round(sum(s), 6) as total_s
from ({{rows}}) group by phase"""
_STATUSES = " union all ".join(f"select {i} as place, '{s}' as status" for i, s in enumerate(fixed.STATUSES, 1))
_CONFIDENCES = " union all ".join(
    f"select {i} as place, '{c}' as confidence" for i, c in enumerate(fixed.CONFIDENCES, 1)
)
_TOTALS = """(select coalesce(sum(elapsed_s) filter (elapsed_s > 0), 0) from log)"""
_STATUS_DIST = f"""select cast(d.place as bigint) as place, d.status, count(l.status) as n,
  round(count(l.status) / (select count(*) from log), 6) as share
from ({_STATUSES}) d left join log l on l.status = d.status group by all
union all select 5, 'total', count(*), 1 from log"""
_CONF_DIST = f"""select cast(d.place as bigint) as place, d.confidence, count(l.status) as n
from ({_CONFIDENCES}) d left join log l on coalesce(l.confidence, 'n/a') = d.confidence group by all"""
_TIMING = """select min(elapsed_s) as min_s, max(elapsed_s) as max_s, round(coalesce(avg(elapsed_s), 0), 6) as avg_s,
  round(coalesce(sum(elapsed_s), 0), 6) as total_s from log where elapsed_s > 0"""
_COSTS = "select round(sum(cost_chf), 9) as total_chf, round(sum(cost_chf) / count(*), 9) as avg_chf from log"


def _metrics(section: str, key: str, sql: str, names) -> str:
    return " union all ".join(
        f"select '{section}' as section, {key} as key, '{n}' as metric, cast({n} as double) as value from ({sql})"
        for n in names
    )


_REPORT = " union all ".join(
    [
        _metrics("status", "status", f"select * from ({_STATUS_DIST}) where place < 5", ["n", "share"]),
        _metrics("confidence", "confidence", _CONF_DIST, ["n"]),
        _metrics("category", "done_category", "select done_category, count(*) as n from log where done_category <> '' group by all", ["n"]),
        _metrics("error", "error_reason", "select error_reason, count(*) as n from log where error_reason <> '' group by all", ["n"]),
        _metrics("run", "'all'", "select count(*) as n from log", ["n"]),
        _metrics("run", "'all'", _TIMING, ["min_s", "max_s", "avg_s", "total_s"]),
        _metrics("run", "'all'", "select round(sum(cost_chf), 6) as total_chf, round(sum(cost_chf) / count(*), 6) as avg_chf from log", ["total_chf", "avg_chf"]),
        _metrics("phase", "phase", _PHASE_STATS.replace("{rows}", _PHASE_ROWS), ["min_s", "max_s", "avg_s", "total_s"]),
    ]
)

# --- evaluation
_EXPECTED = f"""
select file, case when k % 6 = 0 then [] else ['Niemand', split_part(sender_line, ' ', 1)] end as sender_any,
  case when k % 10 = 3 then [] when k % 4 = 0 then ['Rechnung', 'Vollmacht'] else [label] end as content_any,
  case when k % 6 = 0 then '' when k % 15 = 2 then '20200101' else date_text end as exp_date
from ({LETTERS})"""
_A, _B, _C = (label for _, label, _ in Q.MODELS)
_ANSWERED = f"""
select file, text, hint, m.model, input_tokens, output_tokens, t_extract,
  case m.model when '{_B}' then replace(response, label, 'Rechnung')
    when '{_C}' then replace(response, '"unknown"', '"20240101"') else response end as response,
  case when m.model = '{_B}' then analysis_message end as model_error
from ({_dated(_REDACTED, 'redacted_text', 'hint')}), (values ('{_A}'), ('{_B}'), ('{_C}')) m(model)"""


def _any_match(expected: str, actual: str) -> str:
    key = _key(actual)
    tests = reduce(
        lambda a, b: f"{a} or {b}",
        [f"({expected}[{i}] is not null and contains({key}, {_key(f'{expected}[{i}]')}))" for i in (1, 2)],
    )
    return f"case when len({expected}) > 0 then coalesce({tests}, false) end"


_SCORED = f"""
select *, case when error is null then
    coalesce(sender_ok0, content_ok0, date_ok0) is not null
    and coalesce(sender_ok0, true) and coalesce(content_ok0, true) and coalesce(date_ok0, true) end as all_ok,
  case when error is null then sender_ok0 end as sender_ok, case when error is null then content_ok0 end as content_ok,
  case when error is null then date_ok0 end as date_ok, case when error is null then confidence0 end as confidence,
  case when error is null then t_extract else 0 end as time_s,
  case when error is null and contains(model, '(claude)') then {_COST} else 0 end as cost_chf
from (
  select *, {_any_match('sender_any', 'sender')} as sender_ok0, {_any_match('content_any', 'content')} as content_ok0,
    case when exp_date <> '' then coalesce(date = exp_date, false) end as date_ok0,
    case when {_BLANK} then 'no-text' when model_error is not null then substr(model_error, 1, 100) else answer_error end as error
  from (
    select *, case when contains(model, '(ollama)') then {_with_hint('date0', 'hint')} else date0 end as date
    from ({_answers(_ANSWERED)}) join ({_EXPECTED}) using (file)))"""


def _pct(column: str) -> str:
    return f"round(avg(cast({column} as int)) filter (error is null) * 100, 6)"


_ACCURACY = f"""
select model, {_pct('sender_ok')} as sender_pct, {_pct('content_ok')} as content_pct, {_pct('date_ok')} as date_pct,
  case when count(*) filter (error is null) > 0 then round(count(*) filter (all_ok) / count(*) * 100, 6) end as all_pct,
  count(*) filter (all_ok) as n_all_ok, count(*) filter (error is not null) as errors,
  round(avg(time_s) filter (error is null), 6) as avg_time_s, count(*) filter (error is null) as evaluated,
  count(*) as cases
from (select * from s) group by model"""


def _calibration(source: str) -> str:
    return f"""
select model, round(avg(cast(confidence = 'high' as int)) * 100, 6) as high_rate_pct,
  round(coalesce(avg(cast(all_ok as int)) filter (confidence = 'high'), 0) * 100, 6) as high_correct_pct,
  round(coalesce(avg(cast(all_ok as int)) filter (confidence <> 'high'), 0) * 100, 6) as low_correct_pct
from ({source}) where error is null group by model"""


_MODEL_COST = f"""
select model, round(sum(cost_chf), 6) as total_chf, round(sum(cost_chf) / count(*), 6) as avg_chf
from s where error is null and model = '{_C}' group by model"""
_EVAL = f"with s as materialized ({_SCORED}) "

_NAMED_SOURCES = "select doc_id, source, 'inbox' as dir from documents"
_SLOT = "case when slot = 1 then source || '.txt' else source || '-' || slot || '.txt' end"
_TERM_ROWS = "select item_id, text as term from benchmark"
_FAILURES = """
select event_id, user_id % 7 as attempt, 'OSError' as type_name,
  case event_id % 9 when 0 then 'Invalid API_KEY' when 1 then 'Read timed out' when 2 then 'HTTP 429, timeout'
    when 3 then 'status 429' when 4 then 'OVERLOADED' when 5 then 'could not parse JSON' when 6 then 'broken PDF'
    when 7 then 'EOF marker not found' else 'disk full' end as message,
  case event_id % 5 when 0 then '0.5' when 1 then '17' when 2 then 'soon' when 3 then '' end as retry_after
from events where event_type = 'error'"""
_INBOX = "select 'brief_' || c_custkey || '.pdf' as file from customer"
_FINISHED = "select file from log where status in ('renamed', 'unrecognized', 'review')"
_KINDS = {kind: [label for label, k in DOCUMENT_TYPES if k == kind] for kind in ("statement", "certificate")}
_TYPE = "case " + " ".join(
    f"when contains(lower(text), '{label.lower()}') then '{label}'" for label, _ in DOCUMENT_TYPES
) + " end"
_PERIOD = re2(r"\d{1,2}\.\d{1,2}\.(?:\d{4})?\s*[–\-]\s*(\d{1,2})\.(\d{1,2})\.(\d{4})")
_SUFFIX = _lit(f"(?:{_SPACE}+(?:{'|'.join(LEGAL_SUFFIXES)}))+{_SPACE}*$")


def _period(i: int) -> str:
    return f"regexp_extract(text, {_lit(_PERIOD)}, {i})"


_LINE = f"regexp_extract(text, {_lit(re2('([^\\s][^\\n]*)'))}, 1)"
_EXTRACTED = f"""
select file, nullif(regexp_replace(regexp_replace(regexp_replace({_LINE}, '{_SPACE}+$', ''), {_SUFFIX}, ''), '{_SPACE}+', '-', 'g'), '') as sender,
  {_TYPE} as content,
  case when {_TYPE} in ({', '.join(map(_lit, _KINDS['statement']))}) then
         case when {_period(3)} <> '' then {_period(3)} || lpad({_period(2)}, 2, '0') || lpad({_period(1)}, 2, '0') end
       when {_TYPE} in ({', '.join(map(_lit, _KINDS['certificate']))}) then
         nullif(regexp_extract(text, '(?i)(?:Vorsorgeausweis|Jahresabschluss)[^0-9]{{0,20}}(20[0-9]{{2}})', 1), '') || '1231'
       else head_date end as date
from ({_dated(LETTERS, 'text', 'head_date')})"""
_STREAM_LAST = "(select max(ts) from log) - interval 2 hour"

_RENAME_QUALITY = f"""
        with e as (select file, ['Niemand', split_part(sender_line, ' ', 1)] as sender_any,
            case when k % 4 = 0 then ['Rechnung', 'Vollmacht'] else [label] end as content_any,
            date_text as exp_date from ({LETTERS})),
        j as (select *, case when status = 'renamed' then final_name else file end as suggested
          from (select file, status, confidence, final_name from ({_FILED})) join e using (file)),
        m as (select confidence, status = 'renamed' and {_any_match('sender_any', 'suggested')}
            and {_any_match('content_any', 'suggested')} and contains({_key('suggested')}, exp_date) as ok from j)
        select count(*) as evaluated, count(*) filter (ok) as matches,
          round(count(*) filter (ok) / count(*), 6) as match_rate, count(*) filter (confidence = 'high') as high_conf,
          round(count(*) filter (confidence = 'high') / count(*), 6) as high_conf_rate,
          cast(0.9 as double) as target_high_conf_rate from m"""

ORACLE = {
    "redaction_counts_by_lang": _summary("select * from documents", "lang", "text"),
    "redaction_counts_by_engine": _summary(LETTERS, "engine", "text"),
    "letters": LETTERS,
    "redact_iban": _one_rule("[IBAN]"),
    "redact_ahv": _one_rule("[AHV]"),
    "redact_email": _one_rule("[EMAIL]"),
    "redact_phone": _one_rule("[TELEFON]"),
    "redact_amount": _one_rule("[BETRAG]"),
    "redact_address": _one_rule("[ADRESSE]"),
    "redact_title": _one_rule("[BEHANDLER]"),
    "redact_chain": f"select file, redacted_text, {_COUNTS} from ({_REDACTED})",
    "redact_documents": f"select doc_id, redacted_text, {_COUNTS} from ({_chain('select * from documents', 'text')})",
    "redact_pages": f"select page_id, redacted_text, {_COUNTS} from ({_chain('select * from pages', 'html')})",
    "redact_conversations": f"""select role, count(*) as turns, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in _COLUMN.values())}
        from ({_chain('select role, text from conversations', 'text')}) group by role""",
    "redaction_map": f"with r as materialized ({_REDACTED}) select * from ("
    + " union all ".join(f"select file, '{label}' as label, {c} as n from r" for label, c in _COLUMN.items())
    + ") where n > 0",
    "redaction_totals": f"select file, {_TOTAL} as n_redactions from ({_chain(LETTERS, 'text', Q.TERMS)})",
    "scan_detection": f"select file, {_BLANK} as is_scanned, case when not {_BLANK} then redacted_text end as redacted_text from ({_REDACTED})",
    "blocklist_redact": f"select file, redacted_text, n_name from ({_chain(LETTERS, 'text', Q.TERMS)})",
    "blocklist_table_redact": f"""
        select doc_id, acc.t as redacted_text, cast(acc.n as bigint) as n_name from (
          select doc_id, list_reduce(terms, lambda a, b: {{
              't': regexp_replace(a.t, '(?i)' || regexp_escape(b.t), '[NAME]', 'g'),
              'n': a.n + len(regexp_extract_all(a.t, '(?i)' || regexp_escape(b.t)))}}, {{'t': text, 'n': 0}}) as acc
          from documents, (select list({{'t': term, 'n': 0}} order by item_id) as terms from ({_TERM_ROWS}) where term <> ''))""",
    "leak_verify": f"""
        select file, {_leaks('anonymized_text')} as labels,
          case when {_leaks('anonymized_text')} <> '' then 'REVIEW' else 'CLEAN' end as verdict,
          nullif(regexp_extract(anonymized_text, {_lit(re2(_AHV))}), '') as ahv_snippet,
          nullif(regexp_replace(regexp_extract(anonymized_text, {_lit(re2(_PHONE))}), '^[^0-9+]', ''), '') as phone_snippet
        from ({LETTERS})""",
    "leak_verify_documents": f"select doc_id, {_leaks('text')} as labels from documents",
    "placeholder_tally": f"""
        select engine, label, count(*) as n from (
          select engine, unnest(regexp_extract_all(anonymized_text, {_lit(fixed.PLACEHOLDER)})) as label from ({LETTERS}))
        group by all""",
    "letter_dates": f"select file, letter_date from ({_dated(LETTERS, 'text', 'letter_date')})",
    "month_numbers": f"""
        select month_name, cast({_month('month_name')} as bigint) as month_no, count(*) as n from (
          select regexp_extract(text, '\\n[^\\n]*, [0-9]{{1,2}}\\. (\\S+) [0-9]{{4}}\\n', 1) as month_name from ({LETTERS}))
        where month_name <> '' group by all""",
    "ascii_part": f"select doc_id, {_part('text')} as part from documents",
    "safe_filename": f"select doc_id, {_safe('text')} as name from documents",
    "quality_keys": f"""
        select {_key('sender_line')} as sender_key, {_key('label')} as label_key, count(*) as n
        from ({LETTERS}) group by all""",
    "proposed_names": _PROPOSED,
    "unique_names": f"""
        select file, category, {_numbered('substr(name, 1, length(name) - 4)', 'n', '.pdf', 'name')} as final_name
        from (select *, row_number() over (partition by category, name order by file) as n from ({_CATEGORISED}))""",
    "original_unique_names": f"""
        select doc_id, {_SLOT} as final_name from (
          select *, row_number() over (partition by source order by doc_id) as slot from ({_NAMED_SOURCES}))""",
    "names_after_earlier_runs": f"""
        with held as (
          select 'src' || n_nationkey as source, slot from nation, (values (1), (2), (5)) v(slot)
          where slot <> 1 or n_regionkey <> 2),
        free as (
          select source, slot, row_number() over (partition by source order by slot) as n
          from (select source, unnest(range(1, 4 + count(*))) as slot from documents group by source) s
          where not exists (select 1 from held h where h.source = s.source and h.slot = s.slot))
        select doc_id, {_SLOT} as final_name from (
          select *, row_number() over (partition by source order by doc_id) as n from documents) d
        join free using (source, n)""",
    # one file after the other, each with the names its folder holds by then
    "clashing_names": """
        with recursive asked as (
          select doc_id, doc_id % 50 as grp, row_number() over (partition by doc_id % 50 order by doc_id) as k,
            'brief' || doc_id % 50 || case when doc_id % 3 = 0 then '' else '-' || (doc_id % 9 + 2) end as stem
          from documents),
        served as (
          select grp, k, doc_id, stem || '.pdf' as final_name, [stem || '.pdf'] as names from asked where k = 1
          union all
          select grp, k, doc_id, name, list_append(names, name) from (
            select a.grp, a.k, a.doc_id, s.names, case when not list_contains(s.names, a.stem || '.pdf') then a.stem || '.pdf'
              else a.stem || '-' || list_filter(range(2, len(s.names) + 3), lambda n: not list_contains(s.names, a.stem || '-' || n || '.pdf'))[1] || '.pdf'
              end as name
            from served s join asked a on a.grp = s.grp and a.k = s.k + 1))
        select doc_id, final_name from served""",
    "category_assign": _CATEGORISED,
    "category_by_table": _CATEGORISED,
    "category_documents": f"""
        select lang, {_category('k')} as category, count(*) as n
        from (select lang, {_key('text')} as k from documents) group by all""",
    "category_counts": f"select category as done_category, count(*) as n from ({_CATEGORISED}) group by all",
    "parse_responses": f"""
        select file, sender, content, date0 as date, confidence0 as confidence, answer_error as error
        from ({_answers(LETTERS)})""",
    "date_override": f"""
        select file, hint, {_with_hint('date0', 'hint')} as date
        from ({_dated(_answers(LETTERS), 'text', 'hint')})""",
    "request_table": f"""
        select file, engine, concat_ws(chr(10) || chr(10), {_lit(q.INSTRUCTIONS)},
          case when engine = 'ollama' then 'The letter head shows the date ' || hint || '.' end, sent) as request
        from ({_dated(f"select *, case when engine = 'hybrid' then anonymized_text else redacted_text end as sent from ({_REDACTED})", 'sent', 'hint')})
        where read_message is null and not {_BLANK}
          and (engine <> 'hybrid' or {_leaks('anonymized_text')} = '')""",
    "token_cost": f"select file, round({_COST}, 9) as cost_chf from ({LETTERS})",
    "rule_extract": f"""
        select *, case when sender is not null and content is not null and date is not null then 'high' else 'low' end as confidence
        from ({_EXTRACTED})""",
    "route_outcomes": f"""
        select file, engine, status, confidence, error_reason, proposed_name, round(cost_chf, 9) as cost_chf
        from ({_OUTCOMES})""",
    "manual_decisions": f"""
        select file, case when asked and answer = '' then 'skipped' else status end as status, confidence,
          case when asked and answer = '' then 'manual-skip' else error_reason end as error_reason,
          case when asked and answer <> '' then {_safe("(answer || '.pdf')")} else proposed_name end as proposed_name
        from (select *, status = 'renamed' as asked,
            case when k % 5 = 0 then '' when k % 5 = 1 then trim(label || ' von Hand') end as answer
          from ({_OUTCOMES}))""",
    "uncertain_fields": f"""
        select file, sender, content, date, coalesce('unklare Felder: ' || nullif(concat_ws(', ',
          case when sender in ('unknown', '') then 'sender' end, case when content in ('unknown', '') then 'content' end,
          case when date in ('unknown', '') then 'date' end), ''), 'niedrige Confidence') as uncertain_reason
        from ({_OUTCOMES}) where status = 'unrecognized'""",
    "error_classes": f"""
        select {_error_class('message', 'type_name')} as error, count(*) as n from ({_FAILURES}) group by all""",
    "retry_plan": f"""
        select event_id, error, error in ('rate-limit', 'timeout', 'overloaded') as is_retryable,
          coalesce(case when try_cast(retry_after as double) is not null then greatest(1.0, cast(retry_after as double)) end,
            cast([5, 10, 20, 40][least(attempt, 3) + 1] as double)) as delay_s
        from (select *, {_error_class('message', 'type_name')} as error from ({_FAILURES}))""",
    "filing_run": f"""
        select file, status, case when status = 'renamed' then final_name else file end as suggested, confidence, engine,
          round_even(cost_chf, 6) as cost_chf, round_even(took, 1) as elapsed_s,
          error_reason, done_category, strftime(ordered_at, '%Y-%m-%dT%H:%M:%S') as timestamp
        from ({_FILED})""",
    "filing_phases": f"""
        with f as materialized ({_ROUTED})
        select phase, min(s) as min_s, max(s) as max_s,
          cast(sum(cast(s as decimal(28,6))) as double) / count(*) as avg_s, cast(sum(cast(s as decimal(28,6))) as double) as total_s
        from ({_FILED_PHASES}) group by phase""",
    "filing_manifest": f"""
        select file, status, done_category, case status when 'renamed' then 'done/' || done_category || '/' || final_name
          when 'skipped' then 'error/' || final_name else status || '/' || final_name end as dest_path
        from ({_FILED})""",
    "log_roundtrip": _log("select distinct file from log where status in ('renamed', 'unrecognized', 'review')"),
    "pending_docs": _log(f"select file from ({_INBOX}) where file not in ({_FINISHED})"),
    "reprocess_notice": _log(f"select file from ({_INBOX}) where file in ({_FINISHED})"),
    "latest_log": _log(
        """select file, ts as timestamp, event_id, status, engine, suggested from log
        qualify row_number() over (partition by file order by ts desc, event_id desc) = 1"""
    ),
    "latest_by_runs": _log(
        """select file, ts as timestamp, event_id, status, engine, suggested from log
        qualify row_number() over (partition by file order by ts desc, event_id desc) = 1"""
    ),
    "running_eta": _log(
        """select engine, event_id, elapsed_s, done, total, mean as avg_s, mean * (total - done) as eta_s
        from (select engine, event_id, elapsed_s, row_number() over w as done,
            count(*) over (partition by engine) as total,
            cast(sum(cast(elapsed_s as decimal(20,6))) over w as double) / row_number() over w as mean
          from log window w as (partition by engine order by event_id rows unbounded preceding))
        where done < total"""
    ),
    "status_distribution": _log(_STATUS_DIST),
    "confidence_distribution": _log(_CONF_DIST),
    "log_category_counts": _log(
        "select done_category, count(*) as n from log where done_category <> '' group by all"
    ),
    "error_reasons": _log("select error_reason, count(*) as n from log where error_reason <> '' group by all"),
    "timing_stats": _log(_TIMING),
    "phase_stats": _log(_PHASE_STATS.replace("{rows}", _PHASE_ROWS)),
    "cost_totals": _log(_COSTS),
    "run_summary": _log(
        """select count(*) as processed, count(*) filter (status = 'renamed') as renamed,
          count(*) filter (status = 'unrecognized') as unrecognized, count(*) filter (status = 'review') as review,
          count(*) filter (status = 'skipped') as skipped, round(sum(cost_chf), 6) as total_chf,
          round(sum(elapsed_s), 6) as total_s, round(avg(elapsed_s), 6) as avg_s from log"""
    ),
    "outcome_counters": _log("select engine, status, count(*) as n from log group by all"),
    "run_report": _log(f"select section, key, metric, round(value, 6) as value from ({_REPORT})"),
    "rename_quality": _RENAME_QUALITY,
    "run_report_quality": "select section, key, metric, round(value, 6) as value from ("
    + _metrics("quality", "'all'", _RENAME_QUALITY, ["evaluated", "matches", "match_rate", "high_conf", "high_conf_rate", "target_high_conf_rate"])
    + ")",
    "scores_without_cloud": f"""
        select model, file, all_ok, confidence, round(cost_chf, 9) as cost_chf, error
        from ({_SCORED}) where not contains(model, '(claude)')""",
    "folder_scan": "select cast(4 as bigint) as n_files, cast(sum(strlen(text) + 1) as bigint) as bytes from documents",
    "text_files": "select cast(sum(length(text) + 1) as bigint) as n_chars from documents",
    "blocklist_file": f"""
        select row_number() over (order by item_id) as line_no, trim(term) as term
        from (select item_id, translate(text, chr(10), ' ') as term from benchmark) where term <> ''""",
    "rules_file": """
        select row_number() over (order by p_partkey) as priority, '[{' || p_partkey || '}] "' || p_type as category,
          lower(replace(p_name, ' ', '|')) as keywords from part""",
    "expectations_object": f"""
        with c as (
          select *, row_number() over (order by file) as case_no, case when k % 7 <> 3 and k % 13 <> 5 then file else '' end as given,
            case when k % 5 <> 2 then coalesce(sender_line, '') else '' end as s, case when k % 3 = 0 then coalesce(label, '') else '' end as t
          from ({LETTERS})),
        r as (
          select *, case when k % 13 = 5 then 'no object' when given = '' then 'no file' when k % 11 = 4 then 'input type'
            when s = '' and t = '' then 'no expectations' else '' end as reject_reason from c)
        select case_no, given as file, case when reject_reason = '' then regexp_replace(file, '(.)\\.[^.]+$', '\\1') else '' end as id,
          case when reject_reason = '' then s else '' end as sender_any, case when reject_reason = '' then t else '' end as content_any,
          case when reject_reason = '' then 'pdf' else '' end as input_type, reject_reason = '' and k % 4 <> 0 as cloud_safe, reject_reason
        from r""",
    "expectations_file": f"""
        select file, regexp_replace(file, '(.)\\.[^.]+$', '\\1') as id, 'pdf' as input_type,
          case when k % 6 = 0 then '' else sender_line end as sender_any,
          case when k % 10 = 4 then '' else label end as content_any,
          case when k % 6 = 0 then '' else date_text end as exp_date, k % 4 = 0 as cloud_safe
        from ({LETTERS}) where not (k % 6 = 0 and k % 10 = 4)""",
    "manifest_partitions": f"""
        select status, done_category, count(*) as n, min(case status when 'renamed' then 'done/' || done_category || '/' || final_name
          when 'skipped' then 'error/' || final_name else status || '/' || final_name end) as first_path
        from ({_FILED}) group by all""",
    "field_scores": f"""
        select model, file, sender_ok, content_ok, date_ok, all_ok, confidence, time_s, round(cost_chf, 9) as cost_chf, error
        from ({_SCORED})""",
    "model_accuracy": _EVAL + _ACCURACY,
    "calibration": _EVAL + _calibration("select * from s"),
    "model_cost": _EVAL + _MODEL_COST,
    "eval_report": _EVAL
    + "select section, key, metric, round(value, 6) as value from ("
    + " union all ".join(
        [
            _metrics("accuracy", "model", _ACCURACY, ["sender_pct", "content_pct", "date_pct", "all_pct", "n_all_ok", "errors", "avg_time_s", "evaluated", "cases"]),
            _metrics("calibration", "model", _calibration("select * from s"), ["high_rate_pct", "high_correct_pct", "low_correct_pct"]),
            _metrics("cost", "model", _MODEL_COST, ["total_chf", "avg_chf"]),
        ]
    )
    + ")",
    "label_calibration": _calibration(
        f"""select 'untouched' as model, quality = 1 as all_ok, null as error,
          case when {_TOTAL} = 0 then 'high' else 'low' end as confidence
        from ({_chain('select doc_id, text from documents', 'text')}) join labels using (doc_id)"""
    ),
    "stream_redact_counts": f"select lang, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in _COLUMN.values())} "
    f"from ({_chain('select lang, text from documents', 'text')}) group by lang",
    "stream_counters": _log("select engine, status, count(*) as n from log group by all"),
    "stream_window_stats": _log(
        f"""select date_trunc('hour', ts) as window_start, count(*) as n, round(sum(cost_chf), 6) as total_chf,
          round(avg(elapsed_s) filter (elapsed_s > 0), 6) as avg_s
        from log group by 1 having date_trunc('hour', any_value(ts)) + interval 1 hour <= {_STREAM_LAST}"""
    ),
    "stream_first_deliveries": _log("select distinct file from log"),
    # a file's deliveries in the order of their arrival; late is what is not after the latest moment of earlier arrivals less two days
    "stream_deliveries": f"""
        with recursive log as ({LOG_SQL}),
        timed as (select file, event_id, epoch_ms(ts) as ms, min(epoch_ms(ts)) over () as lo, max(epoch_ms(ts)) over () as hi from log),
        come as (
          select file, event_id, ms, least((ms - lo) * 6 // (hi - lo + 1) + case when event_id % 11 = 0 then 2 else 0 end, 5) as part from timed),
        marks as (
          select p.part, coalesce((select max(ms) from come c where c.part < p.part) - 2 * 86400000, 0) as passed
          from (select distinct part from come) p),
        told as (
          select c.*, ms <= passed as late, row_number() over (partition by file, ms <= passed order by part, ms, event_id) as k
          from come c join marks using (part)),
        served as (
          select file, event_id, k, ms as first_ms, 'first' as kind from told where not late and k = 1
          union all
          select t.file, t.event_id, t.k, case when t.ms <= s.first_ms + 3 * 86400000 then s.first_ms else t.ms end,
            case when t.ms <= s.first_ms + 3 * 86400000 then 'copy' else 'first' end
          from served s join told t on t.file = s.file and t.k = s.k + 1 and not t.late)
        select file, event_id as id, kind from served
        union all select file, event_id, 'late' from told where late""",
    "stream_filing": f"select engine, status, done_category, count(*) as n from ({_FILED}) group by all",
}
