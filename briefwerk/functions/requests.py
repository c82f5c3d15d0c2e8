"""Model requests and recorded model responses as columns; no model is called here."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .dialect import java
from .once import once

INSTRUCTIONS = (
    "Name four facts about this letter.\n"
    "sender: the organisation in the letterhead, words joined by hyphens, no legal suffix.\n"
    "content: what the letter is, one to three words joined by hyphens.\n"
    "date: day of issue as YYYYMMDD. A date after the place name at the top counts first; for "
    "statements take the last day of the period, for yearly certificates 31 December. Due dates "
    "and scan dates do not count. Write unknown if there is none.\n"
    "confidence: high if the three facts are certain, else low.\n"
    "Answer with one JSON object with exactly these keys."
)


def request_text(text: Column, date_hint: Column | None = None, instructions: str = INSTRUCTIONS) -> Column:
    """The text of one request: instructions, the date found by rule if any, the letter."""
    parts = [F.lit(instructions)]
    if date_hint is not None:
        parts.append(F.concat(F.lit("The letter head shows the date "), date_hint, F.lit(".")))
    return F.concat_ws("\n\n", *parts, text)


def _strict_json(text: Column) -> Column:
    """The JSON value of a text, NULL if anything else follows it.

    The parser stops after the first value, so the text is read as the only element of a
    list and as a field: nothing can follow a value that suits both. Where the text has no ``]``, the list
    ends with the bracket put after it, and that alone is enough.
    """
    as_field = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))

    def only(listed: Column) -> Column:
        whole = ~F.contains(text, F.lit("]")) | as_field.isNotNull()
        alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & whole
        return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))

    return once(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), only)


def _field(answer: Column, key: str, default: str) -> Column:
    """A key of the answer as Python's ``str`` would print it."""
    path = f"$.{key}"
    value = F.try_variant_get(answer, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(answer, path, "variant"))

    def printed(value: Column) -> Column:
        by_kind = (
            F.when(kind.isNull(), F.lit(default))
            .when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(value))
            .otherwise(F.coalesce(value, F.lit(default)))
        )
        # any other value is printed as it is, whatever its kind
        return F.when(value.isNull() | value.isin("true", "false"), by_kind).otherwise(value)

    return once(value, printed)


def parse_response(response: Column) -> Column:
    """Struct of sender, content, date, confidence and error.

    A response that is no JSON may hold one flat object in its prose; local models need that, a cloud model's
    structured answer is JSON to begin with. ``error`` is NULL, ``JSONDecodeError`` (broken object),
    ``AttributeError`` (JSON, but no object), or, where no object is found, the class of a message that quotes
    the whole response: mostly ``parse-error``, but a response that holds "529" reads as ``overloaded``.
    """
    fields = {"sender": "unknown", "content": "unknown", "date": "unknown", "confidence": "low"}

    def unpack(found: Column) -> Column:
        answer, is_object = found["answer"], found["is_object"]
        error = (
            F.when(
                ~found["present"],
                error_class(F.concat(F.lit("no json object in: "), F.coalesce(response, F.lit(""))), F.lit("ValueError")),
            )
            .when(answer.isNull(), F.lit("JSONDecodeError"))
            .when(~is_object, F.lit("AttributeError"))
        )
        return F.struct(
            *[F.when(is_object, _field(answer, k, d)).alias(k) for k, d in fields.items()],
            error.alias("error"),
        )

    def typed(answer: Column, is_object: Column, present: Column) -> Column:
        return F.struct(
            answer.alias("answer"), F.when(answer.isNotNull(), is_object).alias("is_object"), present.alias("present")
        )

    def search(fragment: Column) -> Column:
        return once(F.try_parse_json(fragment), lambda a: typed(a, F.lit(True), fragment.isNotNull()))

    def parse(raw: Column) -> Column:
        fragment = F.regexp_substr(raw, F.lit(r"(?s)\{[^{}]+\}"))
        # the text is JSON where this is used, so its first character tells its kind
        braced = F.startswith(F.ltrim(raw, F.lit(" \t\r\n")), F.lit("{"))
        return once(
            _strict_json(raw),
            lambda a: F.when(a.isNotNull(), typed(a, braced, F.lit(True))).otherwise(once(fragment, search)),
        )

    return once(once(response, parse), unpack)


def takes_date_hint(date: Column) -> Column:
    """Whether a hint would stand in for the date: one is there, but is no eight digits."""
    return ~date.rlike(r"\A\p{Nd}{8}\n?\z")


def with_date_hint(date: Column, hint: Column) -> Column:
    """The hint stands in for a date that is no eight digits."""
    return F.when(takes_date_hint(date), F.coalesce(F.nullif(hint, F.lit("")), date)).otherwise(date)


def token_cost_chf(
    input_tokens: Column,
    output_tokens: Column,
    price_in: float = fixed.PRICE_IN,
    price_out: float = fixed.PRICE_OUT,
    chf_per_usd: float = fixed.CHF_PER_USD,
) -> Column:
    usd = (input_tokens * F.lit(price_in) + output_tokens * F.lit(price_out)) / F.lit(1e6)
    return usd * F.lit(chf_per_usd)


def uncertain_fields(sender: Column, content: Column, date: Column) -> Column:
    """Names of the fields that are empty or unknown, or the general reason."""
    named = {"sender": sender, "content": content, "date": date}
    unsure = F.concat_ws(", ", *[F.when(c.isin("unknown", ""), F.lit(n)) for n, c in named.items()])
    listed = F.concat(F.lit("unklare Felder: "), F.nullif(unsure, F.lit("")))
    return F.coalesce(listed, F.lit("niedrige Confidence"))


# --- failed requests ------------------------------------------------------------------------

def error_class(message: Column, type_name: Column) -> Column:
    """Reportable class of an error; the first matching class wins, else the type name."""
    def first(low: Column) -> Column:
        chosen = F
        for name, marks in fixed.ERROR_CLASSES:
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])
            chosen = chosen.when(hit, F.lit(name))
        return chosen.otherwise(type_name)

    return once(F.lower(message), first)


def is_retryable(error: Column) -> Column:
    return error.isin(*fixed.RETRYABLE)


def retry_delay_s(retry_after: Column, attempt: Column) -> Column:
    """Seconds to wait: the server's number (at least 1), else the schedule by attempt (from 0)."""
    schedule = F.array(*[F.lit(float(s)) for s in fixed.BACKOFF_SECONDS])
    step = F.get(schedule, F.least(attempt, F.lit(len(fixed.BACKOFF_SECONDS) - 1)).cast("int"))
    told = F.regexp_extract(
        F.coalesce(retry_after, F.lit("")), java(r"\A\s*([+\-]?[0-9]+(?:\.[0-9]*)?|[+\-]?\.[0-9]+)\s*\z"), 1
    ).try_cast("double")
    return F.when(told.isNotNull(), F.greatest(F.lit(1.0), told)).otherwise(step)


# --- log measures ---------------------------------------------------------------------------

def logged_cost(cost: Column) -> Column:
    return F.bround(cost, 6)


def logged_elapsed(seconds: Column) -> Column:
    return F.bround(seconds, 1)


def logged_phases(phases: Column) -> Column:
    return F.transform_values(phases, lambda _, seconds: F.bround(seconds, 2))
