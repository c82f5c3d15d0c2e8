"""Redaction rules as column functions."""

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .dialect import WORD, java
from .once import once

# A match of the address rule can only start where no letter of its first class precedes: from
# there the rule could take that letter too. Saying so spares a retry at every letter of a word, and saying it of
# plain letters first spares most of those the wider, slower test.
_PLAIN = string.ascii_letters
_NO_LETTER_BEFORE = f"(?<![{_PLAIN}])"
# Looking back for a word boundary costs more than telling that a match cannot begin with a character,
# so these rules test their first characters before they look at what is in front of them.
_BOUNDARY = f"(?<![{WORD}])"
_FIRST = {
    "[IBAN]": ((_BOUNDARY, r"(?=[A-Z]{2}\p{Nd})" + _BOUNDARY),),
    "[AHV]": ((_BOUNDARY + r"756\.", rf"756\.(?<![{WORD}]756\.)"),),
    "[EMAIL]": (("+@", "++@"),),
    "[TELEFON]": (("(?:", "(?=[+0])(?:"), (_BOUNDARY + "0", f"0(?<![{WORD}]0)")),
    # Each part of an amount in front of its currency ends where the next begins, so no part is tried shorter.
    "[BETRAG]": (
        ("(?iu)", r"(?=[CEUceu0123456789\x{80}-\x{10FFFF}])(?iu)(?:"),
        (r"|\p{Nd}{1,3}(", r"|\p{Nd}{1,3}+("),
        (r"{3})*(?:[.,]\p{Nd}{2})?[", r"{3})*+(?:[.,]\p{Nd}{2})?+["),
        (r"]*(?:CHF|EUR|USD)", r"]*+(?:CHF|EUR|USD))"),
    ),
    # The word before the number ends with the street's last part, so a word that no number follows is not taken apart.
    "[ADRESSE]": (
        ("(?iu)[A-ZÄÖÜ]", _NO_LETTER_BEFORE + r"(?iu)(?<![A-ZÄÖÜ])[A-ZÄÖÜ](?=[a-zA-Zäöüÿ]++\.?" + java(r"[\s\-]?\d") + ")"),
    ),
    "[BEHANDLER]": ((_BOUNDARY, "(?=[PDmld])" + _BOUNDARY),),
}


def _told_by_first(label: str, pattern: str) -> str:
    for plain, quick in _FIRST[label]:
        head, found, tail = pattern.partition(plain)
        if not found:
            raise ValueError(f"{label}: {plain!r} is not in the pattern")
        pattern = head + quick + tail
    return pattern


PATTERNS = {label: _told_by_first(label, java(p, ignore_case)) for label, ignore_case, p in fixed.REDACTION_RULES}
LABELS = tuple(PATTERNS) + (fixed.BLOCKLIST_LABEL,)
HAS_DIGIT = java(r"\d")

# the characters of an address in front of the @
_LOCAL_PART = string.ascii_letters + string.digits + "._%+-"

# What a text must contain for a rule to have any chance; byte searches, far cheaper than the rule.
_NEEDS = {
    "[AHV]": ("756.",),
    "[EMAIL]": ("@",),
    "[TELEFON]": ("+", "0"),
    "[BEHANDLER]": ("Prof.", "Dr.", "med.", "lic.", "dipl."),
}
_NEEDS_PATTERN = {"[BETRAG]": "(?=[CEUceu])" + java("(?:CHF|EUR|USD)", True)}


def may_match(text: Column, label: str, has_digit: Column | None = None) -> Column:
    """False only where the rule cannot match."""
    tests = []
    if label in _NEEDS:
        tests.append(reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in _NEEDS[label]]))
    if label in _NEEDS_PATTERN:
        tests.append(text.rlike(_NEEDS_PATTERN[label]))
    if label not in ("[EMAIL]", "[BEHANDLER]"):
        tests.insert(0, text.rlike(HAS_DIGIT) if has_digit is None else has_digit)
    return reduce(lambda a, b: a & b, tests)


def _replaced(text: Column, label: str) -> Column:
    if label != "[EMAIL]":
        return F.regexp_replace(text, PATTERNS[label], label)

    # No match begins before the characters that stand in front of the first @, so the text before them is not searched.
    # The character before them comes along, for the word boundary.
    def from_first(before: Column) -> Column:
        kept = F.greatest(F.length(before) - 1, F.lit(0))
        searched = F.regexp_replace(F.substring(text, kept + 1, F.length(text)), PATTERNS[label], label)
        return F.concat(F.substring(text, F.lit(1), kept), searched)

    return once(F.rtrim(F.substring_index(text, "@", 1), F.lit(_LOCAL_PART)), from_first)


def redact_rule(text: Column, label: str, has_digit: Column | None = None) -> Column:
    """One rule applied to a text."""
    return F.when(may_match(text, label, has_digit), _replaced(text, label)).otherwise(text)


def _occurrences(text: Column, literal: str) -> Column:
    without = F.replace(text, F.lit(literal))
    return (F.octet_length(text) - F.octet_length(without)) / F.lit(len(literal))


def count_inserted(before: Column, after: Column, label: str) -> Column:
    """How often a rule matched, from the labels it inserted.

    Exact, and cheaper than searching the pattern again: no rule can match inside a
    label or across a bracket (each needs a digit, an ``@`` or a dot, none takes a
    bracket), so labels that were there before stay and are subtracted.
    """
    inserted = _occurrences(after, label) - _occurrences(before, label)
    return F.when(before == after, F.lit(0)).otherwise(inserted.cast("int"))


def chain(text: Column) -> Column:
    """All rules in order: struct of the redacted text and the hits of each label.

    Each rule sees the text the rule before it left, and is counted on that text.
    """
    labels = list(PATTERNS)

    def stage(i: int, current: Column, has_digit: Column, hits: list[Column]) -> Column:
        if i == len(labels):
            return F.struct(current.alias("text"), *hits)
        label = labels[i]
        return once(
            redact_rule(current, label, has_digit),
            lambda after: stage(
                i + 1,
                after,
                has_digit,
                [*hits, F.coalesce(count_inserted(current, after, label), F.lit(0)).alias(label)],
            ),
        )

    def start(raw: Column) -> Column:
        return once(raw.rlike(HAS_DIGIT), lambda has_digit: stage(0, raw, has_digit, []))

    return once(text, start)


def term_pattern(term: str) -> str:
    """A blocklist term: literal, any case, no word boundary."""
    return r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def fold_case(text: Column) -> Column:
    """Equal for texts that a case-insensitive search takes for equal (and for some others)."""
    # the optimizer would drop an upper() right inside a lower(), and with it "ſ" for "s"
    return F.translate(F.lower(F.translate(F.upper(text), "İ", "I")), "ς", "σ")


def term_can_follow_a_label(term: Column) -> Column:
    """Whether putting in a label can make room for the term: it has a bracket or lies within the label."""
    in_label = F.contains(fold_case(F.lit(fixed.BLOCKLIST_LABEL)), fold_case(term))
    return in_label | F.contains(term, F.lit("[")) | F.contains(term, F.lit("]"))


def listed_patterns(text: Column, terms: tuple[str, ...]) -> Column:
    """The patterns of those terms, in list order, that the text may hold; none in nearly all texts.

    Terms are tried by plain search in the folded text, so a pattern is compiled only where its term was found.
    If any was, those that can follow an inserted label come along.
    """
    rows = [
        F.struct(
            F.lit(term_pattern(t)).alias("pattern"), fold_case(F.lit(t)).alias("folded"),
            term_can_follow_a_label(F.lit(t)).alias("always"),
        )
        for t in terms if t
    ]

    def some(folded: Column) -> Column:
        here = F.exists(F.array(*rows), lambda t: F.contains(folded, t["folded"]))
        kept = F.filter(F.array(*rows), lambda t: t["always"] | F.contains(folded, t["folded"]))
        return F.when(here, F.transform(kept, lambda t: t["pattern"]))

    return once(fold_case(text), some)


def fold_terms(text: Column, patterns: Column) -> Column:
    """Redact an array of patterns in order: struct of text and number of hits."""
    start = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    return F.aggregate(
        patterns,
        start,
        lambda acc, p: F.struct(
            F.regexp_replace(acc["text"], p, F.lit(fixed.BLOCKLIST_LABEL)).alias("text"),
            (acc["hits"] + F.regexp_count(acc["text"], p)).alias("hits"),
        ),
    )


# --- checks on text that is about to leave -------------------------------------------------

# characters that every match of a leak rule holds
_LEAK_NEEDS = {"AHV": "756.", "Telefon (CH)": "7"}


def leak_hits(text: Column) -> Column:
    """First hit of each leak rule, in rule order: array of (label, snippet)."""
    hits = [
        F.struct(F.lit(label).alias("label"), F.regexp_substr(text, F.lit(java(p))).alias("snippet"))
        for label, p in fixed.LEAK_RULES
    ]
    return F.filter(F.array(*hits), lambda hit: hit["snippet"].isNotNull())


def leak_labels(text: Column) -> Column:
    """Labels of the rules that hit, joined; empty where the text is clean."""
    def listed(text: Column) -> Column:
        hits = [F.contains(text, F.lit(_LEAK_NEEDS[label])) & text.rlike(java(p)) for label, p in fixed.LEAK_RULES]
        return F.concat_ws(", ", *[F.when(hit, F.lit(label)) for hit, (label, _) in zip(hits, fixed.LEAK_RULES)])

    return once(text, listed)


def placeholders(text: Column) -> Column:
    """All placeholder tokens in an anonymised text."""
    return F.regexp_extract_all(text, F.lit(fixed.PLACEHOLDER), F.lit(0))
