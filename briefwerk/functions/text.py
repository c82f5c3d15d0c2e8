"""Text columns: whitespace, portable file names, comparison keys, letter dates."""

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .dialect import java
from .once import once

_SPACE = java(r"\s")


def strip(text: Column) -> Column:
    """Trim whitespace of any kind, not only blanks."""
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    """True where a text is missing or holds nothing but whitespace (a bare scan)."""
    return text.isNull() | ~text.rlike(java(r"[^\s]"))


@lru_cache(maxsize=1)
def _ascii_readings() -> tuple[dict, dict]:
    """Code points whose compatibility decomposition holds one / several ASCII characters."""
    single, several = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        reading = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(reading) == 1:
            single[char] = reading
        elif reading:
            several[char] = reading
    return single, several


def ascii_fold(text: Column) -> Column:
    """Compatibility-decompose and keep the ASCII part, as ``NFKD`` + dropping would."""
    single, several = _ascii_readings()
    listed = "\x01".join(f"{char}\x02{reading}" for char, reading in several.items())
    readings = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))

    def spelled(folded: Column) -> Column:
        # only the few different characters that a text holds are replaced, each in one pass
        found = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
        read = F.filter(found, lambda c: F.element_at(readings, c).isNotNull())
        replaced = F.aggregate(read, folded, lambda text, c: F.replace(text, c, F.element_at(readings, c)))
        has_several = F.translate(folded, "".join(several), "") != folded
        return F.when(has_several, replaced).otherwise(folded)

    def fold(raw: Column) -> Column:
        plain = once(F.translate(raw, "".join(single), "".join(single.values())), spelled)
        # most texts are ASCII already: they skip the rest
        return F.when(
            raw.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"[^\x00-\x7F]+", "")
        ).otherwise(raw)

    return once(text, fold)


def ascii_part(text: Column) -> Column:
    """A portable part of a file name; ``unknown`` where nothing is left."""
    dashed = F.regexp_replace(ascii_fold(text), "[^A-Za-z0-9]+", "-")
    return once(
        F.btrim(dashed, F.lit("-")), lambda part: F.when(part == "", F.lit("unknown")).otherwise(part)
    )


def quality_key(text: Column) -> Column:
    """The key on which names and expectations are compared."""
    return F.lower(ascii_part(text))


def safe_filename(name: Column) -> Column:
    """A portable name of at most 180 characters that ends in ``.pdf``."""
    stem = ascii_part(F.regexp_replace(name, r"(?i)\.pdf\z", ""))
    room = fixed.NAME_MAX_CHARS - len(fixed.SUFFIX)
    return F.concat(F.rtrim(F.substring(stem, 1, room), F.lit("-")), F.lit(fixed.SUFFIX))


def proposed_name(sender: Column, content: Column, date: Column) -> Column:
    return safe_filename(F.concat(F.concat_ws("-", sender, content, date), F.lit(fixed.SUFFIX)))


def name_stem(name: Column) -> Column:
    """The name without its last suffix; a leading dot or a trailing one starts no suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def name_suffix(name: Column) -> Column:
    """The last suffix, ``.pdf`` where there is none."""
    return F.coalesce(
        F.nullif(F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)\z", 1), F.lit("")), F.lit(fixed.SUFFIX)
    )


def field_match(actual: Column, expected: Column) -> Column:
    """True if any expected value occurs in the actual one; NULL if nothing is expected."""
    def hit(key: Column) -> Column:
        return F.exists(expected, lambda value: F.contains(key, quality_key(value)))

    return F.when(F.size(expected) > 0, once(quality_key(actual), hit))


def month_number(name: Column) -> Column:
    """Number of a German month name or abbreviation."""
    months = F.create_map(*[F.lit(x) for pair in fixed.MONTHS.items() for x in pair])

    def number(raw: Column) -> Column:
        folded = F.translate(raw, "äöü", "aou")
        return F.coalesce(F.element_at(months, folded), F.element_at(months, raw))

    return once(F.lower(F.rtrim(name, F.lit("."))), number)


def letter_date(text: Column) -> Column:
    """``YYYYMMDD`` of the first "City, D. Month YYYY" in the letter head, else NULL.

    The day is checked against 1..31 only, so the result stays a string.
    """
    # no letter may precede the place name: a match could as well have begun there; told of plain letters first, which is cheap
    pattern = f"(?<![{string.ascii_letters}])" + java("(?<![A-ZÄÖÜ])" + fixed.LETTER_DATE, ignore_case=True)
    # what follows the place name begins with a comma, so it is found, or found missing, without taking words apart
    behind = java(fixed.LETTER_DATE[fixed.LETTER_DATE.index(","):], ignore_case=True)

    def search(head: Column) -> Column:
        return F.when(head.rlike(behind), F.regexp_substr(head, F.lit(pattern)))

    # one search: the three groups come back as "day|month|year"
    match = once(F.substring(text, 1, fixed.LETTER_HEAD_CHARS), search)
    found = F.split(F.regexp_replace(match, pattern, r"$1|$2|$3"), r"\|")

    def compose(date: Column) -> Column:
        year, month, day = date["year"], date["month"], date["day"]
        valid = (
            month.isNotNull()
            & year.between(fixed.YEAR_MIN, fixed.YEAR_MAX)
            & day.between(1, 31)
        )
        return F.when(valid, F.format_string("%d%02d%02d", year, month, day))

    def read(groups: Column) -> Column:
        date = F.struct(
            F.get(groups, 2).try_cast("int").alias("year"),
            month_number(F.get(groups, 1)).alias("month"),
            F.get(groups, 0).try_cast("int").alias("day"),
        )
        return F.when(groups.isNotNull(), once(date, compose))

    return once(found, read)
