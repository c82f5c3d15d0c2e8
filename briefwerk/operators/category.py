"""Topics from ordered keyword rules: the first rule with a keyword in the name wins."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.once import once
from ..functions.text import quality_key
from ..session import settle

# Keywords are looked up by their first characters, up to this many; longer ones are then searched as a whole.
_BEGINNING = 24
_KEYS_PER_TASK = 20_000
_SLOTS = 1 << 16  # flags that say which parts may begin a keyword


def deciding_keywords(rules) -> list[tuple[str, tuple[str, ...]]]:
    """Drop keywords that cannot change the outcome: a part of them already decides."""
    seen, kept = [], []
    for category, keywords in rules:
        low = [k.lower() for k in keywords]
        new = [
            k
            for k in dict.fromkeys(low)
            if not any(s in k for s in seen) and not any(o != k and o in k for o in low)
        ]
        seen += new
        kept.append((category, tuple(new)))
    return kept


def category_of_key(key: Column, rules=fixed.DEFAULT_CATEGORIES) -> Column:
    """Topic of a comparison key; the last topic where no keyword occurs."""
    if not rules:
        return F.lit(fixed.FALLBACK_CATEGORY)
    kept = deciding_keywords(rules)
    fallback = F.lit(kept[-1][0])

    def first(whole: Column) -> Column:
        chosen = F
        for category, keywords in kept:
            if keywords:
                listed = F.array(*[F.lit(k) for k in keywords])  # a constant, however long
                chosen = chosen.when(F.exists(listed, lambda k: F.contains(whole, k)), F.lit(category))
        return fallback if chosen is F else chosen.otherwise(fallback)

    return once(key, first)


def assign_category(
    df: DataFrame, name: str = "name", rules=fixed.DEFAULT_CATEGORIES, into: str = "category"
) -> DataFrame:
    """Add the topic of a file name."""
    return df.withColumn(into, category_of_key(quality_key(F.col(name)), rules))


def keyword_table(rules: DataFrame) -> DataFrame:
    """Rules (priority, category, keywords) as (keyword, priority): the first rule per keyword."""
    rows = rules.select("priority", F.explode("keywords").alias("keyword"))
    return rows.groupBy(F.lower("keyword").alias("keyword")).agg(F.min("priority").alias("priority"))


def _may_begin(begun: DataFrame) -> Callable[[Column], Column]:
    """False only for pieces that no keyword begins with: a byte per hash, whatever the number of keywords."""
    slot = F.pmod(F.xxhash64("_begin"), F.lit(_SLOTS))
    flags = bytearray(_SLOTS)
    for row in begun.select(slot.alias("at")).distinct().collect():
        flags[row["at"]] = 1
    listed = F.lit(bytes(flags))

    def test(piece: Column) -> Column:
        at = F.pmod(F.xxhash64(piece), F.lit(_SLOTS)).cast("int") + 1
        return F.substring(listed, at, F.lit(1)) == F.lit(b"\x01")

    return test


def assign_category_by_table(
    df: DataFrame, rules: DataFrame, id: str = "file", name: str = "name", into: str = "category"
) -> DataFrame:
    """The same for rule tables of any size; a row's own name decides, so ``id`` may repeat or be missing.

    Every part of a name that has the length of some keyword is looked up by equality, so
    no name meets a keyword it does not contain. Parts that begin no keyword are left out before
    they become rows.
    """
    begun = keyword_table(rules).withColumn("_begin", F.substring("keyword", 1, _BEGINNING))
    # at most as many lengths as a beginning has characters
    lengths = begun.agg(F.collect_set(F.length("_begin")).alias("n")).first().n
    fallback = F.lit(
        rules.agg(F.max_by("category", "priority").alias("last")).first().last or fixed.FALLBACK_CATEGORY
    )
    # all pieces of each length, overlapping, in one pass; an empty keyword occurs in every name
    pieces = [F.regexp_extract_all("_key", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sorted(lengths) if n]
    parts = F.array_distinct(F.concat(F.array(F.lit("")), *pieces))
    keyed = df.withColumn("_key", quality_key(F.col(name)))
    # names repeat, so each key is looked up once, and only by pieces that may begin a keyword
    keys = settle(keyed.select("_key").where("_key IS NOT NULL").distinct(), "keys")
    possible = _may_begin(begun)
    # keys are short and their parts are many: tasks are cut by rows
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // _KEYS_PER_TASK))
    # outer: a plain explode would be preceded by a filter that makes the parts a second time, before they are dealt
    looked_up = keys.repartition(tasks).select("_key", F.explode_outer(F.filter(parts, possible)).alias("_begin"))
    hits = looked_up.join(begun, "_begin").select("_key", "keyword", "priority")
    found = hits.where((F.length("keyword") < _BEGINNING) | F.contains("_key", F.col("keyword")))
    first = found.groupBy("_key").agg(F.min("priority").alias("priority"))
    named = rules.groupBy("priority").agg(F.min("category").alias("_category"))
    best = first.join(named, "priority").select("_key", "_category")
    return (
        keyed.join(best, "_key", "left")
        .select(*df.columns, F.coalesce("_category", fallback).alias(into))
    )
