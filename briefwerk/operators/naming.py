"""Collision-free file names.

In file order, each file takes the name it asks for if that is free in its folder,
else the first free one of name-2, name-3, ... A name asked for that often is a
*family*; the n-th place in it is *slot* n.

With no other names around, the k-th file of a family gets slot k. Slots are lost to
names filed earlier and to other families ("x-2.pdf" may be asked for as such), and
the files behind move up. Earlier names are known from the start. Between families
the file that comes first wins a slot, which is settled in rounds: number, find names
given twice, take the slot from the later family, number again. Names asked for as such
are known to be lost to later files from the start. Since one order
ranks all files, this ends in what serving them one by one would give. Nearly all
data needs no round at all; families that cannot meet another stay out of them.

A slot lost to a later winner is still there for the files that come before it, so whether
a loss moves files up depends on the losses before it: a gated running sum (``gated``).
What is numbered are folder, name and order; the other columns wait on disk for the name.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.once import once
from ..functions.text import name_stem, name_suffix, safe_filename
from ..session import settle
from .gated import gated
from .running import running

_LONGEST_MARKER = 19  # "-" and as many digits as any number of rows has


@dataclass(frozen=True)
class Scheme:
    """How the n-th name of a family is spelled: stem cut to ``room`` characters, -n, suffix."""

    stem: Callable[[Column], Column]
    suffix: Callable[[Column], Column]
    room: int | None  # characters for stem and marker, None if never cut

    def key(self, stem: Column, suffix: Column, marker_chars: int) -> Column:
        """What all names of a family share before and after a marker of that length."""
        if self.room:
            stem = F.rtrim(F.substring(stem, 1, self.room - marker_chars), F.lit("-"))
        return F.concat(stem, F.lit("/"), suffix)

    def name(self, base: Column, slot: Column) -> Column:
        marker = F.concat(F.lit("-"), slot.cast("string"))
        stem = self.stem(base)
        if self.room:
            cut = F.substring(stem, F.lit(1), F.lit(self.room) - F.length(marker))
            stem = F.rtrim(cut, F.lit("-"))
        return F.when(slot == 1, base).otherwise(F.concat(stem, marker, self.suffix(base)))


RENAMED = Scheme(
    lambda name: F.left(name, F.length(name) - len(fixed.SUFFIX)),
    lambda _: F.lit(fixed.SUFFIX),
    fixed.NAME_MAX_CHARS - len(fixed.SUFFIX),
)
ORIGINAL = Scheme(name_stem, name_suffix, None)


def _as_member(name: Column, scheme: Scheme) -> Column:
    """A name read as "family key + number", NULL if it does not end in a number from 2."""

    def read(stem: Column) -> Column:
        def numbered(number: Column) -> Column:
            front = F.left(stem, F.length(stem) - F.length(number) - 1)
            # "x-2" without a suffix is no member: members are always spelled with one
            spelled = name == F.concat(stem, scheme.suffix(name))
            return F.when(
                (number != "") & (number != "1") & (front != "") & spelled,
                F.struct(
                    F.concat(front, F.lit("/"), scheme.suffix(name)).alias("key"),
                    (F.length(number) + 1).alias("marker"),
                    number.cast("bigint").alias("slot"),
                ),
            )

        return once(F.regexp_extract(stem, r"-([1-9][0-9]{0,17})\z", 1), numbered)

    return once(scheme.stem(name), read)


def _keys(families: DataFrame, scheme: Scheme) -> DataFrame:
    """One row per family and key; short stems share one key for all marker lengths."""
    stem, suffix = F.col("stem"), F.col("suffix")

    def entry(marker: int) -> Column:
        return F.struct(F.lit(marker).alias("marker"), scheme.key(stem, suffix, marker).alias("key"))

    keys = F.array(entry(0))
    if scheme.room:
        cuts = F.array(*[entry(m) for m in range(2, _LONGEST_MARKER + 1)])
        keys = F.when(F.length(stem) > scheme.room - _LONGEST_MARKER, cuts).otherwise(keys)
    keyed = families.select("*", F.explode_outer(keys).alias("_key"))
    return keyed.select("*", "_key.marker", "_key.key").drop("_key", "stem", "suffix", "member")


def _both_markers(members: DataFrame) -> DataFrame:
    """Offer a member under its own marker length and under 0, the one of short stems."""
    return members.withColumn("marker", F.explode(F.array(F.lit(0), F.col("marker"))))


def _taken_slots(families: DataFrame, taken: DataFrame, scheme: Scheme) -> DataFrame:
    """Slots of the families that earlier names hold, as runs (dir, base, from, to)."""
    taken = taken.select("dir", "name").distinct()
    own = taken.withColumnRenamed("name", "base").select(
        "dir", "base", F.lit(1).cast("bigint").alias("from"), F.lit(1).cast("bigint").alias("to")
    )
    members = taken.select("dir", _as_member(F.col("name"), scheme).alias("m")).where("m IS NOT NULL")
    numbered = running(
        members.select("dir", "m.key", "m.marker", "m.slot"), ["dir", "key", "marker"], ["slot"], "k"
    )
    # a hot family was numbered without gaps: its million names are one run
    runs = (
        numbered.withColumn("_run", F.col("slot") - F.col("k"))
        .groupBy("dir", "key", "marker", "_run")
        .agg(F.min("slot").alias("from"), F.max("slot").alias("to"))
    )
    held = (
        _keys(families.select("dir", "base", "stem", "suffix"), scheme)
        .join(_both_markers(runs), ["dir", "key", "marker"])
        .select("dir", "base", "from", "to")
    )
    return held.unionByName(own.join(families.select("dir", "base"), ["dir", "base"], "left_semi"))


def _meeting(families: DataFrame, held: DataFrame | None, scheme: Scheme) -> DataFrame:
    """Families that could meet another one: a superset, usually empty."""
    known = families
    if held is not None:
        lost = held.groupBy("dir", "base").agg(F.sum(F.col("to") - F.col("from") + 1).alias("lost"))
        known = known.join(lost, ["dir", "base"], "left")
    else:
        known = known.withColumn("lost", F.lit(0).cast("bigint"))
    keyed = _keys(known.withColumn("lost", F.coalesce("lost", F.lit(0))), scheme)
    members = _both_markers(
        families.where("member IS NOT NULL").select(
            "dir", F.col("base").alias("member"), "member.key", "member.marker", "member.slot"
        )
    )
    on = ["dir", "key", "marker"]
    # how far the families of a key can reach if everything that might be lost is lost
    reach = (
        keyed.groupBy(*on)
        .agg((F.sum("files") + F.sum("lost") + F.count("*")).alias("reach"), F.count("*").alias("sharing"))
        .join(members.groupBy(*on).agg(F.count("*").alias("members")), on, "left")
        .select(*on, "sharing", (F.col("reach") + F.coalesce("members", F.lit(0))).alias("reach"))
    )
    met = members.join(reach, on).where("slot <= reach")
    parents = keyed.join(met.select(*on).distinct(), on, "left_semi")
    sharing = keyed.join(reach.where("sharing > 1"), on, "left_semi")
    return (
        met.select("dir", F.col("member").alias("base"))
        .unionByName(parents.select("dir", "base"))
        .unionByName(sharing.select("dir", "base"))
        .distinct()
    )


def _seeds(families: DataFrame, scheme: Scheme) -> DataFrame:
    """Slots (dir, base, slot, winner) that a family loses to names asked for as such.

    Whoever first asks for "x-3.pdf" finds it free and takes it, or finds it taken: either way no later file of
    family "x.pdf" can get it. Knowing that from the start spares a round per such name.
    """
    members = families.where("member IS NOT NULL").select(
        "dir", "member.key", "member.marker", "member.slot", F.col("first").alias("winner")
    )
    asked = _keys(families.select("dir", "base", "stem", "suffix", "member"), scheme)
    met = asked.join(_both_markers(members), ["dir", "key", "marker"])
    return met.groupBy("dir", "base", "slot").agg(F.min("winner").alias("winner"))


def _slots_after(ranked: DataFrame, held: DataFrame) -> DataFrame:
    """Slots where the runs of slots in the way are known, however many those are.

    A run moves all files up from the rank that would have met it. Running sums find these ranks, and
    a second running sum over ranks and runs together says how far each file moves.
    """
    by = F.col("to") - F.col("from") + 1
    runs = running(held.select("dir", "base", "from", by.alias("by")), ["dir", "base"], ["from"], totals={"upto": "by"})
    marks = runs.select(
        "dir", "base", (F.col("from") - F.col("upto") + F.col("by")).alias("rank"), F.lit(0).alias("_kind"),
        F.col("from").alias("_tie"), "by",
    )
    kept = ranked.columns
    concerned = held.select("dir", "base").distinct()
    others = ranked.join(concerned, ["dir", "base"], "left_anti").withColumn("slot", F.col("rank"))
    files = ranked.join(concerned, ["dir", "base"], "left_semi").withColumns(
        {"_kind": F.lit(1), "_tie": F.col("rank"), "by": F.lit(0).cast("bigint")}
    )
    both = files.unionByName(marks, allowMissingColumns=True)
    moved = running(both, ["dir", "base"], ["rank", "_kind", "_tie"], totals={"moved": "by"})
    done = moved.where("_kind = 1").withColumn("slot", F.col("rank") + F.col("moved"))
    return others.unionByName(done.select(*kept, "slot"))


def _gates(beaten: DataFrame, ranked: DataFrame, held: DataFrame | None) -> DataFrame:
    """Lost slots (dir, base, slot, gate): such a slot is passed over if fewer than ``gate`` were before it.

    With m slots passed over, a slot would be that of rank slot - m. It is still there for as many files as come
    before the winner; slots held since earlier runs are passed over in any case, and no others are lost there.
    """
    none, one = F.lit(None).cast("bigint"), F.lit(1).cast("bigint")
    marks = beaten.select("dir", "base", F.col("winner").alias("_at"), "slot", F.lit(0).cast("bigint").alias("_one")).unionByName(
        ranked.select("dir", "base", F.col("_order").alias("_at"), none.alias("slot"), one.alias("_one"))
    )
    counted = running(marks, ["dir", "base"], ["_at", "_one", "slot"], totals={"earlier": "_one"})
    lost = counted.where("slot IS NOT NULL").select("dir", "base", "slot", "earlier")
    if held is None:
        return lost.select("dir", "base", "slot", (F.col("slot") - F.col("earlier")).alias("gate"))

    def mark(at: Column, by: Column, inside: int) -> DataFrame:
        return held.select(
            "dir", "base", at.alias("_at"), F.lit(0).alias("_kind"), by.cast("bigint").alias("_by"), F.lit(inside).cast("bigint").alias("_in"),
            none.alias("slot"), none.alias("earlier"),
        )

    opens = mark(F.col("from"), F.col("to") - F.col("from") + 1, 1)
    ends = mark(F.col("to") + 1, F.lit(0), -1)
    zero = F.lit(0).cast("bigint")
    slots = lost.withColumns({"_at": F.col("slot"), "_kind": F.lit(1), "_by": zero, "_in": zero})
    both = slots.unionByName(opens).unionByName(ends)
    passed = running(both, ["dir", "base"], ["_at", "_kind", "_in"], totals={"_held": "_by", "_inside": "_in"})
    free = passed.where("_kind = 1 and _inside = 0")
    return free.select("dir", "base", "slot", (F.col("slot") - F.col("earlier") - F.col("_held")).alias("gate"))


def _settle_meetings(ranked: DataFrame, families: DataFrame, held: DataFrame | None, scheme: Scheme) -> DataFrame:
    """Slots for families that meet others."""
    # (dir, base, slot, winner): slots lost to a file of another family
    beaten = settle(_seeds(families, scheme), "beaten")
    while True:
        passed = gated(_gates(beaten, ranked, held), ["dir", "base"], ["slot"], "gate").where("counts")
        lost = passed.select("dir", "base", F.col("slot").alias("from"), F.col("slot").alias("to"))
        moved = _slots_after(ranked, settle(lost if held is None else lost.unionByName(held), "lost"))
        named = settle(moved.withColumn("name", scheme.name(F.col("base"), F.col("slot"))), "named")
        winners = (
            named.groupBy("dir", "name")
            .agg(F.min("_order").alias("winner"), F.count("*").alias("n"))
            .where("n > 1")
        )
        losers = (
            named.join(winners, ["dir", "name"])
            .where(F.col("_order") > F.col("winner"))
            .select("dir", "base", "slot", "winner")
        )
        if losers.isEmpty():
            return named.drop("name")
        beaten = settle(
            losers.unionByName(beaten).groupBy("dir", "base", "slot").agg(F.min("winner").alias("winner")), "beaten"
        )


def allocate(
    df: DataFrame, scheme: Scheme, dir: str, base: str, order: str, taken: DataFrame | None, into: str
) -> DataFrame:
    """Add the name each file gets; ``order`` tells files apart and ranks them."""
    kept = df.columns
    # what the rows are made of is worked out once; only three columns are moved for the numbering
    waiting = settle(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(order).alias("_key")), "waiting")
    asked = waiting.select(F.col(f"_row.`{dir}`").alias("dir"), F.col(f"_row.`{base}`").alias("base"), F.col("_key").alias("_order"))
    ranked = running(asked, ["dir", "base"], ["_order"], "rank")
    asked_base = F.col("base")
    families = settle(
        ranked.groupBy("dir", "base")
        .agg(F.count("*").alias("files"), F.min("_order").alias("first"))
        .withColumns(
            {
                "stem": scheme.stem(asked_base),
                "suffix": scheme.suffix(asked_base),
                "member": _as_member(asked_base, scheme),
            }
        ),
        "families",
    )
    held = None
    if taken is not None:
        held = settle(_taken_slots(families, taken, scheme), "held")
    meeting = settle(_meeting(families, held, scheme), "meeting")

    def alone(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.col("rank")) if held is None else _slots_after(rows, held)

    if meeting.isEmpty():
        done = alone(ranked)
    else:
        on = ["dir", "base"]
        apart = alone(ranked.join(meeting, on, "left_anti"))
        met = ranked.join(meeting, on, "left_semi")
        held_met = held.join(meeting, on, "left_semi") if held is not None else None
        among = families.join(meeting, on, "left_semi")
        done = apart.unionByName(_settle_meetings(met, among, held_met, scheme))
    names = done.select("_order", scheme.name(F.col("base"), F.col("slot")).alias("_name"))
    named = waiting.join(names, F.col("_key").eqNullSafe(F.col("_order")))
    return named.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept if c != into], F.col("_name").alias(into))


def unique_names(
    df: DataFrame,
    dir: str = "dir",
    name: str = "name",
    order: str = "file",
    taken: DataFrame | None = None,
    into: str = "final_name",
) -> DataFrame:
    """Portable, collision-free names for renamed files; ``taken`` holds (dir, name) filed earlier."""
    safe = df.withColumn("_safe", safe_filename(F.col(name)))
    return allocate(safe, RENAMED, dir, "_safe", order, taken, into).drop("_safe")


def unique_original_names(
    df: DataFrame,
    dir: str = "dir",
    name: str = "file",
    order: str = "file",
    taken: DataFrame | None = None,
    into: str = "final_name",
) -> DataFrame:
    """Collision-free names for files that keep the name they came with."""
    return allocate(df, ORIGINAL, dir, name, order, taken, into)
