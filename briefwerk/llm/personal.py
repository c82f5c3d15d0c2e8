"""Personal data by bootstrapped contextual extraction.

Four fixed rules find emails, IP addresses, card and phone numbers: the seeds. Every identifier-like string (seed or
not) is written down with the lexical patterns it stands in: the word before it, the two words before it, and the word
before with the word after. Identifier-like are tokens with a digit or an at sign, groups of digits joined by blanks,
brackets, dots, slashes and hyphens, and addresses spelled out ("anna at firma dot de"). Patterns and instances are the two sides of a graph, and Spark scores it in rounds:

* a pattern's confidence for a kind is the mean score of the different instances it holds, shrunk for few;
* an instance that is no seed scores as one minus the product of its patterns' doubts.

Patterns with a confidence of ``confidence`` or more, held up by ``support`` different seeds, then discover: the
strings of a fitting form that they surround, and that overlap no seed, become spans of that kind. Seeds stay.

The graph has a row per different (pattern, instance), so copies count once, and only sums per pattern or instance
are shuffled. One scan reads the texts; everything after works on narrow tables.

Defined results: null and empty texts have no spans; positions count code points, ends are exclusive; repeated rows
are read one by one (their instances still count once); identifiers may have any length, beyond 64 characters a digest
stands for them in the graph; strings that are no seeds do not overlap, and have at least four characters (three with an at
sign); contexts are looked for up to 64 characters before and 40 after a string, where a longer word counts by that part
of it; a text may be of any length; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import RowKeys, maybe, packed_row, pieces, table

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE, SUPPORT, ROUNDS, SHRINK = 0.8, 5, 3, 1.0

# fixed values: the rules of the contract, taken apart so that no text makes them retry
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+|@")
# groups of digits, joined by up to three of the signs that numbers are written with
_GROUPS = re.compile(r"(?:\+[ ]?)?(?:\([ ]?)?[0-9]++(?:[ ()./-]{1,3}+[0-9]++)*+")
_PART = re.compile(r"\+?[0-9](?:[^ ()]*[0-9])?")
_SPELLED = re.compile(r"(?:[ ]at[ ]|[ ]?[\[({][ ]?at[ ]?[\])}][ ]?)(?P<domain>[a-z0-9-]++(?:(?:[ ]dot[ ]|[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?|\.)[a-z0-9-]++)++)", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+/-")
_REST = re.compile(r"[A-Za-z0-9@._%+/-]*")
LONGEST, LEFT, RIGHT = 64, 64, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), leftmost and non-overlapping per kind; matches that fail their check are gone."""
    spans = []
    at, end = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                spans.append((0, start, domain.end()))
                end = domain.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                spans.append((1, start, stop))
            start = stop + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], s[0]))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a string."""
    left = text[max(0, start - LEFT) : start].lower()
    before, right = left.split(), text[end : end + RIGHT].lower().split()
    glued = "" if not left or left[-1].isspace() else "~"  # the word before ends where the string begins
    last = (before[-1] if before else "^") + glued
    cue = [f"0 {last}"] if before else []  # the beginning of a text says nothing about what stands there
    return [*cue, f"2 {before[-2] if len(before) > 1 else '^'} {last}", f"1 {last} _ {right[0] if right else '$'}"]


def form(value: str) -> str:
    """What kind of string it is: a name with an at sign, also a spelled one, a number, or a mixture."""
    if "@" in value or _SPELLED.search(value):
        return "at"
    return "number" if not any(c.isalpha() for c in value) else "mixed"


FORMS = {"email": ("at", "mixed"), "ip": ("number",), "card": ("number",), "phone": ("number",)}


def instance(value: str) -> str:
    """What stands for a string in the graph: itself, or a digest of a long one."""
    return value if len(value) <= LONGEST else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the signs spelled out."""
    end = 0
    for m in _SPELLED.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        # a sentence may hold the word "at" before a name with a dot: there the dot must be spelled too
        plain = m.group().lower().startswith(" at ") and not re.search(r"dot\b", m["domain"], re.I)
        if start < m.start() and not plain:
            yield start, m.end()
            end = m.end()


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign; one without letters goes on over the groups of digits it is joined with."""
    done = 0
    for m in _RUN.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _NAME:
            start -= 1
        done = _REST.match(text, m.start()).end()
        end = done
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+@"):
            start += 1
        if start < end and not any(c.isalpha() or c in "@_%" for c in text[start:end]):
            # a bracket or a plus before the first group belongs to it
            first = start - 1 if start and text[start - 1] == "(" else start
            first = first - 1 if first and first < start and text[first - 1] == "+" else first
            group = _GROUPS.match(text, first)
            if group and group.end() >= end:
                last = group.end()
                # of a last token with letters nothing is taken: "555 1234 5th"
                if last < len(text) and (text[last].isalpha() or text[last] in "@_%"):
                    while last > end and text[last - 1] not in " ()":
                        last -= 1
                    while last > end and not text[last - 1].isdigit():
                        last -= 1
                whole = last > end or ")" in text[first:last]
                start, end = first if whole else start, max(last, end)
                done = max(done, end)
        yield start, end


def strings(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(kind or -1, start, end, value) of the seeds and of all other identifier-like strings."""
    for kind, start, end in spans:
        yield kind, start, end, instance(text[start:end].lower())
    taken = sorted((s, e) for _, s, e in spans)
    spelled = list(_clear(text, _spelled(text), taken))
    for start, end in (*spelled, *_clear(text, _tokens(text), sorted(taken + spelled))):
        if end - start >= (3 if "@" in text[start:end] else 4):
            yield -1, start, end, instance(text[start:end].lower())


def _clear(text: str, found: Iterator[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What overlaps nothing taken (sorted by start); of a group of digits that does, the parts that do not."""
    starts, ends = [], []
    for start, end in taken:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(start: int, end: int) -> bool:
        k = bisect_right(ends, start)
        return k == len(starts) or starts[k] >= end

    for start, end in found:
        if free(start, end):
            yield start, end
        else:
            yield from (part.span() for part in _PART.finditer(text, start, end) if free(*part.span()))


SCANNED = (
    "row_key bigint, doc_id bigint, _h1 bigint, _h2 bigint, base array<struct<kind:int,start:bigint,stop:bigint>>, "
    "found array<struct<kind:int,start:bigint,stop:bigint,value:string,form:string,patterns:array<string>>>"
)
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.struct([*_SPAN, pa.field("value", pa.string()), pa.field("form", pa.string()), pa.field("patterns", pa.list_(pa.string()))])
_SCANNED = pa.schema([*[(c, pa.int64()) for c in ("row_key", "doc_id", "_h1", "_h2")], ("base", pa.list_(_SPAN)), ("found", pa.list_(_FOUND))])


def scan(docs: DataFrame) -> DataFrame:
    """Seeds and identifier-like strings of every document, with two hashes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = RowKeys()
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                base, found = [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    spans = base_spans(text or "")
                    base.append([{"kind": k, "start": s, "stop": e} for k, s, e in spans])
                    found.append([
                        {"kind": k, "start": s, "stop": e, "value": v, "form": form(text[s:e]), "patterns": patterns(text, s, e)}
                        for k, s, e, v in strings(text or "", spans)
                    ])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.take(part.num_rows)), *[part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_h1", "_h2")],
                    pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND)),
                ], schema=_SCANNED)

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2"), "text"
    ).mapInArrow(run, SCANNED)


def confident_patterns(scanned: DataFrame, confidence: float, support: int, rounds: int) -> DataFrame:
    """(pattern, kind, confidence): what the graph's rounds leave as patterns that may discover."""
    seen = scanned.select(F.explode("found").alias("f")).select(F.explode("f.patterns").alias("pattern"), "f.value", "f.kind")
    edges = settle(seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    sizes = settle(
        edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"seeds_{k}") for k in range(len(KINDS))])
        # only patterns that hold a seed can score, and only those with enough of them may discover
        .where(" + ".join(f"seeds_{k}" for k in range(len(KINDS))) + " > 0"),
        "patterns",
    )
    scores = [F.when(F.col("kind") == k, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"s_{k}") for k in range(len(KINDS))]
    weighted = settle(edges.join(sizes.select("pattern"), "pattern").select("pattern", "value", "kind", *scores), "graph")
    for step in range(rounds):
        rated = weighted.groupBy("pattern").agg(
            *[(F.sum(F.round(f"s_{k}", 6).cast("decimal(20,6)")).cast("double") / (F.count(F.lit(1)) + SHRINK)).alias(f"c_{k}") for k in range(len(KINDS))]
        )
        rated = settle(rated, "rated")
        if step == rounds - 1:
            break
        open_ = weighted.where("kind < 0").select("pattern", "value")
        instance = open_.join(rated, "pattern").groupBy("value").agg(
            *[
                (1 - F.exp(F.sum(F.round(F.ln(F.greatest(1 - F.col(f"c_{k}"), F.lit(1e-6))), 6).cast("decimal(20,6)")).cast("double"))).alias(f"s_{k}")
                for k in range(len(KINDS))
            ]
        )
        fresh = open_.join(instance, "value").select("pattern", "value", F.lit(-1).alias("kind"), *[f"s_{k}" for k in range(len(KINDS))])
        weighted = settle(weighted.where("kind >= 0").unionByName(fresh), "graph")
    both = rated.join(sizes, "pattern")
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"c_{k}").alias("confidence"), F.col(f"seeds_{k}").alias("seeds")) for k in range(len(KINDS))
    ]))
    rows = both.select("pattern", each.alias("x")).select("pattern", "x.kind", "x.confidence", "x.seeds")
    return rows.where((F.col("confidence") >= confidence) & (F.col("seeds") >= support)).select("pattern", "kind", "confidence")


def personal_spans(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) → row_key, doc_id, base, added (arrays of kind, start, stop in code points), one row per document."""
    scanned = settle(scan(docs), "scanned")
    known = settle(confident_patterns(scanned, confidence, support, rounds), "confident")
    open_ = (
        scanned.select("row_key", F.explode("found").alias("f")).where("f.kind < 0")
        .select("row_key", "f.start", "f.stop", "f.form", F.explode("f.patterns").alias("pattern"))
    )
    fits = F.lit(False)
    for k, name in enumerate(KINDS):
        fits = fits | ((F.col("kind") == k) & F.col("form").isin(*FORMS[name]))
    # the most confident pattern names the kind
    best = (
        open_.join(known, "pattern").where(fits).groupBy("row_key", "start", "stop")
        .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    )
    added = best.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("b.k")).cast("int").alias("kind"), "start", "stop"))).alias("added")
    )
    none = F.expr("cast(array() as array<struct<kind:int,start:bigint,stop:bigint>>)")
    return scanned.join(added, "row_key", "left").select("row_key", "doc_id", *keep, "base", F.coalesce("added", none).alias("added"))


def _listed(spans):
    """kind:start:end by start, then kind, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(docs: DataFrame, **settings) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, if there, follows.

    Added spans depend on the text alone, so they go back to texts by 128 bits of hashes; only texts that may have
    some go through that join. Of spans that overlap, the one that begins first is replaced, then the longest.
    """
    keys = {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")}
    found = personal_spans(docs, keep=("_h1", "_h2"), **settings).where(F.size("added") > 0)
    added = settle(found.groupBy("_h1", "_h2").agg(F.first("added").alias("_added")), "added")
    seen = maybe(docs.select(packed_row(docs), "text"), "xxhash64(text)", added.select(F.col("_h1").alias("hash")))
    joined = seen.where("_maybe").withColumns(keys).join(added, ["_h1", "_h2"], "left").select("row", "text", "_added")
    alone = seen.where("not _maybe").select("row", "text", F.lit(None).cast(added.schema["_added"].dataType).alias("_added"))
    both = joined.unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
                changed = [
                    None if t is None else replaced(t, base_spans(t) + [(x["kind"], x["start"], x["stop"]) for x in more or ()])
                    for t, more in zip(column("text").to_pylist(), column("_added").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([column("row"), pa.array(changed, pa.string())], names=["row", "new"])

    done = both.mapInArrow(run, T.StructType([both.schema["row"], T.StructField("new", T.StringType())]))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]])


def op3_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
