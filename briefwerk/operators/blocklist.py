"""Blocklists of any length.

A list in the plan is tried on every text (``redact.redact``). A list of a million is not
tried term by term. Each term has an *anchor*, a run of its bytes; texts are scanned once
for runs that may be anchors, such runs are looked up by equality, and only terms that do
occur are folded, in list order.

A run that many terms or many texts hold would be a poor anchor: a common beginning of all
terms would find all of them in every text that has it. So a sketch counts the runs of some
texts, and of each term the run that is rarest there is taken. What the sketch says decides
about time alone; the result is that of trying every term on every text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import fold_case, fold_terms, term_can_follow_a_label
from ..session import settle
from . import grams

SAMPLED = 4096  # texts that are looked at for the sketch, about
_SKETCH = 1 << 16  # its counters
_FLAGS = 1 << 23  # bits that say which runs may be anchors: 1 MB, whatever the number of terms


def _pattern(term: Column) -> Column:
    quoted = F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(r"(?iu)\Q"), quoted, F.lit(r"\E"))


def _sketch(texts: DataFrame, id: str, sizes: list[int], sampled: int) -> np.ndarray:
    """How often runs of the given sizes occur in some texts, picked by a hash of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SKETCH, dtype=np.int64)
        for batch in batches:
            data, offsets = grams.raw(batch.column(0))
            for size in sizes:
                for _, found in grams.stretches(data, offsets, size):
                    counts += np.bincount(found & np.uint64(_SKETCH - 1), minlength=_SKETCH)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["at", "n"])

    one_in = max(1, texts.count() // sampled)
    some = texts.where(F.pmod(F.xxhash64(id), F.lit(one_in)) == 0).select("_text")
    counted = some.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SKETCH, dtype=np.int64)
    out[counted["at"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def _anchors(terms: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Terms (line_no, term, _folded) with the size and the hash of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.raw(batch.column(2))
            sizes, chosen = [], []
            for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                size = grams.size_of(last - first)
                found = grams.hashes(data[first:last], size)
                chosen.append(found[np.argmin(sketch[found & np.uint64(_SKETCH - 1)])])
                sizes.append(size)
            more = [pa.array(sizes, pa.int32()), pa.array(np.array(chosen, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_size", "_hash"])

    kinds = dict(terms.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("line_no", "term", "_folded"))
    return terms.select("line_no", "term", "_folded").mapInArrow(run, f"{schema}, _size int, _hash bigint")


def _flags(anchors: DataFrame) -> np.ndarray:
    """A bit per hash that an anchor has, by its lowest bits."""
    slot = f"(_hash & {_FLAGS - 1})"
    words = anchors.groupBy(F.expr(f"{slot} div 64").alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias("bits")
    )
    found = words.toPandas()
    out = np.zeros(_FLAGS // 64, dtype=np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _possible(texts: DataFrame, id: str, sizes: list[int], flags: np.ndarray) -> DataFrame:
    """(id, _hash) of runs that may be anchors, once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = grams.raw(batch.column(1))
            for size in sizes:
                for first, found in grams.stretches(data, offsets, size):
                    at = np.flatnonzero(flags[found & np.uint64(_FLAGS - 1)])
                    places, row = grams.within(at + first, offsets, size)
                    keys = np.stack([row, found[places - first].view(np.int64)], axis=1)
                    keys = np.unique(keys, axis=0)
                    if len(keys):
                        ids = batch.column(0).take(pa.array(keys[:, 0]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(keys[:, 1])], names=[id, "_hash"])

    kind = dict(texts.dtypes)[id]
    return texts.select(id, "_text").mapInArrow(run, f"`{id}` {kind}, _hash bigint")


def candidates(df: DataFrame, terms: DataFrame, id: str, text: str, sampled: int = SAMPLED) -> DataFrame:
    """(id, terms in list order) for the texts that hold some term before anything is replaced."""
    # of equal terms the first one leaves nothing to the others
    listed = terms.groupBy("term").agg(F.min("line_no").alias("line_no")).withColumn("_folded", fold_case(F.col("term")))
    folded = df.select(id, fold_case(F.col(text)).alias("_text"))
    kept = listed.where("_folded <> ''")
    lengths = kept.groupBy(F.least(F.octet_length("_folded"), F.lit(max(grams.SIZES))).alias("n")).count().collect()
    sizes = sorted({grams.size_of(r.n) for r in lengths})
    anchors = settle(_anchors(kept, _sketch(folded, id, sizes, sampled)), "anchors")
    hits = _possible(folded, id, sizes, _flags(anchors)).join(anchors, "_hash")
    # an anchor may lie in a text without the rest of its term
    found = hits.join(folded, id).where(F.contains("_text", F.col("_folded")))
    return found.groupBy(id).agg(F.collect_set(F.struct("line_no", "term")).alias("_found"))


def redact_terms(df: DataFrame, terms: DataFrame, id: str, text: str) -> DataFrame:
    """Redact the terms of a table (line_no, term) in list order; adds redacted_text and n_name.

    ``id`` tells the rows of ``df`` apart. The result equals trying every term on every text.
    """
    # putting in a label can make room for some terms: those are tried wherever any term was found
    always = terms.where((F.col("term") != "") & term_can_follow_a_label(F.col("term"))).agg(
        F.collect_list(F.struct("line_no", "term")).alias("_always")
    )
    found = candidates(df, terms, id, text).withColumn("_always", always.scalar())
    ordered = found.select(
        id, F.array_sort(F.array_distinct(F.concat("_found", "_always"))).alias("_terms")
    )
    patterns = ordered.select(id, F.transform("_terms", lambda t: _pattern(t["term"])).alias("_patterns"))
    joined = df.join(patterns, id, "left")
    done = joined.withColumn(
        "_folded",
        F.when(F.col("_patterns").isNotNull(), fold_terms(F.col(text), F.col("_patterns"))),
    )
    return done.select(
        *df.columns,
        F.coalesce("_folded.text", F.col(text)).alias("redacted_text"),
        F.coalesce("_folded.hits", F.lit(0)).alias("n_name"),
    )
