"""Benchmark decontamination with an FM-index per shard of the training corpus.

Documents are cut into words and packed into shards of bounded size. Each shard becomes one row that holds a
self-contained FM-index: the words' dictionary, the Burrows-Wheeler transform of their numbers as a wavelet
matrix with rank counts, and every ``sample``-th suffix position. The index knows nothing of the phrases, is
written once to the shared folder, and is searched by any number of phrase blocks.

A search takes all phrases of a block backwards through the wavelet ranks at once, locates the occurrences by
walking to the next sampled position, and merges what is covered to spans of words.

Defined results: null and empty texts have no words; a text longer than a shard is cut into segments that
overlap by a window less one word, so no occurrence is lost; an item without words has no windows; equal items
and repeated rows count by their own ids and rows; items without an id are searched like others, count as one item
together, and add nothing to the digest of ids; without documents there are no rows, without items no hits; extra columns
are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from ..session import settle
from .common import RowKeys, give_back, hashed_words, maybe, packed_row, pieces, table, text_hashes, texts

INDEX_SCHEMA = (
    "row_keys binary, doc_ids array<bigint>, text_hashes binary, n_words binary, segment_doc binary, segment_base binary, "
    "segment_start binary, dictionary binary, counts binary, bits binary, ranks binary, zeros binary, "
    "sampled_bits binary, sampled_ranks binary, samples binary, n bigint"
)
INDEX_ARROW = pa.schema([
    (name, {"binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[kind])
    for name, kind in (field.split() for field in INDEX_SCHEMA.split(", "))
])
HIT_SCHEMA = "row_key bigint, starts array<bigint>, ends array<bigint>, phrases array<bigint>"
LISTED = "row_key bigint, doc_id bigint, n_words bigint, _h1 bigint, _h2 bigint"


# ---------------------------------------------------------------- suffixes


def suffix_order(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; the symbols at ``separators`` count as different, in their order.

    Prefix doubling that starts with three symbols and from then on sorts only what is not yet told apart.
    """
    n = len(symbols)
    base = symbols.astype(np.int64) + len(separators)
    base[separators] = np.arange(len(separators))
    ahead = np.zeros(n + 3, dtype=np.int64)
    ahead[:n] = base + 1
    key = (ahead[:n] << 42) | (ahead[1 : n + 1] << 21) | ahead[2 : n + 2]
    order = np.argsort(key)
    ranks = np.zeros(n + 1, dtype=np.int64)  # the rank of a position: how many suffixes are known to be smaller
    sorted_key = key[order]
    change = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    at = np.flatnonzero(change)
    first = np.repeat(at, np.diff(np.r_[at, n]))
    ranks[order] = first + 1
    sizes = np.repeat(np.diff(np.r_[at, n]), np.diff(np.r_[at, n]))
    open_ = order[sizes > 1]
    width = 3
    while len(open_):
        key = (ranks[open_] << 32) | ranks[np.minimum(open_ + width, n)]
        turn = np.argsort(key)
        open_, key = open_[turn], key[turn]
        old = key >> 32
        old_first = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(key)), 0))
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        new_first = np.repeat(at, size)
        ranks[open_] = old + new_first - old_first
        open_ = open_[np.repeat(size, size) > 1]
        width *= 2
    out = np.empty(n, dtype=np.int64)
    out[ranks[:n] - 1] = np.arange(n)
    return out


# ---------------------------------------------------------------- bit vectors and wavelet matrix


def pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector as bytes, and the ones before each 64-bit word."""
    padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
    padded[: len(bits)] = bits
    packed = np.packbits(padded, bitorder="little")
    ones = np.bitwise_count(packed.view(np.uint64)).astype(np.uint32)
    before = np.zeros(len(ones), dtype=np.uint32)
    np.cumsum(ones[:-1], out=before[1:])
    return packed, before


class Bits:
    def __init__(self, packed: np.ndarray, before: np.ndarray) -> None:
        self.words, self.before = packed.view(np.uint64), before

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[block] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


def wavelet(values: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """A wavelet matrix, highest bit first: packed bits and rank counts of each level, and its zeros."""
    bits, ranks, zeros = [], [], np.zeros(levels, dtype=np.int64)
    values = values.astype(np.uint32)
    for k in range(levels):
        one = (values >> np.uint32(levels - 1 - k)) & np.uint32(1) == 1
        packed, before = pack(one)
        bits.append(packed)
        ranks.append(before)
        zeros[k] = len(values) - np.count_nonzero(one)
        values = np.concatenate([values[~one], values[one]])
    return bits, ranks, zeros


class Index:
    """One shard's FM-index, from its row."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.n = row["n"]
        self.row_keys, self.n_words = read("row_keys", np.int64), read("n_words", np.int64)
        self.segment_doc, self.segment_base = read("segment_doc", np.int64), read("segment_base", np.int64)
        self.segment_start = read("segment_start", np.int64)
        self.dictionary, self.counts = read("dictionary", np.uint64), read("counts", np.int64)
        self.zeros, self.samples = read("zeros", np.int64), read("samples", np.uint32)
        self.sampled = Bits(read("sampled_bits", np.uint8), read("sampled_ranks", np.uint32))
        bits, ranks = read("bits", np.uint8), read("ranks", np.uint32)
        levels = len(self.zeros)
        width, depth = len(bits) // max(levels, 1), len(ranks) // max(levels, 1)
        self.levels = [Bits(bits[k * width : (k + 1) * width], ranks[k * depth : (k + 1) * depth]) for k in range(levels)]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position i of the transform."""
        low = np.zeros_like(i)
        for k, level in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            a, b = level.rank(low), level.rank(i)
            low = np.where(one, self.zeros[k] + a, low - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def step(self, i: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one word earlier than those of rows i."""
        symbol, low, at = np.zeros_like(i), np.zeros_like(i), i
        for k, level in enumerate(self.levels):
            one = level.get(at)
            a, b = level.rank(low), level.rank(at)
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
            symbol = symbol * 2 + one
        return self.counts[symbol] + at - low

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The shard's numbers of hashed words, -1 for those it lacks."""
        if not len(self.dictionary):
            return np.full(words.shape, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.dictionary, words), len(self.dictionary) - 1)
        return np.where(self.dictionary[at] == words, at + 1, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, last row + 1) of the phrases that occur; phrases are rows of hashes, left-aligned."""
        column = np.arange(phrases.shape[1])
        symbols = self.numbers(phrases)
        live = np.flatnonzero(((symbols > 0) | (column >= lengths[:, None])).all(axis=1) & (lengths > 0))
        if not len(live):
            return live, live, live
        last = symbols[live, lengths[live] - 1]
        low, high = self.counts[last], self.counts[last + 1]
        for back in range(2, phrases.shape[1] + 1):
            go = lengths[live] >= back
            if not go.any():
                break
            symbol = symbols[live[go], lengths[live[go]] - back]
            low[go] = self.counts[symbol] + self.rank(symbol, low[go])
            high[go] = self.counts[symbol] + self.rank(symbol, high[go])
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back until a sampled position, then add the steps."""
        out, steps, left = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(left):
            found = self.sampled.get(rows)
            out[left[found]] = self.samples[self.sampled.rank(rows[found])].astype(np.int64) + steps
            left, rows = left[~found], rows[~found]
            if len(left):
                rows = self.step(rows)
            steps += 1
        return out


# ---------------------------------------------------------------- building


def _shard(docs: list[tuple], segments: list[tuple], sample: int) -> dict:
    """One index row. docs: (row key, doc_id, words, two hashes of the text); segments: (doc number, first word, hashes)."""
    lengths = np.array([len(s[2]) for s in segments], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int64)  # a separator follows each segment
    n = int((lengths + 1).sum())
    hashes = np.concatenate([s[2] for s in segments]) if segments else np.zeros(0, np.uint64)
    numbers, seen = pd.factorize(hashes)
    by_size = np.argsort(seen)
    dictionary, numbers = seen[by_size], np.argsort(by_size)[numbers]
    symbols = np.zeros(n, dtype=np.int64)
    is_word = np.ones(n, dtype=bool)
    separators = starts + lengths
    is_word[separators] = False
    symbols[is_word] = numbers + 1
    order = suffix_order(symbols, separators)
    transform = symbols[order - 1]
    transform[order == 0] = 0
    levels = max(1, int(len(dictionary)).bit_length())
    bits, ranks, zeros = wavelet(transform, levels)
    counts = np.zeros(len(dictionary) + 2, dtype=np.int64)
    np.cumsum(np.bincount(symbols, minlength=len(dictionary) + 1), out=counts[1:])
    is_sampled = np.zeros(n, dtype=bool)
    is_sampled[starts] = True
    is_sampled[::sample] = True
    marked = is_sampled[order]
    sampled_bits, sampled_ranks = pack(marked)
    join = lambda parts: b"".join(p.tobytes() for p in parts)
    return {
        "row_keys": np.array([d[0] for d in docs], dtype=np.int64).tobytes(), "doc_ids": [d[1] for d in docs],
        "text_hashes": np.array([d[3:] for d in docs], dtype=np.int64).tobytes(),
        "n_words": np.array([d[2] for d in docs], dtype=np.int64).tobytes(),
        "segment_doc": np.array([s[0] for s in segments], dtype=np.int64).tobytes(),
        "segment_base": np.array([s[1] for s in segments], dtype=np.int64).tobytes(),
        "segment_start": starts.tobytes(), "dictionary": dictionary.tobytes(), "counts": counts.tobytes(),
        "bits": join(bits), "ranks": join(ranks), "zeros": zeros.tobytes(), "sampled_bits": sampled_bits.tobytes(),
        "sampled_ranks": sampled_ranks.tobytes(), "samples": order[marked].astype(np.uint32).tobytes(),
        "n": n,
    }


def build_index(docs: DataFrame, window: int = 10, shard_words: int = 1 << 19, sample: int = 8) -> DataFrame:
    """(doc_id, text) → one FM-index row per shard of at most ``shard_words`` words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = RowKeys()
        rows: list[tuple] = []
        segments: list[tuple] = []
        held = 0

        def flush():
            out = pa.RecordBatch.from_pylist([_shard(rows, segments, sample)], schema=INDEX_ARROW)
            rows.clear()
            segments.clear()
            return out

        for batch in batches:
            for part in pieces(batch):
                hashes, first, _, _ = hashed_words(*texts(part))
                ids, h1, h2 = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "_h1", "_h2"))
                for key, doc_id, a, b, *text in zip(keys.take(len(ids)), ids, first[:-1], first[1:], h1, h2, strict=True):
                    if held and held + (b - a) + 1 > shard_words:
                        yield flush()
                        held = 0
                    rows.append((key, doc_id, b - a, *text))
                    base = 0
                    while True:
                        piece = hashes[a + base : min(b, a + base + shard_words)]
                        segments.append((len(rows) - 1, base, piece.copy()))
                        held += len(piece) + 1
                        if a + base + len(piece) >= b:
                            break
                        base += len(piece) - (window - 1)
                        yield flush()
                        held = 0
                        rows.append((key, doc_id, -1, *text))  # the same document goes on: its words are counted once
        if rows:
            yield flush()

    hashes = [h.alias(name) for name, h in text_hashes().items()]
    return docs.select("doc_id", "text", *hashes).mapInArrow(build, INDEX_SCHEMA)


# ---------------------------------------------------------------- phrases and searching


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(item_id, phrase): the windows of all items, each as the hashes of its words, 8 bytes a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                hashes, first, _, _ = hashed_words(*texts(part))
                ids = part.column(part.schema.get_field_index("item_id"))
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    length = min(window, b - a)
                    raw = hashes[a:b].tobytes()
                    for at in range(0, b - a - length + 1 if length else 0, 1 << 16):
                        some = range(at, min(at + (1 << 16), b - a - length + 1))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[k].as_py()] * len(some), pa.int64()), pa.array([raw[8 * i : 8 * (i + length)] for i in some], pa.binary())],
                            names=["item_id", "phrase"],
                        )

    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    return known.mapInArrow(run, "item_id bigint, phrase binary")


def _spans(index: Index, phrases: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> Iterator[dict]:
    """Merged spans and phrases of the shard's documents that hold one."""
    phrase, low, high = index.search(phrases, lengths)
    if not len(phrase):
        return
    count = high - low
    which = np.repeat(phrase, count)
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    position = index.locate(rows)
    segment = np.searchsorted(index.segment_start, position, side="right") - 1
    doc = index.segment_doc[segment]
    start = position - index.segment_start[segment] + index.segment_base[segment]
    order = np.lexsort((start, doc))
    doc, start, which = doc[order], start[order], which[order]
    end = start + lengths[which]
    # spans of a document that touch become one: ends only grow with the starts of equally long windows, so
    # take the running maximum within the document
    far = np.maximum.accumulate(doc * (1 << 40) + end) - doc * (1 << 40)
    opens = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])]
    at = np.flatnonzero(opens)
    span_doc, span_start, span_end = doc[at], start[at], far[np.r_[at[1:], len(doc)] - 1]
    cuts = np.r_[np.flatnonzero(np.r_[True, span_doc[1:] != span_doc[:-1]]), len(span_doc)]
    doc_cuts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)]
    for k in range(len(cuts) - 1):
        yield {
            "row_key": int(index.row_keys[span_doc[cuts[k]]]),
            "starts": span_start[cuts[k] : cuts[k + 1]].tolist(),
            "ends": span_end[cuts[k] : cuts[k + 1]].tolist(),
            "phrases": np.unique(numbers[which[doc_cuts[k] : doc_cuts[k + 1]]]).tolist(),
        }


def search_index(index: DataFrame, phrases: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """Hits of one phrase block: row_key, span starts and ends in words, numbers of the phrases."""
    sent = index.sparkSession.sparkContext.broadcast((phrases, lengths, numbers))
    arrow = pa.schema([("row_key", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("starts", "ends", "phrases")]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(_spans(Index(batch.slice(k, 1).to_pylist()[0]), *sent.value))
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
            give_back()

    return index.drop("doc_ids", "text_hashes").mapInArrow(search, HIT_SCHEMA)


def documents_of(index: DataFrame) -> DataFrame:
    """row_key, doc_id, n_words and the two text hashes of every indexed document, once."""

    arrow = pa.schema([(field.split()[0], pa.int64()) for field in LISTED.split(", ")])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                get = lambda name: row.column(row.schema.get_field_index(name))
                words = np.frombuffer(get("n_words")[0].as_py(), dtype=np.int64)
                keys = np.frombuffer(get("row_keys")[0].as_py(), dtype=np.int64)
                hashes = np.frombuffer(get("text_hashes")[0].as_py(), dtype=np.int64).reshape(-1, 2)
                ids = get("doc_ids").flatten()
                whole = words >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[whole]), ids.filter(pa.array(whole)), pa.array(words[whole]),
                        pa.array(hashes[whole, 0]), pa.array(hashes[whole, 1]),
                    ],
                    schema=arrow,
                )

    return index.select("row_keys", "doc_ids", "text_hashes", "n_words").mapInArrow(listed, LISTED)


def phrase_hits(index: DataFrame, phrases: DataFrame, window: int, block: int) -> DataFrame | None:
    """Hits of all phrases (phrase, number), searched in blocks of ``block``.

    What is sent for a search is one block, 88 bytes a phrase; its hits are written before the next one is sent.
    """
    hits = None
    for k in range(-(-(phrases.agg(F.max("number")).first()[0] or 0) // block)):
        some = phrases.where(F.col("number").between(k * block + 1, (k + 1) * block)).toArrow()
        raw = some.column("phrase").to_pylist()
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 8
        words = np.zeros((len(raw), window), dtype=np.uint64)
        words[np.arange(window) < lengths[:, None]] = np.frombuffer(b"".join(raw), dtype=np.uint64)
        found = settle(search_index(index, words, lengths, some.column("number").to_numpy()), "hits")
        hits = found if hits is None else hits.unionByName(found)
    return hits


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 1 << 19, block: int = 1 << 17) -> DataFrame:
    """row_key, doc_id, n_words, two text hashes, spans (array of start, end in words), items (sorted ids, a null last) per document.

    Documents without a hit have empty arrays. Spans are merged over windows, segments and phrase blocks. A window that
    many items hold is searched once, and its items are told by equality afterwards.
    """
    index = settle(build_index(docs, window, shard_words), "fm-index")
    owned = settle(item_windows(items, window), "windows")
    phrases = settle(running(owned.select("phrase").distinct(), [], ["phrase"], ordinal="number"), "phrases")
    owners = settle(owned.join(phrases, "phrase").select("number", "item_id").distinct(), "owners")
    hits = phrase_hits(index, phrases, window, block)
    listed = documents_of(index)
    if hits is None:
        return listed.select("*", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr("cast(array() as array<bigint>)").alias("items"))
    parts = F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))))
    merged = _merged(hits.groupBy("row_key").agg(parts.alias("parts")))
    found = hits.select("row_key", F.explode("phrases").alias("number")).distinct().join(owners, "number")
    # a null item is one like others, and the last one
    item = F.struct(F.col("item_id").isNull().alias("none"), "item_id")
    of = found.groupBy("row_key").agg(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["item_id"]).alias("items"))
    return listed.join(merged, "row_key", "left").join(of, "row_key", "left").select(
        "row_key", "doc_id", "n_words", "_h1", "_h2",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"),
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(rows: DataFrame) -> DataFrame:
    """(row_key, spans) from (row_key, parts): spans that overlap or touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1):
                start, end = (parts.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(start, kind="stable")
                start, far = start[order], np.maximum.accumulate(end[order])
                at = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
                last = np.r_[at[1:], len(start)] - 1
                out.append([{"start": a, "end": b} for a, b in zip(start[at].tolist(), far[last].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["row_key", "spans"])

    return rows.mapInArrow(run, "row_key bigint, spans array<struct<start:bigint,end:bigint>>")


def decontaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no window of any item; all columns.

    What a document holds depends on its text alone, so hits go back to rows by 128 bits of hashes of the text; the
    doc_id, which may be null or repeated, decides nothing.
    """
    found = contaminated_spans(docs, items, **settings)
    hit = settle(found.where(F.size("spans") > 0).select("_h1", "_h2").distinct(), "contaminated")
    named = docs.select(packed_row(docs), *[h.alias(name) for name, h in text_hashes().items()])
    seen = maybe(named, "_h1", hit.select(F.col("_h1").alias("hash")))
    left = seen.where("_maybe").join(hit, ["_h1", "_h2"], "left_anti").select("row")
    return seen.where("not _maybe").select("row").unionByName(left).select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH docw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
itemw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM itemw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
