"""What the operators of this subpackage share: Arrow batches as byte buffers, hashed words, row keys."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the word of the contracts is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[0x80:] = True

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_LOWER_BYTES = _LOWER.tobytes()
_WORD_BYTES = IS_WORD[_LOWER].tobytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed_row(df: DataFrame) -> Column:
    """All columns as one struct, ``row``, so that no name of theirs meets one of ours; ``row.*`` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_hashes() -> dict[str, Column]:
    """128 bits that stand for a text, as ``_h1`` and ``_h2``: what depends on the text alone goes back to rows by them."""
    return {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")}


def remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(of)


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Whether a document is held out of learning; a null id is not."""
    return F.coalesce(remainder(doc_id, of) == F.lit(rest), F.lit(False))


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column without a copy per row; null counts as empty."""
    array = batch.column(batch.schema.get_field_index(column))
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_binary())
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if n else 0
    return data[base : int(offsets[-1]) if n else 0], offsets - base


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` text bytes, whatever the number of rows; a longer text stands alone."""
    _, offsets = texts(batch, column)
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what one stage needed must not weigh on the next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(18, int(n).bit_length())
        _POWERS[:] = [_powers(size, _PRIME), _powers(size, pow(_PRIME, -1, 2**64))]
    return _POWERS


def _after_word(data: np.ndarray, first: int, last: int) -> int:
    """The last place up to ``last`` that follows no word byte, or else the next one after it."""
    if last == len(data):
        return last
    gap = np.flatnonzero(~IS_WORD[_LOWER[data[max(first, last - 65536) : last]]])
    if len(gap):
        return max(first, last - 65536) + int(gap[-1]) + 1
    while last < len(data):
        gap = np.flatnonzero(~IS_WORD[_LOWER[data[last : last + 65536]]])
        if len(gap):
            return last + int(gap[0]) + 1
        last += 65536
    return len(data)


def hashed_words(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 17):
    """64-bit hashes of all words of a buffer of texts: (hashes, first word of each text, word starts, word ends).

    The third and fourth are byte positions in ``data``; the second has one entry more than there are texts.
    Works through the buffer in steps that end outside words, so that the temporary arrays stay small.
    """
    n_texts = len(offsets) - 1
    hashes, starts, ends = [], [], []
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    first = 0
    while first < len(data):
        last = _after_word(data, first, min(len(data), first + step))
        raw = data[first:last].tobytes()
        part = np.frombuffer(raw.translate(_LOWER_BYTES), dtype=np.uint8)
        word = np.frombuffer(raw.translate(_WORD_BYTES), dtype=bool)
        begins = word.copy()
        begins[1:] &= ~word[:-1] | breaks[first + 1 : last]
        begin = np.flatnonzero(begins)
        if len(begin):
            over = word.copy()
            over[:-1] &= ~word[1:] | breaks[first + 1 : last]
            end = np.flatnonzero(over) + 1
            up, down = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(np.multiply(up[: len(part)], part, dtype=np.uint64), out=sums[1:], dtype=np.uint64)
            h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
            hashes.append(mix(h))
            starts.append(begin + first)
            ends.append(end + first)
        first = last
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    first_word = np.searchsorted(start, offsets[: n_texts + 1], side="left")
    return join(hashes, np.uint64), first_word, start, join(ends, np.int64)


def shingles(hashes: np.ndarray, first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text of each) for all runs of ``size`` words; fewer words, but not none, are one shingle."""
    counts = np.diff(first_word)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - size + 1
    if n > 0:
        whole = text[:n] == text[size - 1 :]
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h = h * U64(0xD6E8FEB86659FD93) + hashes[k : k + n]
        long_h, long_t = mix(h[whole]), text[:n][whole]
    else:
        long_h, long_t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return long_h, long_t
    h = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        at = np.minimum(first_word[short] + k, len(hashes) - 1)
        h = np.where(has, h * U64(0xD6E8FEB86659FD93) + hashes[at], h)
    h = mix(h + counts[short].astype(np.uint64))
    order = np.argsort(np.concatenate([long_t, short]), kind="stable")
    return np.concatenate([long_h, h])[order], np.concatenate([long_t, short])[order]


def maybe(df: DataFrame, key: str, hashes: DataFrame, slots: int = 1 << 23) -> DataFrame:
    """``df`` with ``_maybe``: whether the 64-bit hash ``key`` (an SQL expression) may be among ``hashes`` (hash).

    Rows without it surely are not, so an exact join need only see the others. What is broadcast is a bitmap of
    ``slots`` bits, a row per 64 bits: 2 MB at most. With many more hashes than bits it lets all rows through,
    which costs time but changes no result.
    """
    slot = f"pmod({key}, {slots})"
    bits = hashes.groupBy(F.expr(f"pmod(hash, {slots}) div 64").alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(hash, {slots}), 64) as int))")).alias("_bits")
    )
    held = F.coalesce(F.col("_bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({slot}, 64) as int))")) != 0, F.lit(False))
    joined = df.withColumn("_word", F.expr(f"{slot} div 64")).join(F.broadcast(bits), "_word", "left")
    return joined.withColumn("_maybe", held).drop("_word", "_bits")


class RowKeys:
    """Numbers for the rows of a task that no other task gives; write the rows before the numbers are used twice."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self._next = (context.partitionId() if context else 0) << 36

    def take(self, n: int) -> np.ndarray:
        self._next += n
        return np.arange(self._next - n, self._next, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that the rows of a key stay together: what is held back is one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, dtype=bool)
        same_as_held = bool(held)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            if held:
                before = held[-1].column(held[-1].schema.get_field_index(key))
                same_as_held &= before[len(before) - 1].as_py() == values[0]
        cut = np.flatnonzero(changes)
        if len(cut):
            last = int(cut[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif same_as_held or not held:
            held.append(batch)
        else:
            yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, with the number of rows at the end."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(change), n]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) that keep what the links (a, b) connect, one per node at most."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        fresh = label.copy()
        np.minimum.at(fresh, label[x], low)
        np.minimum.at(fresh, label[y], low)
        while True:
            jumped = fresh[fresh]
            if (jumped == fresh).all():
                break
            fresh = jumped
        if (fresh == label).all():
            break
        label = fresh
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
