"""Byte-level BPE: pre-tokens by scans over transition functions, merges remembered per pre-token, and back to bytes.

**Cutting.** Every code point has a class (letter, number, blank, other white space, apostrophe, anything else). What a
pattern would look ahead for is put into the symbol of a place: whether white space is the last of its run, how many
letters of a contraction follow an apostrophe. What is left depends on the state to the left alone, so a symbol is a
function from states to states. All functions that products of symbols can be form a small closed set with a
multiplication table; a prefix scan over their numbers (within blocks, all blocks at once, then over the blocks) gives
the state at every place of a slice in vector operations, and with it the places where pre-tokens begin. No regular
expression is run over texts.

**Merging.** A pre-token that is an entry is that entry; others are merged pair by pair, the lowest rank first, the
leftmost among equals. Results are remembered per worker, for a bounded number of pre-tokens of bounded length.

**Back.** Entries have their bytes one after the other, with offsets; ids are decoded by gathering from there.

Slices of a text follow one another with the state and the pre-token that is still open, so memory is bound by the
slice (and by the longest pre-token), not by the document. Defined results: null and empty texts have no tokens, so
their digests are those of nothing; special tokens' strings are ordinary text; rows are encoded one by one, whatever
their ids; an empty table gives an empty one; columns not asked for are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
SLICE, REMEMBERED, LONGEST = 1 << 20, 400_000, 64

# ------------------------------------------------------------------ classes and symbols

OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE = range(6)
# fixed values: what follows the apostrophe of a contraction
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# fixed values: white space of Unicode
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    out[:] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)]
    out[list(WHITE)] = SPACE
    out[0x20] = BLANK
    out[0x27] = QUOTE
    return out


# states: within a run of letters, numbers, other characters, white space; after the one blank that opens a pre-token;
# one or two letters of a contraction to come; nothing open
_L, _N, _O, _W, _B, _C1, _C2, _END = range(8)
# symbols: letter, number, other, apostrophe before one or two letters of a contraction, blank and other white space
# that end their run before something else, white space within or at the end of the text; 8 more for a text's first
LET, NUM, OTH, QUOTE1, QUOTE2, LASTB, LASTS, WITHIN = range(8)
_SYMBOL = np.array([OTH, LET, NUM, WITHIN, WITHIN, OTH], dtype=np.uint8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(state after a symbol, whether a pre-token begins there)."""
    if symbol >= 8:
        state, symbol = _END, symbol - 8
    if state in (_C1, _C2):
        # the letters of a contraction were looked at before; nothing else can come
        if symbol == LET:
            return (_END if state == _C1 else _C1), False
        state = _END
    if symbol in (LET, NUM, OTH):
        run = {LET: _L, NUM: _N, OTH: _O}[symbol]
        return run, state not in (run, _B)
    if symbol in (QUOTE1, QUOTE2):
        # only an apostrophe that opens a pre-token can open a contraction
        return (_O, False) if state in (_O, _B) else ({QUOTE1: _C1, QUOTE2: _C2}[symbol], True)
    if symbol == WITHIN:
        return _W, state != _W
    return (_B if symbol == LASTB else _END), True


def _closed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, product of functions, state after a function, whether a symbol begins a pre-token)."""
    functions = [tuple(range(8))]
    of_symbol = []
    for symbol in range(16):
        f = tuple(_step(s, symbol)[0] for s in range(8))
        if f not in functions:
            functions.append(f)
        of_symbol.append(functions.index(f))
    known, at = {f: k for k, f in enumerate(functions)}, 0
    while at < len(functions):
        for symbol in range(16):
            then = functions[of_symbol[symbol]]
            product = tuple(then[s] for s in functions[at])
            if product not in known:
                known[product] = len(functions)
                functions.append(product)
        at += 1
    size = len(functions)
    assert size <= 256
    product = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint8)
    begins = np.array([[_step(s, symbol)[1] for symbol in range(16)] for s in range(8)])
    return np.array(of_symbol, np.uint8), product.ravel(), np.array(functions, np.uint8).ravel(), begins.ravel()


_OF_SYMBOL, _PRODUCT, _AFTER, _BEGINS = _closed()
_SIZE = len(_AFTER) // 8
_CLASS: list[np.ndarray] = []


def states(symbols: np.ndarray, state: int, block: int = 512) -> np.ndarray:
    """The state after each symbol, from ``state`` before the first one."""
    functions = _OF_SYMBOL[symbols]
    n = len(functions)
    if n <= block:
        out = np.empty(n, dtype=np.uint8)
        for k in range(n):
            state = out[k] = _AFTER[int(functions[k]) * 8 + int(state)]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, dtype=np.uint8)
    padded[:n] = functions
    by_place = np.ascontiguousarray(padded.reshape(rows, block).T)
    for k in range(1, block):
        by_place[k] = _PRODUCT[by_place[k - 1].astype(np.int32) * _SIZE + by_place[k]]
    # the blocks' own functions, from block to block
    entry = np.empty(rows, dtype=np.uint8)
    for k, f in enumerate(by_place[-1].tolist()):
        entry[k] = state
        state = int(_AFTER[f * 8 + state])
    after = _AFTER[by_place.astype(np.int32) * 8 + entry]
    return np.ascontiguousarray(after.T).ravel()[:n]


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` marks those that begin a text."""
    if not _CLASS:
        _CLASS.append(_classes())
    kind = _CLASS[0][points]
    out = _SYMBOL[kind]
    n = len(points)
    goes_on = np.zeros(n, dtype=bool)
    goes_on[:-1] = ~first[1:]
    white = (kind == BLANK) | (kind == SPACE)
    last = white & goes_on
    last[:-1] &= ~white[1:]
    out[last] = np.where(kind[last] == BLANK, LASTB, LASTS)
    for at in np.flatnonzero((kind == QUOTE) & goes_on).tolist():
        follows = "".join(chr(c) for c in points[at + 1 : at + 3 if at + 2 < n and goes_on[at + 1] else at + 2].tolist())
        if follows[:1] in CONTRACTIONS:
            out[at] = QUOTE1
        elif follows in CONTRACTIONS:
            out[at] = QUOTE2
    return out + first.astype(np.uint8) * 8


def pretokens(data: np.ndarray, offsets: np.ndarray, step: int = SLICE) -> Iterator[np.ndarray]:
    """Byte places where the pre-tokens of a buffer of texts begin, slice by slice."""
    firsts = np.zeros(len(data) + 1, dtype=bool)
    firsts[offsets] = True
    inner = (data & 0xC0) == 0x80
    at, state = 0, _END
    while at < len(data):
        stop, ahead = min(len(data), at + step), min(len(data), at + step + 12)
        while stop < len(data) and inner[stop]:
            stop -= 1
        while ahead < len(data) and inner[ahead]:
            ahead -= 1
        place = np.flatnonzero(~inner[at:ahead]) + at
        points = np.frombuffer(data[at:ahead].tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        n = int(np.searchsorted(place, stop))
        symbols = _symbols(points, firsts[place])[:n]
        after = states(symbols, state)
        before = np.empty(n, dtype=np.int32)
        before[0], before[1:] = state, after[:-1]
        yield place[:n][_BEGINS[before * 16 + symbols]]
        at, state = stop, int(after[-1])


# ------------------------------------------------------------------ merging


def gather(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the rows one after the other, where each row ends)."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(offsets[rows] - (ends - lengths), lengths)], ends


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(where each row begins and the last one ends, the bytes of all rows)."""
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.frombuffer(b"".join(rows), np.uint8)


class Vocabulary:
    """The entries of a rank file: what bytes they are, and how bytes are merged into them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(entry): int(rank) for entry, rank in pairs}
        entries = [b""] * (max(self.ranks.values()) + 1)
        for entry, rank in self.ranks.items():
            entries[rank] = entry
        self.bytes_of = ragged(entries)
        self.decimals_of = ragged([b",%d" % k for k in range(len(entries))])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= 48:
            return self._merge_short(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k) for k in range(n - 1) if (rank := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            rank, k = heapq.heappop(heap)
            if gone[k] or end[k] == n or ranks.get(piece[k : end[end[k]]]) != rank:
                continue
            right = end[k]
            gone[right] = 1
            end[k] = end[right]
            if end[k] < n:
                left[end[k]] = k
                if (then := ranks.get(piece[k : end[end[k]]])) is not None:
                    heapq.heappush(heap, (then, k))
            if k and (then := ranks.get(piece[left[k] : end[k]])) is not None:
                heapq.heappush(heap, (then, left[k]))
        return [ranks[piece[k : end[k]]] for k in range(n) if not gone[k]]

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same without a heap, for pieces so short that looking at all pairs costs less."""
        get = self.ranks.get
        none = 1 << 62
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) != none:
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
        return [self.ranks[part] for part in parts]

    def _add(self, ids: list[int]) -> int:
        start = int(self.ends[self.n])
        if start + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (start + len(ids)))
        if self.n + 2 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        self.ids[start : start + len(ids)] = ids
        self.n += 1
        self.ends[self.n] = start + len(ids)
        return self.n - 1

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pre-tokens one after the other, where each pre-token's end)."""
        if self.n > REMEMBERED:
            self._forget()
        numbers = list(map(self.known.get, rows))
        if None in numbers:
            for k, number in enumerate(numbers):
                if number is None:
                    piece = rows[k]
                    number = self.known.get(piece)
                    if number is None:
                        number = self._add(self.merge(piece))
                        if len(piece) <= LONGEST:
                            self.known[piece] = number
                    numbers[k] = number
        return gather(self.ends, self.ids, np.array(numbers, dtype=np.int64))


_LOADED: dict[str, Vocabulary] = {}


def load(ranks: str) -> Vocabulary:
    """The vocabulary of a rank file, once per process; a bare name is one of the public tokenizers' files."""
    if ranks not in _LOADED:
        path = ranks
        if not os.path.dirname(ranks):
            import public_tokenizers

            path = public_tokenizers.path(ranks)
        _LOADED[ranks] = Vocabulary(path)
    return _LOADED[ranks]


def encode_texts(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, step: int = SLICE):
    """Per slice: (number of its first text, ids, where the ids of each of its texts end).

    The last text of a slice may go on in the next one; texts without bytes between others have no ids.
    """

    def done(starts: np.ndarray, end: int):
        cuts = np.append(starts, end) - starts[0]
        raw = data[starts[0] : end].tobytes()
        bounds = cuts.tolist()
        ids, ends = vocabulary.encode([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        text = np.searchsorted(offsets, starts, side="right") - 1
        first, last = int(text[0]), int(text[-1])
        upto = np.searchsorted(text, np.arange(first, last + 1), side="right")
        return first, ids, ends[upto - 1]

    open_ = np.zeros(0, dtype=np.int64)
    for starts in pretokens(data, offsets, step):
        starts = np.concatenate([open_, starts])
        # the last pre-token may go on
        if len(starts) > 1:
            yield done(starts[:-1], int(starts[-1]))
        open_ = starts[-1:]
    if len(open_):
        yield done(open_, len(data))


# ------------------------------------------------------------------ tables


def encoded(docs: DataFrame, ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and, per text, ``ids`` with the byte offset each of them ends at (``ends``)."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks)
        lengths = np.diff(vocabulary.bytes_of[0])
        for batch in batches:
            for part in pieces(batch):
                data, offsets = texts(part)
                counts, all_ids = np.zeros(part.num_rows, dtype=np.int64), [np.zeros(0, np.int32)]
                for first, ids, ends in encode_texts(vocabulary, data, offsets):
                    counts[first : first + len(ends)] += np.diff(ends, prepend=0)
                    all_ids.append(ids)
                ids = np.concatenate(all_ids)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                ends = np.cumsum(lengths[ids]) - np.repeat(offsets[:-1], counts)
                lists = [pa.LargeListArray.from_arrays(cuts, pa.array(c)).cast(pa.list_(c_type)) for c, c_type in ((ids, pa.int32()), (ends, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in keep], *lists], names=[*keep, "ids", "ends"]
                )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "ids array<int>, ends array<bigint>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``bytes`` that the column ``ids`` stands for."""
    kinds = dict(tokens.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, values = load(ranks).bytes_of
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            made = [gather(offsets, values, (row.values.to_numpy() if row.is_valid else np.zeros(0)).astype(np.int64))[0].tobytes() for row in column]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(made, pa.binary())], names=[*keep, "bytes"]
            )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "bytes binary"])
    return tokens.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, digest of the ids and digest of the bytes that they decode to, of every text."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(ranks)
        for batch in batches:
            for part in pieces(batch):
                n, counts = part.num_rows, np.zeros(part.num_rows, dtype=np.int64)
                of_ids, of_bytes = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
                for first, ids, ends in encode_texts(vocabulary, *texts(part)):
                    written, written_ends = gather(*vocabulary.decimals_of, ids.astype(np.int64))
                    back, back_ends = gather(*vocabulary.bytes_of, ids.astype(np.int64))
                    written, back = written.tobytes(), back.tobytes()
                    begin, a, b = 0, 0, 0
                    for k, end in enumerate(ends.tolist(), first):
                        if end > begin:
                            upto_a, upto_b = int(written_ends[end - 1]), int(back_ends[end - 1])
                            # every id has a comma before it, but for the first one of a text
                            of_ids[k].update(written[a + (not counts[k]) : upto_a])
                            of_bytes[k].update(back[b:upto_b])
                            counts[k] += end - begin
                            begin, a, b = end, upto_a, upto_b
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(part.schema.get_field_index(c)) for c in keep],
                        pa.array(counts),
                        pa.array([h.hexdigest() for h in of_ids], pa.string()),
                        pa.array([h.hexdigest() for h in of_bytes], pa.string()),
                    ],
                    names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
