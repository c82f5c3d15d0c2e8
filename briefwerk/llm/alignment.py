"""Alignment of two tokenizers over a corpus: groups, links and how usual each link is.

Both tokenizers cut their text before a blank that follows something else than white space: the byte-level pattern has no
match that goes on from there, and no entry of the pieces' vocabulary holds a blank after another character (``load``
checks both). So space+text falls into units that are tokenized on their own, and a unit's end is an end of both
tokenizers' tokens. A unit's groups and links are worked out once per worker and remembered (a bounded number of them).

**Fragments.** A range of bytes of a text is an open prefix, closed groups and an open suffix: what is before its first
cut and after its last one may belong to units that neighbours hold the rest of. Without any cut it is open as a whole.
Putting two fragments together closes what lies between them, and is associative, so the ranges of a very long document
are read by different tasks and put together by a tree of tasks. Only open ends and sums go up the tree; groups, as
digits, and links stay as numbered parts in a written table, and a document's digest is fed part by part.

**Usual links.** Short documents are worked on in slices; a slice knows its different id pairs and how many of its
documents hold each, so what is counted corpus-wide is a row per slice and pair. What comes back to a slice are the
counts of its own pairs. Nothing is broadcast, and no task sees the whole table of pairs.

Links of a group are the overlaps of byte ranges: as many as there are different token ends of either side.

Defined results: null and empty texts, and texts whose tokens do not join to space+text, have no tokens: zeros and ''.
Rows are documents of their own, whatever their ids, so a repeated row counts twice; ids may be null; special tokens'
strings are ordinary text; a text of any length without cuts is one unit; an empty table gives an empty one; columns not
asked for are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .bytebpe import gather, ragged
from .common import RowKeys, pieces, table, whole_groups

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
RANGE, SLICE, FAN, REMEMBERED, LONGEST, BITS = 1 << 16, 1 << 23, 8, 400_000, 64, 20

_CUT = re.compile(r"(?<=\S)(?= )")
_DOUBTFUL = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """The text cut before each blank that follows something else than white space."""
    if not text:
        return []
    if _DOUBTFUL.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


# ------------------------------------------------------------------ two tokenizers


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: itself if it is printable, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and what is known of units so far."""

    def __init__(self, tokenizer: str, pieces_model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(tokenizer))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = _byte_level()
        added = self.a.get_added_tokens_decoder()
        entries = {k: bytes(byte_of[c] for c in entry) for entry, k in self.a.get_vocab(with_added_tokens=True).items() if k not in added}
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(pieces_model))
        self.size = max(max(entries) + 1, self.b.vocab_size())
        self.bytes_a = ragged([entries.get(k, b"") for k in range(self.size)])
        self.bytes_b = ragged([self._piece_bytes(k) if k < self.b.vocab_size() else b"" for k in range(self.size)])
        # the last byte is that of the sign that follows
        self.decimals = ragged([b"%d," % k for k in range(self.size)])
        self.blank = self.b.piece_to_id("\u2581")
        self._check()
        self.forget()

    def _piece_bytes(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace("\u2581", " ").encode()

    def _check(self) -> None:
        """What units rely on; other tokenizers would need other cuts."""
        made = json.loads(self.a.to_str())
        pattern = made.get("pre_tokenizer") or {}
        plain = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") and not pattern.get("add_prefix_space")
        if made.get("normalizer") is not None or not plain:
            raise ValueError("the first tokenizer must be byte-level, with its pattern and without a normaliser")
        if any(re.search("[^\u2581]\u2581", self.b.id_to_piece(k)) for k in range(self.b.vocab_size())):
            raise ValueError("an entry of the second vocabulary holds a blank after another character")
        if self.b.id_to_piece(self.b.encode("  a b"))[:1] not in (["\u2581\u2581\u2581"], ["\u2581\u2581"]):
            raise ValueError("the second tokenizer must put a blank before its text, and keep blanks")
        if self.size >> BITS:
            raise ValueError(f"ids must be below {1 << BITS}")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []  # groups of each unit, as digits
        self.sums = np.zeros((1 << 14, 4), np.int64)  # tokens of either side, groups; whether the unit has no tokens
        self.ends, self.codes = np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.int64)

    def _tokens(self, ids: list[list[int]], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, their unit, their bytes one after the other, where each id's end)."""
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64)
        unit = np.repeat(np.arange(len(ids)), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        raw, ends = gather(*table, flat)
        return flat, unit, raw, ends

    def _learn(self, fresh: list[str]) -> None:
        """All units at once: token ends of both sides over the units' bytes, one after the other."""
        left = [e.ids for e in self.a.encode_batch_fast(fresh, add_special_tokens=False)]
        right = [ids or [self.blank] for ids in self.b.encode([u[1:] for u in fresh], num_threads=1)]
        starts, raw = ragged([u.encode() for u in fresh])
        lengths, bad = np.diff(starts), np.zeros(len(fresh), dtype=bool)
        sides = [(left, self.bytes_a), (right, self.bytes_b)]
        for ids, table in sides:
            flat, unit, _, _ = self._tokens(ids, table)
            sizes = np.diff(table[0])[flat]
            bad |= np.bincount(unit, weights=sizes, minlength=len(fresh)).astype(np.int64) != lengths
            bad[unit[sizes == 0]] = True
        for ids, table in sides:
            # the lengths are right, so a byte that differs lies in a unit that differs
            _, _, mine, _ = self._tokens([[] if no else x for x, no in zip(ids, bad)], table)
            good = np.repeat(~bad, lengths)
            differs = np.flatnonzero(good)[mine != raw[good]]
            bad[np.searchsorted(starts, differs, side="right") - 1] = True
        (a, unit_a, _, end_a), (b, unit_b, _, end_b) = [self._tokens([[] if no else x for x, no in zip(ids, bad)], t) for ids, t in sides]
        upto = np.cumsum(np.where(bad, 0, lengths))
        common, every = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        # between two token ends one token of either side overlaps one of the other
        codes = (a[np.searchsorted(end_a, every)] << BITS) | b[np.searchsorted(end_b, every)]
        n_links = np.diff(np.searchsorted(every, upto, side="right"), prepend=0)
        groups = np.searchsorted(common, upto, side="right")
        # tokens by group, those of the first side before those of the second one
        key = np.concatenate([np.searchsorted(common, end_a) * 2, np.searchsorted(common, end_b) * 2 + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        written, written_ends = gather(*self.decimals, np.concatenate([a, b])[order])
        last = np.flatnonzero(np.diff(key, append=-1))
        written[written_ends[last] - 1] = np.where(key[last] & 1, ord(";"), ord("|"))
        # where the groups of each unit end in the text
        group_ends = np.concatenate([[0], written_ends[last[key[last] % 2 == 1]]])
        text, cuts = written.tobytes(), group_ends[groups].tolist()
        first, n = len(self.texts), len(fresh)
        self._room(first + n, int(self.ends[first]) + len(codes))
        begin = 0
        for cut in cuts:
            self.texts.append(text[begin : max(begin, cut - 1)])
            begin = cut
        start = int(self.ends[first])
        self.codes[start : start + len(codes)] = codes
        self.ends[first + 1 : first + n + 1] = start + np.cumsum(n_links)
        counts = [np.bincount(u, minlength=n) for u in (unit_a, unit_b)]
        self.sums[first : first + n] = np.column_stack([*counts, np.diff(groups, prepend=0), bad])
        self.known.update(zip(fresh, range(first, first + n)))

    def _room(self, units_: int, codes: int) -> None:
        if units_ + 1 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * (units_ + 1))
            self.sums = np.resize(self.sums, (2 * (units_ + 1), 4))
        if codes > len(self.codes):
            self.codes = np.resize(self.codes, 2 * codes)

    def numbers(self, rows: list[str]) -> np.ndarray:
        """Numbers of units, for ``texts``, ``sums`` and ``pairs``; they hold until the next call of ``forget``."""
        fresh = list(set(rows).difference(self.known))
        for first in range(0, len(fresh), 1 << 13):
            self._learn(fresh[first : first + (1 << 13)])
        out = np.fromiter(map(self.known.__getitem__, rows), dtype=np.int64, count=len(rows))
        for unit in fresh:
            if len(unit) > LONGEST:
                del self.known[unit]
        return out

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all links of units, where each unit's end); a code is a << BITS | b."""
        return gather(self.ends, self.codes, numbers)

    def part(self, rows: list[str]) -> tuple[str, np.ndarray, np.ndarray, bool]:
        """Units one after the other: their groups as text, sums, links, and whether one of them has no tokens."""
        if len(self.texts) > REMEMBERED:
            self.forget()
        numbers = self.numbers(rows)
        sums = self.sums[numbers].sum(axis=0)
        if sums[3]:
            return "", np.zeros(4, np.int64), np.zeros(0, np.int64), True
        return b";".join([self.texts[k] for k in numbers.tolist()]).decode(), sums, self.pairs(numbers)[0], False


def _path(name: str) -> str:
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[tuple[str, str], Pair] = {}


def load(tokenizer: str, pieces_model: str) -> Pair:
    """Both tokenizers, once per process; bare names are the public tokenizers' files."""
    key = tokenizer, pieces_model
    if key not in _LOADED:
        _LOADED[key] = Pair(*key)
    return _LOADED[key]


# ------------------------------------------------------------------ fragments of long documents


class Fragment(NamedTuple):
    """What is open of a range of bytes: all of it (``suffix`` None), or what is before its first and after its last cut."""

    start: int
    prefix: str
    suffix: str | None


Closed = list[tuple[int, list[str]]]  # (byte they begin at, units)


def fragment(text: str, start: int) -> tuple[Fragment, Closed]:
    """A range of a text as a fragment, and the units it closes."""
    found = units(text)
    if len(found) < 2:
        return Fragment(start, text, None), []
    closed = [(start + len(found[0].encode()), found[1:-1])] if len(found) > 2 else []
    return Fragment(start, found[0], found[-1]), closed


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Closed]:
    """Two neighbouring fragments as one, and the units that this closes."""
    left = x.prefix if x.suffix is None else x.suffix
    joined = left + y.prefix
    cut = len(units(joined)) == 2
    left_at = y.start - len(left.encode())
    if x.suffix is None and y.suffix is None:
        return (Fragment(x.start, left, y.prefix) if cut else Fragment(x.start, joined, None)), []
    if x.suffix is None:
        return (Fragment(x.start, left, y.suffix), [(y.start, [y.prefix])]) if cut else (Fragment(x.start, joined, y.suffix), [])
    if y.suffix is None:
        return (Fragment(x.start, x.prefix, y.prefix), [(left_at, [left])]) if cut else (Fragment(x.start, x.prefix, joined), [])
    return Fragment(x.start, x.prefix, y.suffix), [(left_at, [left, y.prefix] if cut else [joined])]


def finish(x: Fragment, end: int) -> Closed:
    """What is still open of a whole text."""
    if x.suffix is None:
        return [(x.start, [x.prefix])]
    return [(x.start, [x.prefix]), (end - len(x.suffix.encode()), [x.suffix])]


_ROW = pa.schema(
    [("row_key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ranges", pa.int64()), ("end", pa.int64())]
    + [("start", pa.int64()), ("prefix", pa.string()), ("suffix", pa.string()), ("is_part", pa.bool_()), ("text", pa.string())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("bad", pa.bool_()), ("codes", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
)
_ROWS = (
    "row_key bigint, doc_id bigint, at bigint, ranges bigint, end bigint, start bigint, prefix string, suffix string, "
    "is_part boolean, text string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, bad boolean, codes array<bigint>, "
    "links array<bigint>"
)


def _ranges(docs: DataFrame, size: int) -> DataFrame:
    """Space+text of documents in ranges of about ``size`` bytes: row_key, doc_id, at, ranges, end, start, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = RowKeys()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = b" " + text.as_buffer().to_pybytes()
                cuts = [0]
                while cuts[-1] < len(raw):
                    cut = min(cuts[-1] + size, len(raw))
                    while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                        cut += 1
                    cuts.append(cut)
                key, n = int(keys.take(1)[0]), len(cuts) - 1
                step = max(1, (1 << 23) // size)
                for first in range(0, n, step):
                    some = range(first, min(first + step, n))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row_key": pa.array([key] * len(some), pa.int64()),
                            "doc_id": pa.array([doc_id] * len(some), pa.int64()),
                            "at": pa.array(list(some), pa.int64()),
                            "ranges": pa.array([n] * len(some), pa.int64()),
                            "end": pa.array([len(raw)] * len(some), pa.int64()),
                            "start": pa.array(cuts[some.start : some.stop], pa.int64()),
                            "text": [raw[cuts[k] : cuts[k + 1]].decode() for k in some],
                        }
                    )

    schema = "row_key bigint, doc_id bigint, at bigint, ranges bigint, end bigint, start bigint, text string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _emit(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ROW)], schema=_ROW)


def _parts(pair: Pair, key: tuple, closed: Closed) -> Iterator[tuple]:
    """Rows for closed units."""
    for start, some in closed:
        text, sums, codes, bad = pair.part(some)
        codes, links = np.unique(codes, return_counts=True)
        counted = (*sums[:3].tolist(), int(links.sum()))
        yield (*key, start, None, None, True, text, *counted, bad, codes.tolist(), links.tolist())


def _open(key: tuple, x: Fragment) -> tuple:
    return (*key, x.start, x.prefix, x.suffix, False, None, 0, 0, 0, 0, False, None, None)


def _first_round(ranges: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(*tokenizers)
        for batch in batches:
            for r in batch.to_pylist():
                key = r["row_key"], r["doc_id"], r["at"], r["ranges"], r["end"]
                x, closed = fragment(r["text"], r["start"])
                made = list(_parts(pair, key, closed))
                if r["ranges"] == 1:
                    made += _parts(pair, key, finish(x, r["end"]))
                else:
                    made.append(_open(key, x))
                yield _emit(made)

    return settle(ranges.repartition("row_key", "at").mapInArrow(run, _ROWS), "fragments")


def _next_round(before: DataFrame, tokenizers: tuple[str, str], fan: int) -> DataFrame:
    """Each ``fan`` neighbouring fragments become one; a document's last one is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(*tokenizers)
        for part in whole_groups(batches, ["row_key", "to"]):
            held, made = None, []
            for r in part.to_pylist():
                # rows of a document are sorted; what is already put together belongs to the same node or goes out
                here = (r["row_key"], r["doc_id"], r["to"], -(-r["ranges"] // fan), r["end"])
                y = Fragment(r["start"], r["prefix"], r["suffix"])
                if held and held[0] != here:
                    made += _upward(pair, *held)
                    held = None
                if held:
                    x, closed = compose(held[1], y)
                    made += _parts(pair, here, closed)
                    held = here, x
                else:
                    held = here, y
            yield _emit(made + _upward(pair, *held))

    rows = before.where("not is_part").withColumn("to", F.expr(f"cast(floor(at / {fan}) as bigint)"))
    dealt = rows.select("row_key", "doc_id", "to", "at", "ranges", "end", "start", "prefix", "suffix").repartition("row_key", "to")
    return settle(dealt.sortWithinPartitions("row_key", "to", "at").mapInArrow(run, _ROWS), "fragments")


def _upward(pair: Pair, key: tuple, x: Fragment) -> list[tuple]:
    return list(_parts(pair, key, finish(x, key[4]))) if key[3] == 1 else [_open(key, x)]


def _long(docs: DataFrame, tokenizers: tuple[str, str], size: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(row_key, doc_id, sums, digest of long documents; row_key, code, links)."""
    rounds = [_first_round(_ranges(docs, size), tokenizers)]
    most = rounds[0].agg(F.max("ranges")).first()[0] or 0
    while most > 1:
        rounds.append(_next_round(rounds[-1], tokenizers, fan))
        most = -(-most // fan)
    parts = rounds[0].where("is_part")
    for more in rounds[1:]:
        parts = parts.unionByName(more.where("is_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row() -> pa.RecordBatch:
            key, doc_id, sums, bad, digest, _ = held
            sums = [0, 0, 0, 0] if bad else sums
            values = [key, doc_id, *sums, "" if bad else digest.hexdigest(), bad]
            kinds = [pa.int64()] * 6 + [pa.string(), pa.bool_()]
            names = ["row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "bad"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0] != r["row_key"]:
                    yield row()
                    held = None
                held = held or [r["row_key"], r["doc_id"], [0, 0, 0, 0], False, hashlib.sha256(), ""]
                held[2] = [a + r[c] for a, c in zip(held[2], ("n_a", "n_b", "n_groups", "n_links"))]
                held[3] |= r["bad"]
                held[4].update((held[5] + r["text"]).encode())
                held[5] = ";"
        if held:
            yield row()

    schema = "row_key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, bad boolean"
    told = parts.select("row_key", "doc_id", "start", "text", "n_a", "n_b", "n_groups", "n_links", "bad")
    rows = settle(told.repartition("row_key").sortWithinPartitions("row_key", "start").mapInArrow(run, schema), "long")
    links = parts.select("row_key", F.inline(F.arrays_zip("codes", "links"))).groupBy("row_key", F.col("codes").alias("code"))
    good = rows.where("not bad").select("row_key")
    return rows, settle(links.agg(F.sum("links").alias("links")).join(good, "row_key", "left_semi"), "long-links")


# ------------------------------------------------------------------ slices of short documents

_SLICE = (
    "slice bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "digests array<string>, entries array<bigint>, places binary, links binary, codes array<bigint>, held array<bigint>"
)


def _packed(values: np.ndarray) -> bytes:
    """Small numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _slices(docs: DataFrame, tokenizers: tuple[str, str], size: int) -> DataFrame:
    """A row per slice of documents: their sums and digests, the slice's pairs, and which documents hold which."""

    def work(pair: Pair, rows: list[str | None]):
        if len(pair.texts) > REMEMBERED:
            pair.forget()
        cut = [units(" " + t) if t else [] for t in rows]
        numbers = pair.numbers([u for some in cut for u in some])
        bounds = np.concatenate([[0], np.cumsum([len(some) for some in cut])])
        sums, digests, kept = np.zeros((4, len(rows)), dtype=np.int64), [], []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            mine = numbers[a:b]
            whole = pair.sums[mine].sum(axis=0)
            if a == b or whole[3]:
                digests.append("")
                kept.append(mine[:0])
                continue
            digests.append(hashlib.sha256(b";".join([pair.texts[m] for m in mine.tolist()])).hexdigest())
            sums[:3, k] = whole[:3]
            kept.append(mine)
        codes, ends = pair.pairs(np.concatenate(kept) if kept else numbers)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(m) for m in kept])])]
        sums[3] = np.diff(ends)
        entry, links = np.unique(codes + (np.repeat(np.arange(len(rows)), sums[3]) << 2 * BITS), return_counts=True)
        doc, code = entry >> 2 * BITS, entry & ((1 << 2 * BITS) - 1)
        code, place, held = np.unique(code, return_inverse=True, return_counts=True)
        # the most common pairs come first, so that places of a document's pairs are close
        common = np.argsort(-held, kind="stable")
        rank = np.empty(len(common), dtype=np.int64)
        rank[common] = np.arange(len(common))
        place = rank[place]
        order = np.lexsort((place, doc))
        doc, place, links = doc[order], place[order], links[order]
        steps = np.diff(place, prepend=0)
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        steps[begins] = place[begins]
        entries = np.bincount(doc, minlength=len(rows))
        return sums, digests, entries, _packed(steps), _packed(links), code[common], held[common]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, keys = load(*tokenizers), RowKeys()
        for batch in batches:
            for part in pieces(batch, limit=size):
                sums, digests, entries, places, links, codes, held = work(pair, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.take(1)), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                        *[pa.array([s]) for s in sums], pa.array([digests], pa.list_(pa.string())), pa.array([entries.astype(np.int64)]),
                        pa.array([places]), pa.array([links]), pa.array([codes]), pa.array([held.astype(np.int64)]),
                    ],
                    names=[c.split()[0] for c in _SLICE.split(", ")],
                )

    return settle(docs.select("doc_id", "text").mapInArrow(run, _SLICE), "slices")


# ------------------------------------------------------------------ the whole

_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _with_counts(slices: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a slice, from what the corpus says about its pairs."""
    r = slices.select(["doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "entries", "places", "links"]).to_pylist()[0]
    n = np.zeros(counts.num_rows, dtype=np.int64)
    best = np.zeros(counts.num_rows, dtype=np.int64)
    at = counts["place"].to_numpy()
    n[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy()
    entries = np.array(r["entries"], dtype=np.int64)
    steps, links = _unpacked(r["places"]), _unpacked(r["links"])
    doc = np.repeat(np.arange(len(entries)), entries)
    sums = np.cumsum(steps)
    begin = np.cumsum(entries) - entries
    before = np.where(begin > 0, sums[np.maximum(begin, 1) - 1], 0) if len(sums) else np.zeros(len(entries), np.int64)
    place = sums - before[doc]
    n_best, count_sum = np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64)
    np.add.at(n_best, doc, links * best[place])
    np.add.at(count_sum, doc, links * n[place])
    kinds = [pa.int64()] * 7 + [pa.string()]
    columns = [r["doc_ids"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best, count_sum, r["digests"]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def alignments(
    docs: DataFrame, tokenizer: str = TOKENIZER, pieces_model: str = PIECES, size: int = RANGE, slice_size: int = SLICE, fan: int = FAN
) -> DataFrame:
    """A row per document: tokens of either side, groups, links, how many links are usual ones, and the groups' digest."""
    tokenizers = tokenizer, pieces_model
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    slices = _slices(docs.where(length <= size), tokenizers, slice_size)
    long, long_links = _long(docs.where(length > size), tokenizers, size, fan)
    mine = slices.select("slice", F.posexplode(F.arrays_zip("codes", "held")).alias("place", "pair")).select(
        "slice", F.col("place").cast("bigint").alias("place"), F.col("pair.codes").alias("code"), F.col("pair.held").alias("held")
    )
    counts = (
        mine.select("code", "held")
        .unionByName(long_links.select("code", F.lit(1).cast("bigint").alias("held")))
        .groupBy("code")
        .agg(F.sum("held").alias("n"))
    )
    # an id of the one side meets at most as many ids as the other vocabulary has
    same = Window.partitionBy(F.expr(f"shiftright(code, {BITS})"))
    told = settle(counts.select("code", "n", (F.col("n") == F.max("n").over(same)).cast("bigint").alias("best")), "pair-counts")
    known = mine.join(told, "code").select(F.col("slice").alias("of_slice"), "place", "n", "best")
    short = slices.drop("codes", "held").groupBy("slice").cogroup(known.groupBy("of_slice")).applyInArrow(_with_counts, _OUT)
    usual = (
        long_links.join(told, "code")
        .groupBy("row_key")
        .agg(F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    )
    rest = long.join(usual, "row_key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")], "groups_sha256",
    )
    return short.unionByName(rest)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
