"""Token counts as the tokenizer's library gives them, huge documents by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded as it is, but pieces between blanks that surely begin a pre-token
are encoded once per worker and remembered (a bounded number of pieces of bounded length). A longer one is encoded in chunks that overlap, with
offsets, and spliced where that is proven to be right: the library first cuts a text into pre-tokens from left to
right, without looking back. If both chunks have a pre-token beginning at the same place, and the left chunk is
right up to there, everything from there on is the same in the right chunk and in the whole text. Places too near
the left chunk's end, where what follows could change a pre-token or complete a special token, don't count.

Without a common place the overlap is doubled; when it would outgrow the left chunk, the left chunk is encoded
anew with more text. So a single run of letters of any length ends up in one chunk, as the library has it.

Memory is bound by the chunk (and such runs), not by the document. Defined results: null and empty texts have no
bytes and no tokens; special tokens' strings within texts are what the library makes of them by default, nothing is
added, cut or padded; rows are counted one by one; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, texts

NAME, CHUNK, OVERLAP, LIMIT, LONGEST = "byte_bpe_50k.json", 16384, 256, 512, 64
_LOADED: dict[str, object] = {}


def load(tokenizer: str):
    """The tokenizer of a file, once per process; a bare name is one of the public tokenizers' files."""
    if tokenizer not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
        from tokenizers import Tokenizer

        path = tokenizer
        if not os.path.dirname(tokenizer):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _LOADED[tokenizer] = made
    return _LOADED[tokenizer]


class _Chunk:
    """The encoding of text[start:end]."""

    def __init__(self, tokenizer, text: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        self.encoded = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.size = len(self.encoded)

    def opens(self, first: int, last: int) -> dict[int, int]:
        """Places from ``first`` to ``last`` where a pre-token begins, with the number of its first token."""
        e, out = self.encoded, {}
        token = next((t for p in range(first, last + 1) if (t := e.char_to_token(p - self.start)) is not None), self.size)
        for k in range(token, self.size):
            place = e.token_to_chars(k)[0] + self.start
            if place > last:
                break
            word = e.token_to_word(k)
            fresh = k == 0 or (word is not None and (before := e.token_to_word(k - 1)) is not None and before != word)
            if fresh and place >= first:
                out.setdefault(place, k)
        return out

    def common(self, right: _Chunk, margin: int) -> tuple[int, int] | None:
        """(tokens of this chunk before the first proven common place, tokens of the right one before it)."""
        mine = self.opens(right.start, self.end - margin)
        theirs = right.opens(right.start, self.end - margin)
        met = min(mine.keys() & theirs.keys(), default=None)
        return None if met is None else (mine[met], theirs[met])


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """How many tokens a long text has."""
    margin = 8 + max([0, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    left, total, skip = _Chunk(tokenizer, text, 0, min(chunk, len(text))), 0, 0
    while left.end < len(text):
        wide = max(overlap, 2 * margin)
        while True:
            if wide >= left.end - left.start:
                # no common place in the whole chunk: encode it anew with more text
                grown = _Chunk(tokenizer, text, left.start, min(len(text), left.end + max(chunk, left.end - left.start)))
                left, wide = grown, max(overlap, 2 * margin)
                if left.end == len(text):
                    break
            start = left.end - wide
            right = _Chunk(tokenizer, text, start, min(len(text), start + max(chunk, 2 * wide)))
            met = left.common(right, margin)
            if met and met[0] >= skip:
                total += met[0] - skip
                left, skip = right, met[1]
                break
            wide *= 2
    return total + left.size - skip


def _cuts_at_blanks(tokenizer) -> bool:
    """Whether a blank after something else than white space always begins a pre-token.

    The byte-level pattern has no match that goes on from another character into a blank, and looks at nothing to
    its left. Normalisers, other patterns and special tokens with white space could change that.
    """
    made = json.loads(tokenizer.to_str())
    pattern = made.get("pre_tokenizer") or {}
    plain = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in made["added_tokens"]
    )
    return made.get("normalizer") is None and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and plain \
        and not pattern.get("add_prefix_space", True)


class _Short:
    """Counts of texts of up to a chunk. Pieces between proven cuts are encoded once and remembered."""

    def __init__(self, tokenizer, most: int = 600_000) -> None:
        self.tokenizer, self.most, self.known = tokenizer, most, {}
        self.cuts = _cuts_at_blanks(tokenizer)

    def _encode(self, rows: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def count(self, rows: list[str]) -> list[int]:
        if not self.cuts:
            return self._encode(rows)
        split = [_pieces(t) for t in rows]
        if len(self.known) > self.most:
            self.known.clear()
        fresh = list(set().union(*split).difference(self.known))
        for first in range(0, len(fresh), 1 << 14):
            some = fresh[first : first + (1 << 14)]
            self.known.update(zip(some, self._encode(some), strict=True))
        known = self.known.__getitem__
        out = [sum(map(known, p)) for p in split]
        for piece in fresh:
            if len(piece) > LONGEST:
                del self.known[piece]
        return out


def _pieces(text: str) -> list[str]:
    """The text cut before each blank that follows something else than white space."""
    if _DOUBTFUL.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


_DOUBTFUL = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_SHORT: dict[str, _Short] = {}


def counts(rows: list[str | None], tokenizer: str = NAME, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Token counts of texts."""
    made = load(tokenizer)
    if tokenizer not in _SHORT:
        _SHORT[tokenizer] = _Short(made)
    out = np.zeros(len(rows), dtype=np.int64)
    short = [k for k, t in enumerate(rows) if t and len(t) <= chunk]
    for first in range(0, len(short), 256):
        some = short[first : first + 256]
        out[some] = _SHORT[tokenizer].count([rows[k] for k in some])
    for k, t in enumerate(rows):
        if t and len(t) > chunk:
            out[k] = spliced_count(made, t, chunk, overlap)
    return out


def token_counts(
    docs: DataFrame, tokenizer: str = NAME, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every text."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                _, offsets = texts(part)
                n = counts(part.column(part.schema.get_field_index("text")).to_pylist(), tokenizer, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in keep], pa.array(np.diff(offsets)), pa.array(n)],
                    names=[*keep, "n_bytes", "n_tokens"],
                )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_bytes bigint, n_tokens bigint"])
    return docs.select(*keep, "text").mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
