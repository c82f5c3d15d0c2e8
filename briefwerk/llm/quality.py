"""Quality by compression: zstandard dictionaries of good and of bad text, and how much better one of them fits.

Texts are cut into pieces of ``piece_bytes`` (as valid UTF-8, whole texts, nothing left out). Each piece is compressed
on its own with a dictionary trained on pieces of good texts and with one trained on pieces of bad texts. The
normalised difference (bad - good) / (bad + good), over the sums of a text, becomes a score by a logistic curve
that is fitted on other labelled texts than the dictionaries. A second value, how far the pieces compress each
other, tells texts that repeat themselves: the share of a text's bytes that is left by plain compression.

What is fitted comes from a bounded sample of the labelled rows: at most about ``sample`` pieces a label for the
dictionaries and twice ``sample_texts`` texts for the curve. Which rows is decided by hashes.

Defined results: null and empty texts get the score of the curve at a difference of nought; repeated rows are
scored one by one; a table with only one label, or none, gives a score of the share of good labels, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, packed_row, pieces, table, texts

PIECE, SAMPLE, SAMPLE_TEXTS, DICT_BYTES, CUT = 2048, 6000, 3000, 3 << 16, 0.7


def cut(data: memoryview, size: int) -> list[memoryview]:
    """Pieces of about ``size`` bytes."""
    return [data[k : k + size] for k in range(0, len(data), size)]


class Model:
    """The two dictionaries and the curve; a few hundred KB, whatever the corpus."""

    def __init__(self, good: bytes, bad: bytes, piece: int, level: int = 3) -> None:
        self.good, self.bad, self.piece, self.level = good, bad, piece, level
        self.weights = np.array([0.0, 0.0, 0.0])
        self.constant: float | None = None
        self._tools: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(difference, plain ratio) of every text."""
        if self._tools is None:
            make = lambda d: zstandard.ZstdCompressor(
                level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self._tools = (make(self.good), make(self.bad), zstandard.ZstdCompressor(level=1))
        good, bad, plain = self._tools
        view = memoryview(data)
        out = np.zeros((len(offsets) - 1, 2))
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if a == b:
                out[k, 1] = 1.0
                continue
            g = w = 0
            for part in cut(view[a:b], self.piece):
                g += len(good.compress(part))
                w += len(bad.compress(part))
            out[k, 0] = (w - g) / (w + g)
            out[k, 1] = min(1.0, len(plain.compress(view[a:b])) / float(b - a))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(design(features) @ self.weights, -30, 30)))


def design(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features[:, 0] * 10, features[:, 1]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, label: str, of: int, rest: int, rates: dict[int, float]) -> DataFrame:
    """(text, y, h): about the given share of the rows of each label, held-out ids left out.

    h is a hash of the id, evenly in 0 … 1. Ids are picked among the labels first; the sample's bound is what
    makes sending them to all executors safe, and the texts stay where they are.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    wanted = " or ".join(f"(y = {y} and h < {rate})" for y, rate in rates.items()) or "false"
    known = known_labels(labels, label, of, rest).withColumn("h", h).where(wanted)
    found = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(known), "doc_id")
    # an id that is given to many rows counts as one: before anything moves, each task keeps one text of it
    return found.groupBy("doc_id", "y", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y", "h")


def known_labels(labels: DataFrame, label: str, of: int, rest: int) -> DataFrame:
    """(doc_id, y) that may be learned from; if an id is labelled twice, the greater label counts."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), of, rest))
    return usable.groupBy("doc_id").agg(F.max(label).alias("y"))


def label_counts(labels: DataFrame, label: str, of: int, rest: int) -> dict[int, int]:
    return {r.y: r.n for r in known_labels(labels, label, of, rest).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(docs: DataFrame, labels: DataFrame, piece: int = PIECE, sample: int = SAMPLE, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Learn from (doc_id, text) and (doc_id, quality), but for ids whose crc32 mod 4 is 2."""
    counts = label_counts(labels, "quality", 4, 2)
    # rows of both labels at the same rate, so that the curve sees the shares there are
    rates = dict.fromkeys(counts, min(1.0, 4 * sample_texts / max(sum(counts.values()), 1)))
    picked = sampled(docs, labels, "quality", 4, 2, rates)

    # what the sample's texts are cut into, and their features, are made where the texts are
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch)
            y = batch.column(batch.schema.get_field_index("y")).to_numpy()
            h = batch.column(batch.schema.get_field_index("h")).to_numpy()
            parts, of, at = [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                for n, part in enumerate(cut(memoryview(data)[a:b], piece)):
                    parts.append(bytes(part))
                    of.append(y[k])
                    at.append((h[k] * 7919 + n * 0.618034) % 1.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.binary()), pa.array(np.array(of, dtype=np.int32)), pa.array(np.array(at, dtype=float))],
                names=["part", "y", "at"],
            )

    # even hashes make the dictionaries, odd ones the curve
    even = F.pmod(F.floor(F.col("h") * float(1 << 30)), F.lit(2)) == 0
    parts = picked.where(even).mapInArrow(split, "part binary, y int, at double").where(F.col("at") < 1.0)
    totals = {r.y: r.n for r in parts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(totals) != {0, 1}:
        model = Model(b"", b"", piece)
        model.constant = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return model
    chosen = parts.where(" or ".join(f"(y = {y} and at < {min(1.0, sample / n)})" for y, n in totals.items())).collect()
    train = lambda y: _dictionary(sorted(bytes(r.part) for r in chosen if r.y == y))
    model = Model(train(1), train(0), piece)
    curve = _features(picked.where(~even), model, ("y",)).collect()
    x, y = np.array([[r.difference, r.ratio] for r in curve]).reshape(-1, 2), np.array([r.y for r in curve], dtype=float)
    if len(set(y)) < 2:
        model.constant = counts.get(1, 0) / sum(counts.values())
        return model
    model.weights = logistic(design(x), y)
    return model


def _dictionary(parts: list[bytes]) -> bytes:
    """A dictionary trained on the pieces; the pieces themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICT_BYTES:].ljust(8, b" ")


def _features(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                f = sent.value.features(*texts(part))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in keep], pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(sent.value.score(f))],
                    names=[*keep, "difference", "ratio", "score"],
                )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "difference double, ratio double, score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = CUT) -> DataFrame:
    """``keep`` columns, difference, ratio, score and predicted (0 or 1) of every text."""
    return _features(docs, model, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = CUT) -> DataFrame:
    """The documents whose score reaches the threshold; all columns."""
    packed = docs.select(packed_row(docs), "text")
    return quality(packed, model, ("row",), threshold).where("predicted = 1").select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
