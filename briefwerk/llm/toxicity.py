"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are the different n-grams (``ORDERS`` characters; case folded, everything but letters and digits
a blank), hashed to 2^20 places. The log-count ratio of a feature says how much likelier texts with label 1 hold
it. A logistic regression learns one weight per feature on top of these ratios; where it learns nothing, the ratio
itself remains (the interpolation of naive Bayes and a linear classifier).

Ratios and weights come from a bounded sample: at most about ``sample`` rows a label, picked by hash. The constant
term is set right for the shares that the labels really have. The model has a place per feature: 5 MB.

Defined results: null and empty texts have no features and get the constant term's score; repeated rows are scored
one by one; with one label only, or none, all texts get the share of label 1, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, pieces, table
from .quality import label_counts, sampled

ORDERS, PLACES_BITS, SAMPLE, CUT = (3, 4, 5, 6), 20, 6000, 0.7
PLACES = 1 << PLACES_BITS
_U = np.uint64
_STATE: dict[str, np.ndarray] = {}


def _character_table() -> np.ndarray:
    if "kept" not in _STATE:
        _STATE["kept"] = np.fromiter((chr(k).isalnum() for k in range(0x110000)), dtype=bool, count=0x110000)
    return _STATE["kept"]


def grams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, text number) of all n-grams, order by order, repeated ones too. A text begins and ends with a blank."""
    folded = [f" {t.lower()} " if t else "" for t in texts]
    lengths = np.fromiter((len(t) for t in folded), dtype=np.int64, count=len(folded))
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return
    codes = np.where(_character_table()[codes], codes, np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(folded), dtype=np.int32), lengths)
    h = codes.copy()
    for n in range(2, max(orders) + 1):
        # h[i] becomes the hash of the n characters from i on
        h = h[:-1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if len(h) == 0:
            return
        if n in orders:
            whole = owner[: len(h)] == owner[n - 1 :]
            x = h ^ (h >> _U(29))
            yield ((x * _U(0xBF58476D1CE4E5B9)) >> _U(64 - PLACES_BITS))[whole].astype(np.int64), owner[: len(h)][whole]


def presence(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of the different features of each text, sorted; ``wanted`` marks the places that matter."""
    found = []
    for place, owner in grams(texts):
        if wanted is not None:
            keep = wanted[place]
            place, owner = place[keep], owner[keep]
        found.append((owner.astype(np.int64) << PLACES_BITS) | place)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> PLACES_BITS, keys & (PLACES - 1)


class Model:
    def __init__(self, weights: np.ndarray, constant: float) -> None:
        self.weights, self.constant = weights.astype(np.float32), constant
        self.wanted = np.abs(self.weights) > 1e-3

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, place = presence(texts, self.wanted)
        margin = np.bincount(text, weights=self.weights[place], minlength=len(texts)) + self.constant
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def ratios(counts: np.ndarray, texts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log-count ratios; the smoothing pulls rare features to nought, in the shares of the labels."""
    share = texts / texts.sum()
    rate = (counts + smoothing * share[:, None]) / (texts[:, None] + smoothing * share[:, None] * 1.0)
    unseen = np.log((smoothing * share) / (texts + smoothing * share))
    return np.log(rate[1]) - np.log(rate[0]) - (unseen[1] - unseen[0])


def regression(rows: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights per place and the constant, by gradient steps with moments; weights begin at and shrink to a tenth.

    Only places that some text has are worked on.
    """
    used, places = np.unique(places, return_inverse=True)
    size = len(used)
    w, c = np.full(size, 0.1), 0.0
    m, v, mc, vc = np.zeros(size), np.zeros(size), 0.0, 0.0
    x = values[used][places]
    n = len(y)
    for t in range(1, rounds + 1):
        margin = np.bincount(rows, weights=x * w[places], minlength=n) + c
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        grad = np.bincount(places, weights=x * error[rows], minlength=size) / n + ridge * (w - 0.1)
        gc = error.mean()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc * gc
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        c -= 0.05 * (mc / (1 - 0.9**t)) / (np.sqrt(vc / (1 - 0.999**t)) + 1e-6)
    out = np.zeros(PLACES)
    out[used] = w * values[used]
    return out, c


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, smoothing: float = 8.0, least_ratio: float = 1.8, ridge: float = 1e-4, rounds: int = 200) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic), but for ids whose crc32 mod 3 is 1."""
    known = label_counts(labels, "toxic", 3, 1)
    if set(known) != {0, 1}:
        share = known.get(1, 0) / max(sum(known.values()), 1)
        return Model(np.zeros(PLACES), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rates = {y: min(1.0, sample / n) for y, n in known.items()}
    picked = sampled(docs, labels, "toxic", 3, 1, rates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((2, PLACES), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                y = part.column(part.schema.get_field_index("y")).to_numpy()
                text, place = presence(part.column(part.schema.get_field_index("text")).to_pylist())
                for label in (0, 1):
                    counts[label] += np.bincount(place[y[text] == label], minlength=PLACES)
                    texts[label] += np.count_nonzero(y == label)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at, -1]), pa.array(np.r_[counts[0, at], texts[0]]), pa.array(np.r_[counts[1, at], texts[1]])],
            names=["place", "n0", "n1"],
        )

    # a row per place at most comes back
    summed = (
        picked.mapInArrow(count, "place bigint, n0 bigint, n1 bigint")
        .groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    )
    place, n0, n1 = (summed.column(k).to_numpy() for k in range(3))
    counts, texts = np.zeros((2, PLACES)), np.ones(2)
    for row in range(2):
        n = (n0, n1)[row]
        counts[row, place[place >= 0]] = n[place >= 0]
        texts[row] = max(1, n[place < 0].sum())
    values = ratios(counts, texts, smoothing)
    # ratios near nought stay out of the regression and of scoring
    values[np.abs(values) < least_ratio] = 0.0
    wanted = values != 0
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                text, place = presence(part.column(part.schema.get_field_index("text")).to_pylist(), sent.value)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                places = [place[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("y")), pa.array(places, pa.binary())], names=["y", "places"])

    rows = picked.mapInArrow(features, "y int, places binary").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    lists = [np.frombuffer(x, dtype=np.int32) for x in rows.column("places").to_pylist()]
    order = sorted(range(len(lists)), key=lambda k: (y[k], lists[k].tobytes()))  # the same sums whatever the order of tasks
    lists, y = [lists[k] for k in order], y[order]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    if len(set(y)) < 2:
        return Model(np.zeros(PLACES), float(np.log(known[1] / known[0])))
    weights, constant = regression(row, flat, values, y, ridge, rounds)
    # the labels were sampled at different rates
    constant += np.log(rates[0] / rates[1])
    return Model(weights, float(constant))


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = CUT) -> DataFrame:
    """``keep`` columns, score and predicted (0 or 1) of every text."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                score = sent.value.score(part.column(part.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in keep], pa.array(score)], names=[*keep, "score"]
                )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"])
    return docs.select(*keep, "text").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
