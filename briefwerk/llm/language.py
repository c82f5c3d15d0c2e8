"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the normalised vector of its character n-grams (one to three letters or blanks, case folded), hashed to
4096 places, with dampened counts and inverse document frequencies. Each language has several centroids, found by
spherical k-means over a bounded sample of its texts. A text gets the language of the centroid with the greatest
cosine. Its score is how surely that language won: the softmax of the languages' best cosines.

Texts at a greater distance from their centroid than nearly all sampled texts of the language (the ``quantile``)
are marked as rejected. The general interface then says ``und``; the query keeps the nearest language beside the
mark, as its contract wants a language for every text with letters.

What is learned: at most about ``sample`` different rows a language and ``in_all`` in all (eight a language, if there are more than
a thousand), picked by hash of id and text; a row that is repeated counts once. Every language gets centroids. Defined results: null and empty texts, and
texts without letters, are ``und`` with score 0; without any labelled text everything is ``und``; repeated rows are
judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, pieces, table, text_hashes

BITS, ORDERS, SAMPLE, CENTROIDS, QUANTILE, SHARPNESS, IN_ALL = 12, 3, 600, 4, 0.002, 40.0, 8000
PLACES = 1 << BITS
UNKNOWN = "und"
_U = np.uint64
_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000)
    return _TABLES["letters"]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x places counts of hashed n-grams as float32, whether a text has letters)."""
    folded = [f" {t.lower()} " if t else "" for t in texts]
    lengths = np.fromiter((len(t) for t in folded), dtype=np.int64, count=len(folded))
    out = np.zeros((len(texts), PLACES), dtype=np.float32)
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    has = np.zeros(len(texts), dtype=bool)
    if not len(codes):
        return out, has
    letter = _letters()[codes]
    owner = np.repeat(np.arange(len(texts)), lengths)
    has[np.unique(owner[letter])] = True
    # every run of other characters is one blank
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    owner = owner[keep]
    places = []
    h = codes.copy()
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = h[:-1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :]
        whole = owner[: len(h)] == owner[n - 1 :]
        x = (h + _U(n)) ^ (h >> _U(31))
        places.append((((x * _U(0xD6E8FEB86659FD93)) >> _U(64 - BITS)).astype(np.int64) + owner[: len(h)] * PLACES)[whole])
    for p in places:
        # texts are in order, so each fills its own stretch of the matrix
        np.add.at(out.reshape(-1), p, 1) if len(p) < 4096 else _add(out, p)
    return out, has


def _add(out: np.ndarray, places: np.ndarray) -> None:
    out += np.bincount(places, minlength=out.size).reshape(out.shape).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


class Model:
    """Centroids of all languages: a few MB at most, by the bounds on languages, centroids and places."""

    def __init__(self, names: list[str], centroids: np.ndarray, of: np.ndarray, least: np.ndarray, idf: np.ndarray) -> None:
        self.names, self.centroids, self.of, self.least, self.idf = names, centroids, of, least, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cosine, rejected) of each text."""
        n = len(texts)
        if not self.names:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
        language, score, cosine, rejected = [], [], [], []
        for k in range(0, n, 256):
            counts, has = counted(texts[k : k + 256])
            near = vectors(counts, self.idf) @ self.centroids.T
            best = np.full((len(near), len(self.names)), -1.0)
            for m in range(len(self.names)):
                best[:, m] = near[:, self.of == m].max(axis=1)
            top = best.argmax(axis=1)
            cos = best[np.arange(len(best)), top]
            odds = np.exp(SHARPNESS * (best - cos[:, None]))
            language += [self.names[m] if ok else UNKNOWN for m, ok in zip(top, has, strict=True)]
            score.append(np.where(has, np.clip(1 / odds.sum(axis=1), 0, 1), 0.0))
            cosine.append(np.where(has, cos, 0.0))
            rejected.append(~has | (cos < self.least[top]))
        return language, np.concatenate(score), np.concatenate(cosine), np.concatenate(rejected)


def clustered(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from spread-out first centroids, always the same ones."""
    centres = [v.mean(axis=0)]
    far = v @ centres[0]
    for _ in range(min(k, len(v)) - 1):
        centres.append(v[int(far.argmin())])
        far = np.maximum(far, v @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        mine = (v @ c.T).argmax(axis=1)
        fresh = np.stack([v[mine == m].sum(axis=0) if (mine == m).any() else c[m] for m in range(len(c))])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, c):
            break
        c = fresh
    return c


def fit(
    docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, quantile: float = QUANTILE, in_all: int = IN_ALL
) -> Model:
    """Learn from text and lang of (doc_id, text, lang), but for ids whose crc32 mod 4 is 2."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2) & (F.length("text") > 0))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Model([], np.zeros((0, PLACES)), np.zeros(0, int), np.zeros(0), np.ones(PLACES))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    each = min(sample, max(8, in_all // len(sizes)))
    rate = F.create_map([x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, each / r.n)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                lang = part.column(part.schema.get_field_index("lang"))
                for k in range(0, len(texts), 256):
                    counts, has = counted(texts[k : k + 256])
                    damped = np.sqrt(counts).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [lang.slice(k, 256).filter(pa.array(has)), pa.array([v.tobytes() for v in damped[has]], pa.binary())],
                        names=["lang", "vector"],
                    )

    # equal rows are picked together, and learned from once
    same = ["lang", "doc_id", *text_hashes()]
    picked = usable.where(h < rate[F.col("lang")]).withColumns(text_hashes()).groupBy(*same).agg(F.first("text").alias("text"))
    rows = picked.select("text", "lang").mapInArrow(run, "lang string, vector binary").toArrow()
    names_of = np.array(rows.column("lang").to_pylist(), dtype=object)
    if not len(names_of):
        return Model([], np.zeros((0, PLACES)), np.zeros(0, int), np.zeros(0), np.ones(PLACES))
    raw = rows.column("vector").to_pylist()
    order = sorted(range(len(raw)), key=lambda k: (names_of[k], raw[k]))  # the same model whatever the order of tasks
    names_of = names_of[order]
    damped = np.frombuffer(b"".join(raw[k] for k in order), dtype=np.float16).reshape(len(raw), PLACES).astype(np.float32)
    idf = (np.log((1 + len(damped)) / (1 + np.count_nonzero(damped, axis=0))) + 1).astype(np.float32)
    v = damped * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    names, parts, of, least = sorted(set(names_of)), [], [], []
    for m, name in enumerate(names):
        own = v[names_of == name]
        c = clustered(own, centroids)
        parts.append(c)
        of += [m] * len(c)
        least.append(np.quantile((own @ c.T).max(axis=1), quantile))
    return Model(names, np.concatenate(parts), np.array(of), np.array(least), idf)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang (``und`` where rejected), nearest, score, cosine, rejected of every text."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 20):
                nearest, score, cosine, rejected = sent.value.predict(part.column(part.schema.get_field_index("text")).to_pylist())
                lang = [UNKNOWN if no else name for name, no in zip(nearest, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    *[part.column(part.schema.get_field_index(c)) for c in keep],
                    pa.array(lang), pa.array(nearest), pa.array(score), pa.array(cosine), pa.array(rejected),
                ], names=[*keep, "lang", "nearest", "score", "cosine", "rejected"])

    schema = [*[f"`{c}` {kinds[c]}" for c in keep], "lang string, nearest string, score double, cosine double, rejected boolean"]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(schema))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
