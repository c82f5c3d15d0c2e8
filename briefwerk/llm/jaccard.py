"""N-gram Jaccard join: MinHash candidates, pruned by Bayes' rule as their values are compared, verified exactly.

1. One scan hashes every text's distinct word shingles to ``bands`` x ``rows`` MinHash values and a digest. Texts with the same set are one class from here on.
2. Classes that agree in a band are compared value by value. After every 16 values a pair is dropped if the
   posterior probability that its similarity reaches the threshold is below ``tolerance``. Of the pairs that
   survive only a spanning forest leaves the task; its components are clusters.
3. Within each cluster all classes meet once, tile by tile: the same pruning, then an exact comparison of the
   shingle sets. Tasks return link counts and a spanning forest, never the pairs of a large group.

With 24 bands of 4 values a pair at exactly 0.8 shares no band with probability 3e-6, and less above.

Defined results: a text of fewer words than a shingle, but not none, is one shingle; null, empty and wordless
texts link with nothing and stay; every row counts as a document, also with a null or repeated doc_id; ids are
compared as numbers, the smallest names the class and a class without any id is null; of each class one row is kept,
the first with the smallest id, or the first of all without any id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import RowKeys, forest, hashed_words, maybe, mix, packed_row, pieces, runs, shingles, table, text_hashes, texts, whole_groups
from .components import components, pairs, tiled

SIZE, THRESHOLD, BANDS, ROWS, TOLERANCE = 5, 0.8, 24, 4, 1e-8
STEP = 16  # MinHash values compared between two prunings

SIGNED = "row_key bigint, doc_id bigint, _h1 bigint, _h2 bigint, n bigint, c1 bigint, c2 bigint, signature binary, bands array<bigint>"
SIGNED_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("row_key", "doc_id", "_h1", "_h2", "n", "c1", "c2")],
    ("signature", pa.binary()), ("bands", pa.list_(pa.int64())),
])
FOUND = "a bigint, b bigint, links bigint"
FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _minhash(sets: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """MinHash values (texts x count, 32 bits) of the shingle sets between ``bounds``, none of them empty."""
    rng = np.random.default_rng(9157)
    factors = rng.integers(1, 2**32, count, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, count, dtype=np.uint32)
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, count), dtype=np.uint32)
    for k in range(count):
        x = low * factors[k] + shifts[k]
        x ^= (x >> np.uint32(15)) ^ (high * factors[k - 1])
        x *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(x, bounds[:-1])
    return out


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, cuts, digests) of a batch of texts: sorted, distinct; 2 x texts digests, 0 for empty sets."""
    hashes, first, _, _ = hashed_words(*texts(part))
    found, text = shingles(hashes, first, size)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    fresh = np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])][: len(found)]
    found, text = found[fresh], text[fresh]
    cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int64)
    has = np.flatnonzero(np.diff(cuts))
    digests = np.zeros((2, part.num_rows), dtype=np.uint64)
    if len(has):
        digests[0, has] = mix(np.add.reduceat(mix(found + np.uint64(1)), cuts[has]))
        digests[1, has] = mix(np.bitwise_xor.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), cuts[has]))
    return found, cuts, digests.view(np.int64)


def sign(docs: DataFrame, size: int = SIZE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: hashes of its text, size and digest of its shingle set, MinHash signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = RowKeys()
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                found, cuts, digests = _sets(part, size)
                counts = np.diff(cuts)
                has = np.flatnonzero(counts)
                signature = [b""] * part.num_rows
                band_keys: list = [[]] * part.num_rows
                if len(has):
                    values = _minhash(found, np.r_[cuts[has], len(found)], bands * rows)
                    joined = np.zeros((len(has), bands), dtype=np.uint64)
                    for k in range(bands * rows):
                        b = k // rows
                        joined[:, b] = mix(joined[:, b] * np.uint64(0x9E3779B97F4A7C15) + values[:, k] + np.uint64(b + 1))
                    joined = joined.view(np.int64)
                    short = (values & np.uint32(0xFFFF)).astype(np.uint16)
                    for k, at in enumerate(has):
                        signature[at] = short[k].tobytes()
                        band_keys[at] = joined[k]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.take(part.num_rows)), *[part.column(part.schema.get_field_index(c)) for c in ("doc_id", "_h1", "_h2")],
                    pa.array(counts), pa.array(digests[0]), pa.array(digests[1]),
                    pa.array(signature, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())),
                ], schema=SIGNED_ARROW)

    return docs.select("doc_id", *[h.alias(name) for name, h in text_hashes().items()], "text").mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(c1, c2, shingles): the digest and the sorted shingle hashes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=1 << 21):
                found, cuts, digests = _sets(part, size)
                packed = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests[0]), pa.array(digests[1]), pa.array(packed, pa.binary())], names=["c1", "c2", "shingles"]
                )

    return docs.select("text").mapInArrow(run, "c1 bigint, c2 bigint, shingles binary")


def least_matches(values: int, threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 STEP, … values: the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior, whose mass above the
    threshold is the binomial P(X <= m) of n + 1 trials.
    """
    out = []
    for n in range(STEP, values + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(signature: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose values, compared STEP at a time, leave the threshold possible."""
    matches = np.zeros(len(i), dtype=np.int16)
    for k, fewest in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (signature[i, part] == signature[j, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= fewest
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


def _signatures(rows: pa.Table) -> np.ndarray:
    column = rows.column("signature").combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def candidate_links(candidates: DataFrame, values: int, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a forest that connects what survives the pruning within each bucket."""
    least = least_matches(values, threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["bucket", "_first", "_second"]):
            bucket, first, second, own, rep = _columns(rows, "bucket", "_first", "_second", "_own", "rep")
            signature = _signatures(rows)
            a, b = [], []
            for i, j in pairs(runs(bucket, first, second), own, first, second):
                i, j = surviving(signature, i, j, least)
                if len(i):
                    x, y = forest(rep[i], rep[j])
                    a.append(x)
                    b.append(y)
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return candidates.mapInArrow(run, "a bigint, b bigint")


def exact_links(clustered: DataFrame, values: int, threshold: float, tolerance: float) -> DataFrame:
    """Link counts (a, null, links) and forest links (a, b, 0) of the pairs that reach the threshold exactly."""
    least = least_matches(values, threshold, tolerance)
    ratio = Fraction(threshold).limit_denominator(10_000)

    def verified(i, j, sets, n):
        """Of the pairs, sorted by i, those whose shingle sets are similar enough."""
        keep = np.zeros(len(i), dtype=bool)
        cuts = runs(i)
        used = np.unique(np.concatenate([i, j]))
        number = np.zeros(used[-1] + 1, dtype=np.int64)
        number[used] = np.arange(len(used))
        lengths = n[used]
        starts = np.cumsum(lengths) - lengths
        _, flat = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
        mark = np.zeros(flat.max() + 1, dtype=bool)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            me, others = number[i[lo]], number[j[lo:hi]]
            mine = flat[starts[me] : starts[me] + lengths[me]]
            mark[mine] = True
            step = max(1, (1 << 22) // int(lengths[others].max()))
            for k in range(0, len(others), step):
                some = others[k : k + step]
                ends = np.cumsum(lengths[some])
                at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - lengths[some]), lengths[some])
                shared = np.add.reduceat(mark[flat[at]], ends - lengths[some], dtype=np.int64)
                union = lengths[some] + lengths[me] - shared
                keep[lo + k : lo + k + len(some)] = shared * ratio.denominator >= union * ratio.numerator
            mark[mine] = False
        return i[keep], j[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cluster", "_first", "_second"]):
            names = ("cluster", "_first", "_second", "_own", "rep", "n", "copies")
            cluster, first, second, own, rep, n, copies = _columns(rows, *names)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
            signature = _signatures(rows)
            links, a, b = np.zeros(len(rep), dtype=np.int64), [], []
            for i, j in pairs(runs(cluster, first, second), own, first, second):
                possible = np.minimum(n[i], n[j]) * ratio.denominator >= np.maximum(n[i], n[j]) * ratio.numerator
                i, j = surviving(signature, i[possible], j[possible], least)
                if not len(i):
                    continue
                order = np.argsort(i, kind="stable")
                i, j = verified(i[order], j[order], sets, n)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                x, y = forest(rep[i], rep[j])
                a.append(x)
                b.append(y)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], schema=FOUND_ARROW
            )
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), pa.array(y), pa.array(np.zeros(len(x), dtype=np.int64))], schema=FOUND_ARROW
                )

    return clustered.mapInArrow(run, FOUND)


def near_duplicates(
    docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    tolerance: float = TOLERANCE, bucket_rows: int = 2048, tile_rows: int = 1024, tile_shingles: int = 1 << 21,
) -> DataFrame:
    """(doc_id, text) → doc_id, class_id, n_links, kept, one row per document.

    ``class_id`` is the smallest doc_id that links reach, ``n_links`` counts the other documents with a
    similarity of ``threshold`` or more, and ``kept`` marks one document of each class.
    """
    return marked(docs, size, threshold, bands, rows, tolerance, bucket_rows, tile_rows, tile_shingles).select(
        "doc_id", "class_id", "n_links", "kept"
    )


def marked(
    docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    tolerance: float = TOLERANCE, bucket_rows: int = 2048, tile_rows: int = 1024, tile_shingles: int = 1 << 21,
) -> DataFrame:
    """The rows of ``near_duplicates`` with two hashes of their text and ``n``, the size of its shingle set."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = settle(sign(docs, size, bands, rows), "signed")
    keyed = signed.where("n > 0").select("row_key", "doc_id", "_h1", "_h2", "n", "c1", "c2")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = settle(
        keyed.groupBy("c1", "c2").agg(
            F.min(F.struct("row_key", "doc_id")).alias("_rep"), F.min(first).alias("least"), F.count(F.lit(1)).alias("copies")
        ).select("c1", "c2", F.col("_rep.row_key").alias("rep"), F.col("_rep.doc_id").alias("rep_id"), "least", "copies"),
        "classes",
    )
    reps = settle(
        signed.select(F.col("row_key").alias("rep"), "n", "signature", "bands").join(classes.select("rep", "copies"), "rep"),
        "representatives",
    )

    # buckets of two and more; of those with the same members one is enough
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = (
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("rep").alias("low"))
        .where("rows > 1")
        .groupBy("rows", "who", "low")
        .agg(F.min("bucket").alias("bucket"))
    )
    buckets = settle(buckets.select("bucket", F.ceil(F.col("rows") / bucket_rows).alias("_tiles")), "buckets")
    inside = members.join(buckets, "bucket").select("bucket", "rep")
    candidates = tiled(inside.join(reps.select("rep", "signature"), "rep"), buckets, "bucket", "rep")
    linked = settle(candidate_links(candidates, bands * rows, threshold, tolerance), "candidates")
    clusters = settle(components(linked).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")

    # the shingle sets of the clustered classes, from a second look at their texts
    wanted = settle(clusters.join(classes, "rep").select("cluster", "rep", "rep_id", "c1", "c2", "copies"), "wanted")
    near_texts = maybe(docs, "xxhash64(doc_id)", wanted.select(F.xxhash64("rep_id").alias("hash"))).where("_maybe")
    sets = (
        shingle_sets(near_texts, size).join(wanted.select("c1", "c2", "rep", "cluster", "copies"), ["c1", "c2"])
        .groupBy("rep").agg(*[F.first(c).alias(c) for c in ("cluster", "copies", "shingles")])
        .join(reps.select("rep", "n", "signature"), "rep")
    )
    sets = settle(sets, "sets")
    tiles = sets.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / tile_rows, F.sum("n") / tile_shingles)).alias("_tiles")
    )
    found = settle(exact_links(tiled(sets, tiles, "cluster", "rep"), bands * rows, threshold, tolerance), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")

    named = (
        classes.join(links, "rep", "left")
        .join(joined, "rep", "left")
        .select("*", F.coalesce("component", "rep").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("least").alias("least")).select(
        "root", F.col("least.doc_id").alias("class_id"), F.col("least.row_key").alias("stays")
    )
    per_class = settle(
        named.join(lowest, "root").select(
            F.col("c1"), F.col("c2"), "class_id", "stays",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        ),
        "per-class",
    )
    grouped = keyed.join(per_class, ["c1", "c2"]).select(
        "doc_id", "_h1", "_h2", "n", "class_id", "n_links", (F.col("row_key") == F.col("stays")).alias("kept")
    )
    alone = signed.where("n = 0").select(
        "doc_id", "_h1", "_h2", "n", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept")
    )
    return grouped.unionByName(alone)


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id, and all without words; all columns.

    Rows are told apart by doc_id and 128 bits of hashes of the text. Of rows that agree in both one stays, any of them.
    """
    found = marked(docs, **settings).where("n > 0")
    same = found.groupBy("doc_id", "_h1", "_h2").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    # rows alone with their id and text that are kept need no second look
    key = "xxhash64(doc_id, _h1, _h2)"
    known = settle(same.where("not kept or copies > 1").select(F.expr(key).alias("hash"), "doc_id", "_h1", "_h2", "kept"), "dropped")
    named = docs.select(packed_row(docs), F.col("doc_id").cast("bigint").alias("doc_id"), *[h.alias(name) for name, h in text_hashes().items()])
    seen = maybe(named, key, known.select("hash"))
    to = known.select(F.col("doc_id").alias("_id"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), F.col("kept").alias("_stays"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b"))
    left = seen.where("_maybe").join(to.where("not _stays"), here, "left_anti")
    # copies are brought down to one per task before they meet
    several = left.join(to.where("_stays"), here, "left_semi").groupBy("doc_id", "_h1", "_h2").agg(F.first("row").alias("row"))
    once = left.join(to.where("_stays"), here, "left_anti")
    return (
        seen.where("not _maybe").select("row").unionByName(once.select("row")).unionByName(several.select("row")).select("row.*")
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes o ON o.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, o.n HAVING count(*) * 10 >= 8 * (m.n + o.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, doc_id = class_id AS kept
FROM classes LEFT JOIN counts USING (doc_id)
"""
