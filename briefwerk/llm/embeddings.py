"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with a cosine of t or more are at a squared distance of 2 (1 - t) or less. Vectors are rotated at
random (the same rotation for all of a dimension) and split into blocks of ``block_dims`` dimensions; every block
gets its proportional part of the squared distance. By the pigeonhole principle, a pair within the whole budget
is within the part of at least one block. So each block is range-joined on its own: vectors go to the grid cell
of their first ``cell_dims`` block coordinates, whose side is twice the block's radius, and visit the greater one
of any two neighbouring cells that they could have a partner in.

Within a cell, block distances select, and the rotated vectors in half precision (with a margin for that) drop
what is too far apart. Only a spanning forest of what is left goes on; within each of its components all vectors
meet once, tile by tile, in double precision. Tasks return link counts and forests, never the pairs of a group.

Equal vectors with equal labels are one class and are compared once. Defined results: a vector that is null,
empty, zero or holds null or non-finite components, or whose label is null, links with nothing; a null vec_id is no component's name
unless all ids are null, and is kept in that case only; an empty table gives an empty one; vectors of
different dimension or label are never compared; repeated rows are separate vectors; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import forest, mix, runs, table, whole_groups
from .components import components, tiled

COSINE, BLOCK_DIMS, CELL_DIMS = 0.98, 8, 3
HALF = 2e-3  # what half precision can move a distance of unit vectors by, with room


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dims + 7001).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_bounds(dims: int, block_dims: int) -> np.ndarray:
    return np.linspace(0, dims, max(1, dims // block_dims) + 1).astype(int)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(values: np.ndarray) -> np.ndarray:
    top = np.abs(values).max(axis=1, keepdims=True)
    values = values / top  # very large and very small components square safely
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def cells(classes: DataFrame, cosine: float, block_dims: int, cell_dims: int) -> DataFrame:
    """(cell, rep, home, block, dims, vector): the cells that each class lives in and visits, block by block."""
    budget = 2 * (1 - cosine) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            size = rows.column("dims").to_numpy()
            for dims in np.unique(size):
                some = rows.filter(pa.array(size == dims))
                rep, label = some.column("rep").to_numpy(), some.column("label").to_numpy().astype(np.int64)
                turned = _unit(_matrix(some.column("embedding"))) @ rotation(int(dims))
                half = turned.astype(np.float16)
                packed = [v.tobytes() for v in half]
                bounds = block_bounds(int(dims), block_dims)
                for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    side = 2 * np.sqrt(budget * (hi - lo) / dims) * (1 + 1e-6)
                    place = turned[:, lo : min(hi, lo + cell_dims)] / side
                    home = np.floor(place).astype(np.int64)
                    step = np.where(place - home < 0.5, -1, 1)
                    for choice in product((0, 1), repeat=place.shape[1]):
                        moves = step * np.array(choice)
                        # of two cells the lesser one's vectors visit the greater one
                        leading = np.zeros(len(rep), dtype=np.int64)
                        for k in range(place.shape[1]):
                            leading = np.where(leading == 0, moves[:, k], leading)
                        go = np.ones(len(rep), dtype=bool) if not any(choice) else leading > 0
                        key = mix(label[go].view(np.uint64) + np.uint64(1))
                        for part in (int(dims), b):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part))
                        for k in range(place.shape[1]):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (home[go, k] + moves[go, k]).view(np.uint64))
                        at = np.flatnonzero(go)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key.view(np.int64)), pa.array(rep[go]), pa.array(np.full(len(at), not any(choice))),
                            pa.array(np.full(len(at), b, dtype=np.int32)), pa.array([packed[k] for k in at], pa.binary()),
                        ], names=["cell", "rep", "home", "block", "vector"])

    return classes.select("rep", "label", "dims", "embedding").mapInArrow(
        run, "cell bigint, rep bigint, home boolean, block int, vector binary"
    )


def _near(left: np.ndarray, right: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where rows of the two are within the squared distance."""
    gram = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)
    return np.nonzero(gram <= most)


def cell_links(tiles: DataFrame, cosine: float, block_dims: int) -> DataFrame:
    """(a, b): a forest over the classes that are near in a block and, within half precision, as a whole."""
    radius = np.sqrt(2 * (1 - cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "_first", "_second"]):
            column = lambda n: rows.column(n).to_numpy()  # noqa: E731, B023
            cell, first, second, own, rep, home, block = map(column, ("cell", "_first", "_second", "_own", "rep", "home", "block"))
            vectors = rows.column("vector").combine_chunks().to_pylist()
            links_a, links_b = [], []
            # hashes of cells may meet: only rows of one block and dimension are compared
            kind = (block.astype(np.int64) << 32) | np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
            bounds = runs(cell, first, second)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                for one in np.unique(kind[lo:hi]):
                    at = lo + np.flatnonzero(kind[lo:hi] == one)
                    if len(at) < 2:
                        continue
                    full = np.frombuffer(b"".join([vectors[k] for k in at]), dtype=np.float16).reshape(len(at), -1).astype(np.float32)
                    dims = full.shape[1]
                    cut = block_bounds(dims, block_dims)[block[at[0]] : block[at[0]] + 2]
                    part = full[:, cut[0] : cut[1]]
                    near = (radius * np.sqrt((cut[1] - cut[0]) / dims) + HALF) ** 2
                    at_home = np.flatnonzero(home[at])
                    step = max(1, (1 << 20) // len(at))
                    for k in range(0, len(at_home), step):
                        i, j = _near(part[at_home[k : k + step]], part, near)
                        i = at_home[k : k + step][i]
                        # visitors meet those at home only; those at home meet each other once
                        keep = np.where(home[at[j]], i < j, True)
                        keep &= (first[lo] == second[lo]) | (own[at[i]] != own[at[j]])
                        i, j = i[keep], j[keep]
                        for m in range(0, len(i), 1 << 16):
                            x, y = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
                            gap = full[x] - full[y]
                            close = (gap * gap).sum(axis=1) <= (radius + HALF) ** 2
                            if close.any():
                                a, b = forest(rep[at[x[close]]], rep[at[y[close]]])
                                links_a.append(a)
                                links_b.append(b)
            if links_a:
                a, b = forest(np.concatenate(links_a), np.concatenate(links_b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiles.mapInArrow(run, "a bigint, b bigint")


def exact_links(tiles: DataFrame, cosine: float) -> DataFrame:
    """Link counts (a, null, links) and forest links (a, b, 0) of the pairs whose cosine reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cluster", "_first", "_second"]):
            column = lambda n: rows.column(n).to_numpy()  # noqa: E731, B023
            cluster, first, second, own, rep, copies, label = map(column, ("cluster", "_first", "_second", "_own", "rep", "copies", "label"))
            links, link_a, link_b = np.zeros(len(rep), dtype=np.int64), [], []
            bounds = runs(cluster, first, second)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                unit = _unit(_matrix(rows.column("embedding").slice(lo, hi - lo)))
                step = max(1, (1 << 20) // (hi - lo))
                for k in range(0, hi - lo, step):
                    i, j = np.nonzero(unit[k : k + step] @ unit.T >= cosine)
                    i += k
                    keep = (i < j) & ((first[lo] == second[lo]) | (own[lo + i] != own[lo + j])) & (label[lo + i] == label[lo + j])
                    i, j = i[keep] + lo, j[keep] + lo
                    if len(i):
                        np.add.at(links, i, copies[j])
                        np.add.at(links, j, copies[i])
                        a, b = forest(rep[i], rep[j])
                        link_a.append(a)
                        link_b.append(b)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], schema=schema)
            if link_a:
                a, b = forest(np.concatenate(link_a), np.concatenate(link_b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), dtype=np.int64))], schema=schema)

    return tiles.mapInArrow(run, "a bigint, b bigint, links bigint")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, cell_dims: int = CELL_DIMS,
    cell_rows: int = 4096, tile_rows: int = 1024,
) -> DataFrame:
    """(vec_id, embedding, label) → vec_id, n_links, component_id, kept, one row per vector."""
    usable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != F.lit(0.0))
    )
    read = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding",
        F.coalesce(usable, F.lit(False)).alias("usable"),
    )
    # a class of equal vectors is found by 128 bits of hashes, and goes by a number that is written with it
    good = read.where("usable").withColumns(
        {"_h1": F.xxhash64("label", "embedding"), "_h2": F.xxhash64(F.lit(1), "label", "embedding")}
    )
    classes = settle(
        good.groupBy("_h1", "_h2").agg(
            F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ).withColumns({"dims": F.size("embedding"), "rep": F.monotonically_increasing_id()}),
        "classes",
    )
    placed = settle(cells(classes, cosine, block_dims, cell_dims), "cells")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("lived_in")).where("rows > 1 and lived_in")
    counts = settle(counts.select("cell", F.ceil(F.col("rows") / cell_rows).alias("_tiles")), "cell-tiles")
    near = settle(cell_links(tiled(placed, counts, "cell", "rep"), cosine, block_dims), "near")
    clusters = settle(components(near).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "clusters")
    members = clusters.join(classes.select("rep", "label", "copies", "embedding"), "rep")
    tiles = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("_tiles"))
    found = settle(exact_links(tiled(members, tiles, "cluster", "rep"), cosine), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.select("rep", "_h1", "_h2", "least_id", "copies").join(links, "rep", "left").join(joined, "rep", "left")
    named = named.withColumn("root", F.coalesce("component", "rep"))
    lowest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per_class = settle(
        named.join(lowest, "root").select(
            "_h1", "_h2", "component_id",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        ),
        "per-class",
    )
    linked = good.select("vec_id", "_h1", "_h2").join(per_class, ["_h1", "_h2"]).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    alone = read.where("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_aggregate(list_transform(e, lambda x: x * x), 'sum')) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN counts USING (vec_id)
"""
