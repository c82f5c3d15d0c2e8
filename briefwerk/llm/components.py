"""Connected components by alternating stars, and the comparison of groups of any size tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return (row.n, row.h)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between bigint nodes → (node, component): the smallest node that each linked node reaches.

    Large stars and small stars take turns, so the rounds grow with the logarithm of the longest chain. A node
    with very many neighbours meets only a minimum per group and a join that adaptive execution can split. Each
    round is written to the shared folder. Nodes without links don't appear; null and self links don't count.
    """
    edges = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _fingerprint(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large-star")
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        before, mark = mark, _fingerprint(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def tiled(rows: DataFrame, tiles: DataFrame, key: str, by: str) -> DataFrame:
    """Deal the rows of groups to tile pairs, so that no task holds a whole large group.

    ``tiles`` says for each ``key`` into how many tiles (``_tiles``) its rows are split by a hash of ``by``.
    A row goes to every pair that its tile (``_own``) is part of: (``_first``, ``_second``), and every two rows
    of a group meet in exactly one pair, or in (t, t) if they share a tile. Rows come sorted by key and pair.
    """
    own = F.pmod(F.xxhash64(F.col(by)), F.col("_tiles")).cast("int")
    return (
        rows.join(tiles, key)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_tiles") - 1).cast("int"))))
        .withColumns({"_first": F.least("_own", "_other"), "_second": F.greatest("_own", "_other")})
        .drop("_other", "_tiles")
        .repartition(key, "_first", "_second")
        .sortWithinPartitions(key, "_first", "_second")
    )


def pairs(bounds: np.ndarray, own: np.ndarray, first: np.ndarray, second: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) to compare within the runs that ``bounds`` cut out, about ``most`` at a time."""
    starts, sizes = bounds[:-1], np.diff(bounds)

    def wanted(i, j):
        keep = (first[i] == second[i]) | (own[i] != own[j])
        return i[keep], j[keep]

    for size in np.unique(sizes[sizes > 1]):
        of = starts[sizes == size]
        if size * (size - 1) // 2 <= most:
            a, b = np.triu_indices(size, 1)
            step = max(1, most // len(a))
            for k in range(0, len(of), step):
                base = of[k : k + step, None]
                yield wanted((base + a).ravel(), (base + b).ravel())
        else:
            step = max(1, most // size)
            for base in of:
                for k in range(0, size, step):
                    i = np.arange(k, min(size, k + step))
                    a, b = np.repeat(i, size), np.tile(np.arange(size), len(i))
                    upper = a < b
                    yield wanted(base + a[upper], base + b[upper])
