"""Merkle manifest of a corpus: a tree per language and one over their subroots, as postorder logs of aligned builders.

Leaves are numbered within their language; a language of any size spreads over the range partitions of the numbering.
A builder takes an aligned run of 2**``bits`` nodes and appends every node to its segment of the log as soon as it is
complete: a pair right after its second half. So the log is in postorder, and where a node stands follows from the
sizes of the subtrees that are complete before it, without looking at any of them (``position``). The heads of the
segments are the nodes of the next round, until each tree has one head; subroots are the nodes of one more tree.

Proofs go the other way. A segment knows the siblings of all nodes of its run by their closed-form places in its log; it
appends the proof of its own head, which the round above has worked out, and hands the result to the segments below, or
to the documents. What moves is a row per segment; a document's text is read once and moves nowhere.

Defined results: fields that are null are hashed as ``-``; rows without a language are a tree of their own, the first one.
Rows without a doc_id come first in their tree and count as not chosen for the check by tampering; equal doc_ids go by
their leaf, and repeated rows are leaves of their own. Empty texts are ``0:``; texts of any length are hashed in the JVM.
An empty table has no leaves, subroots or root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from ..session import settle
from .common import runs, table, whole_groups

BITS, SIZE, TAMPERED = 8, 32, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------------ geometry


def position(n: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a level in the postorder log of a tree of ``n`` leaves.

    A node over a full run is complete with its last leaf: before it are all nodes complete with the leaves before that
    one, twice their number less one for each subtree still open (a bit of the number), and those below it on its right
    edge. Short runs, one per level at most, are complete after all leaves, from the lowest up.
    """
    ends = (np.asarray(index, dtype=np.int64) + 1) << level
    last = ends - 1
    whole = 2 * last - np.bitwise_count(last) + level
    lowest = (n & -n).bit_length() - 1
    return np.where(ends <= n, whole, 2 * n - n.bit_count() + level - 1 - lowest)


def height(n: int) -> int:
    """Levels above the leaves of a tree."""
    return (n - 1).bit_length()


def digest(*nodes: bytes) -> bytes:
    """The node above the given ones; digests go in as hexadecimal text."""
    return hashlib.sha256(b"".join([n.hex().encode() for n in nodes])).digest()


def grow(nodes: list[bytes], top: int) -> list[bytes]:
    """The log of one builder: its nodes and all above them up to level ``top``, in the order of completion."""
    log, waiting = [], []
    for k, node in enumerate(nodes):
        log.append(node)
        level = 0
        while level < top and k >> level & 1:
            node = digest(waiting.pop(), node)
            log.append(node)
            level += 1
        waiting.append(node)
    n, short = len(nodes), None
    if n < 1 << top:
        # the last run of a level is short: what waits there is the left half, or alone
        for level in range(top):
            if n >> level & 1:
                short = digest(waiting.pop(), *([] if short is None else [short]))
            elif short is not None:
                short = digest(short)
            if short is not None:
                log.append(short)
    return log


def _top(block: int, n: int, bits: int) -> int:
    """The level a builder ends at: only a run that is its whole tree ends below ``bits``."""
    return height(n) if block == 0 and n < 1 << bits else bits


def siblings(block: int, n: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: for each of a run's ``n`` nodes, the sibling's place in the segment (-1: none) and whether it is left."""
    first = block << bits
    start = int(position(first + n, 0, np.int64(first)))
    index = first + np.arange(n, dtype=np.int64)
    out = []
    for level in range(_top(block, n, bits)):
        node = index >> level
        other = node ^ 1
        place = position(first + n, level, other) - start
        out.append((np.where(other <= (first + n - 1) >> level, place, -1), other < node))
    return out


# ------------------------------------------------------------------ building


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (a name of the language's tree that sorts as they do), leaf and, for chosen rows, the tampered leaf."""
    col = {c: F.col(f"`{c}`") for c in FIELDS}

    def leaf(n_chars: Column) -> Column:
        fields = [_field(n_chars if c == "n_chars" else col[c]) for c in FIELDS]
        return F.unhex(F.sha2(F.concat(*fields), 256))

    chosen = F.crc32(col["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        "doc_id",
        F.when(col["lang"].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col["lang"])).alias("tree"),
        leaf(col["n_chars"]).alias("leaf"),
        F.when(chosen, leaf(col["n_chars"].cast("decimal(20,0)") + 1)).alias("tampered"),
    )


_SEGMENT = "tree string, block bigint, n bigint, log binary, doc_ids array<bigint>, tampered array<binary>"
_ARROW = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("log", pa.binary())]
    + [("doc_ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary()))]
)


def _segments(nodes: DataFrame, bits: int) -> DataFrame:
    """One round of builders over nodes (tree, at, node, doc_id, tampered): a row per aligned run, written to disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["tree", "block"]):
            trees, blocks = part["tree"].to_pylist(), part["block"].to_numpy()
            made, docs, changed = part["node"].to_pylist(), part["doc_id"].to_pylist(), part["tampered"].to_pylist()
            cuts = runs(part["tree"].to_numpy(), blocks)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                log = grow(made[a:b], _top(int(blocks[a]), b - a, bits))
                out.append((trees[a], int(blocks[a]), b - a, b"".join(log), docs[a:b], changed[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    placed = nodes.withColumn("block", F.expr(f"shiftright(at, {bits})"))
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return settle(dealt.mapInArrow(run, _SEGMENT), "segments")


def _grown(nodes: DataFrame, largest: int, bits: int) -> list[DataFrame]:
    """All rounds of builders for trees of up to ``largest`` leaves, the lowest first."""
    rounds = [_segments(nodes, bits)]
    while largest > 1 << bits:
        largest = -(-largest >> bits)
        heads = rounds[-1].select(
            "tree",
            F.col("block").alias("at"),
            F.expr(f"substring(log, -{SIZE}, {SIZE})").alias("node"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        rounds.append(_segments(heads, bits))
    return rounds


# ------------------------------------------------------------------ proofs

# sides: a byte per level, 0 without sibling, 1 sibling on the right, 2 on the left; path: the siblings there are
_PATH = "tree string, block bigint, sides binary, path binary"


def _paths(block: int, n: int, log: bytes, bits: int, sides: bytes, path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(sides, path) of every node of a run, from the node itself up to the root."""
    levels = siblings(block, n, bits)
    side = np.array([np.where(place < 0, 0, np.where(left, 2, 1)) for place, left in levels], dtype=np.uint8).reshape(-1, n)
    places = [place.tolist() for place, _ in levels]
    for k in range(n):
        own = [log[p[k] * SIZE : (p[k] + 1) * SIZE] for p in places if p[k] >= 0]
        yield side[:, k].tobytes() + sides, b"".join(own) + path


def _below(segments: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Paths of the nodes of a round, from those of its segments' heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = list(_paths(r["block"], r["n"], r["log"], bits, r["sides"], r["path"]))
                at = np.arange(r["n"], dtype=np.int64) + (r["block"] << bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["tree"]] * r["n"]), pa.array(at), *[pa.array(c, pa.binary()) for c in zip(*made)]],
                    names=["tree", "block", "sides", "path"],
                )

    rows = segments.select("tree", "block", "n", "log").join(above, ["tree", "block"])
    return rows.mapInArrow(run, _PATH)


def fold(node: bytes, sides: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its proof lead to."""
    at = 0
    for side in sides:
        if side:
            other = path[at : at + SIZE]
            at += SIZE
            node = digest(other, node) if side == 2 else digest(node, other)
        else:
            node = digest(node)
    return node


class Manifest:
    """The written logs of a corpus: ``rounds`` of segments per language, ``upper`` rounds over the subroots, ``trees``."""

    def __init__(self, docs: DataFrame, bits: int = BITS) -> None:
        self.bits = bits
        # rows that agree in all of them are the same leaf, and any order of them will do
        told = leaves(docs).withColumn("tie", F.monotonically_increasing_id())
        placed = running(told, ["tree"], ["doc_id", "leaf", "tie"], ordinal="number")
        nodes = placed.select("tree", (F.col("number") - 1).alias("at"), F.col("leaf").alias("node"), "doc_id", "tampered")
        # a row per language; only the size of the largest is needed here
        sizes = settle(nodes.groupBy("tree").agg((F.max("at") + 1).alias("n_leaves")), "trees")
        largest = sizes.agg(F.max("n_leaves"), F.count(F.lit(1))).first()
        self.rounds = _grown(nodes, largest[0] or 0, bits)
        subroot = F.expr(f"substring(log, -{SIZE}, {SIZE})")
        tops = self.rounds[-1].select("tree", subroot.alias("subroot"))
        self.trees = settle(running(tops.join(sizes, "tree"), [], ["tree"], ordinal="number"), "subroots")
        top = self.trees.select(
            F.lit("").alias("tree"),
            (F.col("number") - 1).alias("at"),
            F.col("subroot").alias("node"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        self.upper = _grown(top, largest[1], bits)

    def root(self) -> DataFrame:
        """One row, ``root``; none for an empty corpus."""
        return self.upper[-1].select(F.expr(f"substring(log, -{SIZE}, {SIZE})").alias("root"))

    def _down(self, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
        for segments in reversed(rounds):
            above = _below(segments, above, self.bits)
        return above

    def heads(self) -> DataFrame:
        """Paths of the lowest segments' heads: tree, block, sides, path."""
        nothing = F.lit(b"")
        start = self.upper[-1].select("tree", "block", nothing.alias("sides"), nothing.alias("path"))
        subroots = self._down(self.upper, start).withColumnRenamed("block", "at").drop("tree")
        numbered = self.trees.select("tree", (F.col("number") - 1).alias("at"))
        above = numbered.join(subroots, "at").select("tree", F.lit(0).cast("bigint").alias("block"), "sides", "path")
        return self._down(self.rounds[1:], above)

    def proofs(self) -> DataFrame:
        """doc_id, tree, leaf, siblings of the proof (hexadecimal), root folded from the leaf, tampered where it is chosen."""
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "tree", "leaf", "siblings", "folded_root"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            for batch in batches:
                for r in batch.to_pylist():
                    start = int(position((r["block"] << bits) + r["n"], 0, np.int64(r["block"] << bits)))
                    at = position((r["block"] << bits) + r["n"], 0, np.arange(r["n"]) + (r["block"] << bits)) - start
                    own = [r["log"][p : p + SIZE] for p in (at * SIZE).tolist()]
                    out = []
                    paths = _paths(r["block"], r["n"], r["log"], bits, r["sides"], r["path"])
                    for doc, leaf, changed, (sides, path) in zip(r["doc_ids"], own, r["tampered"], paths):
                        out.append((doc, r["tree"], leaf.hex(), path.hex(), fold(changed or leaf, sides, path).hex()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        rows = self.rounds[0].join(self.heads(), ["tree", "block"])
        return rows.mapInArrow(run, "doc_id bigint, tree string, leaf string, siblings string, folded_root string")


def verified(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """A row per document: its leaf, its proof's digest, and whether the proof holds for the row as it was handed in."""
    made = Manifest(docs, bits)
    # a row per language
    tops = made.trees.select("tree", "n_leaves", F.lower(F.hex("subroot")).alias("subroot"))
    root = made.root().first()
    rows = made.proofs().join(tops, "tree").withColumn("root", F.lit(root and root.root.hex()).cast("string"))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def _sql_leaf(n_chars: str) -> str:
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    return "sha256(" + " || ".join(field(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


# one level after the other: every two nodes become one; proofs by looking siblings up in the levels
OP11_SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars::HUGEINT + 1)")} AS changed,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))
         )) AS crc
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER () AS row,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
),
tree(lang, level, i, n, node) AS (
  SELECT lang, 0, i, count(*) OVER (PARTITION BY lang), leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY lang, level, i // 2, n
),
subroots AS (
  SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang COLLATE "C" NULLS FIRST) - 1 AS i FROM tree WHERE n = 1
),
upper(level, i, n, node) AS (
  SELECT 0, i, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, n
),
steps AS (
  SELECT p.row, l.level, s.node AS other, (p.i >> l.level) & 1 AS is_right
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.i = xor(p.i >> l.level, 1)
  UNION ALL
  SELECT p.row, r.height + l.level, s.node, (r.i >> l.level) & 1
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) l
  LEFT JOIN upper s ON s.level = l.level AND s.i = xor(r.i >> l.level, 1)
),
folded(row, level, node) AS (
  SELECT row, 0, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END FROM placed
  UNION ALL
  SELECT f.row, f.level + 1,
         sha256(CASE WHEN s.other IS NULL THEN f.node WHEN s.is_right = 1 THEN s.other || f.node ELSE f.node || s.other END)
  FROM folded f JOIN steps s ON s.row = f.row AND s.level = f.level
),
proofs AS (SELECT row, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY row),
ends AS (SELECT row, arg_max(node, level) AS folded_root FROM folded GROUP BY row)
SELECT p.doc_id, p.leaf, r.subroot, u.node AS root, coalesce(h.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = u.node AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN ends e ON e.row = p.row
CROSS JOIN (SELECT node FROM upper WHERE n = 1) u LEFT JOIN proofs h ON h.row = p.row
"""
