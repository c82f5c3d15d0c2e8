"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations. DataFrames only.

A source's weight is its share of all words raised to an exponent, normalised. The exponent is bisected on a
grid of 1/1024: the largest one whose weights reach the target entropy (a share of the greatest possible one),
raised to the smallest one that repeats no source more often than allowed.

Each source then gets ``weight x budget`` words. It is read pass by pass, each pass in another permutation by
MD5 of (pass, doc_id, text's MD5); a document that begins within the budget is in. The stream of every source is spread
evenly over blocks of ``block_tokens`` words, so each block holds the weights, and is permuted in itself.

Places in a pass are running sums. A source may hold a third of all rows, so the rows of a pass are dealt to
4096 MD5 ranges, summed within each, and joined with the sums of the ranges before: no task sees a whole source.

Defined results: null texts have no words; null is a source of its own; documents without words cost nothing
and come along where they fall; a source without words has no weight and is left out; repeated rows are
separate documents that may swap places; an empty table gives no rows; further columns are ignored unless
named in ``carry``. Rows that agree in id, source and text are in the same place of a permutation, one after the other.

All numbering is done on rows without texts. Columns to carry are written once with a number for each row, and moved
once, to the rows' places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import table

GRID = 1024
ENTROPY, REPEATS, BLOCK_TOKENS = 0.95, 4.0, 1 << 16
_WORD = r"[^ \t\n\r\f]+"


def _logs(shares: DataFrame, exponent) -> tuple:
    """Sum of tempered shares and sum of them times their logarithm."""
    tempered = F.exp(exponent * F.ln("share"))
    return F.sum(tempered), F.sum(tempered * F.ln("share"))


def exponent(shares: DataFrame, total: int, budget: int, entropy: float, repeats: float) -> float:
    """The exponent on the grid; ``shares`` has share and tokens of every source with words."""
    facts = shares.agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least")).first()
    if not facts.n:
        return 1.0

    def measured(steps: list[int]) -> list[tuple[float, float]]:
        """(entropy as a share of the greatest, most repetitions) for exponents step / GRID, in one pass."""
        sums = [part for k in steps for part in _logs(shares, F.lit(k / GRID))]
        row = shares.agg(*[s.alias(f"_{k}") for k, s in enumerate(sums)]).first()
        out = []
        for k, step in enumerate(steps):
            z, s = row[2 * k], row[2 * k + 1]
            a = step / GRID
            bits = _log(z) - a * s / z
            rarest = (facts.least / total) ** a / z
            out.append((bits / _log(facts.n) if facts.n > 1 else 1.0, rarest * budget / facts.least))
        return out

    # the largest step with enough entropy, and the smallest one without too much repetition
    low_h, high_h, low_r, high_r = 0, GRID + 1, -1, GRID
    while high_h - low_h > 1 or high_r - low_r > 1:
        mid_h, mid_r = (low_h + high_h) // 2, (low_r + high_r) // 2
        (h, _), (_, r) = measured([mid_h, max(mid_r, 0)])
        if high_h - low_h > 1:
            low_h, high_h = (mid_h, high_h) if h >= entropy else (low_h, mid_h)
        if high_r - low_r > 1:
            low_r, high_r = (low_r, mid_r) if r <= repeats else (mid_r, high_r)
    return max(low_h, high_r) / GRID


def _log(x: float) -> float:
    import math

    return math.log(x)


def mixture(
    docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, text, source) → block, place, doc_id, source, pass, n_tokens, weight, one row per use of a document.

    ``budget`` is in words; without one it is the number of words there are. ``carry`` names columns that come along.
    """
    kept = [F.col(c).alias(f"_c_{k}") for k, c in enumerate(carry)]
    rows = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")).alias("_s"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("_text"), *kept,
    )
    # sums and places are taken from narrow rows; what is carried waits under the row's number
    wide = settle(rows.withColumn("_row", F.monotonically_increasing_id()), "counted") if carry else settle(rows, "counted")
    narrow = wide.select("doc_id", "_s", "n_tokens", "_text", *(["_row"] if carry else []))
    tokens = settle(narrow.groupBy("_s").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = tokens.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = F.lit(exponent(shares, total, budget, entropy, repeats))
    z = shares.agg(F.sum(F.exp(a * F.ln("share")))).first()[0] or 1.0
    blocks = max(1, -(-budget // block_tokens))
    planned = shares.select(
        "_s", "tokens", F.round(F.exp(a * F.ln("share")) / F.lit(z), 9).alias("weight"),
        F.round(F.exp(a * F.ln("share")) / F.lit(z) * F.lit(float(budget))).cast("bigint").alias("_budget"),
    ).where("_budget > 0")
    planned = settle(planned.withColumn("_passes", F.ceil(F.col("_budget") / F.col("tokens")).cast("int")), "plan")

    def used(some: DataFrame) -> DataFrame:
        """A row per document and pass, with its place in the permutation and the range that this falls in."""
        name = F.concat_ws(":", F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text")
        each = some.join(planned, "_s").withColumn("pass", F.explode(F.expr("sequence(0, _passes - 1)")))
        return each.withColumn("_key", F.md5(name.cast("binary"))).withColumn("_range", F.substring("_key", 1, 3))

    before = Window.partitionBy("_s", "pass").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        used(narrow).groupBy("_s", "pass", "_range", "tokens", "_budget").agg(F.sum("n_tokens").alias("_sum"))
        .withColumn("_before", F.col("pass") * F.col("tokens") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .where("_before < _budget")
    )
    ranges = settle(ranges.select("_s", "pass", "_range", "_before"), "ranges")
    # of the last pass only the ranges within the budget are moved: a row per source and pass says up to which
    ends = settle(ranges.groupBy("_s", "pass").agg(F.max("_range").alias("_end")), "ends")
    inside = Window.partitionBy("_s", "pass", "_range").orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        used(narrow).join(ends, ["_s", "pass"]).where("_range <= _end")
        .withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(ranges, ["_s", "pass", "_range"])
        .withColumn("_at", F.col("_before") + F.col("_inside"))
        .where(F.col("_at") < F.col("_budget"))
        # wide numbers: places times blocks outgrow 64 bits
        .withColumn("block", F.expr(f"cast(cast(_at as decimal(19,0)) * {blocks} div _budget as bigint)"))
    )
    within = Window.partitionBy("block").orderBy("_key", "_s", "n_tokens")
    done = placed.select(
        "block", F.row_number().over(within).cast("bigint").alias("place"), "doc_id",
        F.when(F.col("_s") != "", F.substr("_s", F.lit(2))).alias("source"), F.col("pass").cast("bigint").alias("pass"), "n_tokens", "weight",
        *(["_row"] if carry else []),
    )
    if not carry:
        return done
    moved = done.join(wide.select("_row", *[f"_c_{k}" for k in range(len(carry))]), "_row")
    return moved.select(*[c for c in done.columns if c != "_row"], *[F.col(f"_c_{k}").alias(c) for k, c in enumerate(carry)])


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH counted AS (SELECT doc_id, source, coalesce(':' || source, '') AS s,
                        CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f]+')), 0) AS BIGINT) AS n_tokens,
                        coalesce(md5(text), '') AS t FROM documents),
sources AS (SELECT s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM counted GROUP BY s HAVING sum(n_tokens) > 0),
facts AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n, min(tokens) AS least FROM sources),
shares AS (SELECT s, tokens, CAST(tokens AS DOUBLE) / total AS share FROM sources, facts),
grid AS (SELECT k, k / {GRID}.0::DOUBLE AS a FROM (SELECT unnest(generate_series(0, {GRID})) AS k)),
sums AS (SELECT k, a, sum(exp(a * ln(share))) AS z, sum(exp(a * ln(share)) * ln(share)) AS l FROM grid, shares GROUP BY k, a),
measured AS (SELECT k, CASE WHEN n > 1 THEN (ln(z) - a * l / z) / ln(n) ELSE 1 END AS entropy,
                    pow(CAST(least AS DOUBLE) / total, a) / z * total / least AS repeats FROM sums, facts),
chosen AS (SELECT greatest(coalesce((SELECT max(k) FROM measured WHERE entropy >= {ENTROPY}), 0),
                           coalesce((SELECT min(k) FROM measured WHERE repeats <= {REPEATS}), {GRID})) AS k),
planned AS (SELECT s, tokens, exp(a * ln(share)) / z AS w, CAST(round(exp(a * ln(share)) / z * total) AS BIGINT) AS budget,
                   CAST(ceil(total / {BLOCK_TOKENS}.0) AS HUGEINT) AS blocks
            FROM shares, facts, sums JOIN chosen USING (k)),
passes AS (SELECT p.*, unnest(generate_series(0, CAST(ceil(budget / CAST(tokens AS DOUBLE)) AS BIGINT) - 1)) AS pass FROM planned p WHERE budget > 0),
used AS (SELECT c.*, p.* EXCLUDE (s), md5(pass || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) AS key FROM counted c JOIN passes p USING (s)),
placed AS (SELECT *, pass * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY s, pass ORDER BY key, n_tokens
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM used),
cut AS (SELECT *, CAST(CAST(begins AS HUGEINT) * blocks // budget AS BIGINT) AS block FROM placed WHERE begins < budget)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY key, s, n_tokens) AS place, doc_id, source,
       CAST(pass AS BIGINT) AS pass, n_tokens, round(w, 9) AS weight FROM cut
"""
