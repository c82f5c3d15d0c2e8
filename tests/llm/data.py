"""Small tables with everything that may go wrong: nulls, empty and very long texts, repeated rows, clashing names."""

import random

EXTRA = "row_key bigint, score double, kept boolean, _maybe boolean, n bigint, rep bigint, hash string, label int"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the extra columns hold values that would do harm if they were read."""
    full = [
        (i, t, g, s, None if t is None else len(t), 1, 0.5, False, True, 7, 1, "x", 1) for i, t, g, s in rows
    ]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
