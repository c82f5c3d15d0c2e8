"""The whole pipeline against a brute-force version of its stages."""

from pathlib import Path

import pytest

import corpus_pipeline
from briefwerk.llm import mixture, personal, quality

from .data import rows_of
from .test_pairs import brute_contamination, brute_near
from .test_texts import plain_mixture, plain_spans

SF = Path("/root/testdata/sf0.001")


pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the given tables")


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in quality.quality(docs, model).collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if scores[r.doc_id]]
    rows = [r for r, (i, c, _) in zip(rows, brute_near(rows), strict=True) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, hit in zip(rows, brute_contamination(rows, items), strict=True) if not hit[5]]
    rows = [(i, personal.replaced(t, plain_spans(t)), g, s) for i, t, g, s in rows]
    want = plain_mixture(rows, mixture.ENTROPY, mixture.REPEATS, None, mixture.BLOCK_TOKENS)
    found = corpus_pipeline.run(spark, str(SF))
    texts = {i: t for i, t, _, _ in rows}
    assert rows_of(found, "block", "doc_id", "source", "pass", "n_tokens") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert all(texts[r.doc_id] == r.text for r in found.select("doc_id", "text").collect())


def test_stages_keep_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "personal data", "mixture"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(SF)).schema.simpleString() == docs.schema.simpleString()
    last = corpus_pipeline.STAGES[-1][1](spark, docs.limit(50), str(SF))
    assert last.columns == ["block", "place", "doc_id", "source", "pass", "n_tokens", "weight", "text", "lang", "n_chars"]
