"""The corpus pipeline: each stage against the operator's brute-force version, and as a whole."""

import corpus_pipeline
import pytest
from llm_helpers import edge_docs, no_docs, sample_docs, texts
from test_neardup import classes
from test_packing import check

from crease.llm import pii, quality
from crease.llm.common import materialize

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_follow_each_other(spark, sf_dir):
    docs = sample_docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first = materialize(STAGES["quality"](spark, docs, sf_dir))
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.score >= 0.3}
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    second = materialize(STAGES["near_duplicates"](spark, first, sf_dir))
    assert sorted(r.doc_id for r in second.collect()) == [i for i, c, _ in classes(texts(first)) if i == c]
    third = materialize(STAGES["personal_data"](spark, second, sf_dir))
    plain = {i: pii.redact(t, pii.find_spans(t)) for i, t in texts(second)}
    assert dict(texts(third)) == plain and third.columns == docs.columns
    assert third.filter("n_chars <> length(text)").count() == 0
    rows = STAGES["packing"](spark, third, sf_dir).collect()
    check(rows, texts(third), 2048)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    digest = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert digest(whole) == digest(rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_and_no_rows(spark, sf_dir, name):
    docs = edge_docs(spark)
    found = STAGES[name](spark, docs, sf_dir)
    assert name == "packing" or found.columns == docs.columns
    assert found.count() > 0
    assert STAGES[name](spark, no_docs(spark), sf_dir).count() == 0
