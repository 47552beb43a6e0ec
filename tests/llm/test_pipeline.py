"""The pipeline's stages: what each keeps, against plain versions of the operators."""

import collections

import corpus_pipeline
import pytest
from riverlog.llm.tables import written
from tests.llm.test_texts import ODD, SCHEMA, plain_components, plain_repeats, rows_of, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        kept.append(docs)
    return kept


def test_each_stage_follows_from_the_one_before(spark, outputs):
    first, single, cut, mixed, encoded = outputs
    source = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    long_enough = {doc for doc, text in source if len(words(text)) >= 20}
    assert {doc for doc, _ in rows_of(first)} <= long_enough
    wanted = {doc for (doc, _, component) in plain_components(rows_of(first)) if doc == component}
    assert {doc for doc, _ in rows_of(single)} == wanted
    removed = {doc: (n, gone) for doc, n, gone, _ in plain_repeats(rows_of(single), 20)}
    for doc, text in rows_of(cut):
        assert len(words(text)) == removed[doc][0] - removed[doc][1]
    copies = collections.Counter(doc for doc, _ in rows_of(mixed))
    assert set(copies) <= wanted and max(copies.values()) <= 2
    total = sum(len(words(text)) for _, text in rows_of(cut))
    largest = max(len(words(text)) for _, text in rows_of(cut))
    assert abs(sum(len(words(text)) for _, text in rows_of(mixed)) - 1.5 * total) <= 21 * largest
    assert collections.Counter(r.doc_id for r in encoded.collect()) == copies


def test_stages_keep_the_columns(outputs):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in outputs[:-1])


def test_run_gives_the_last_stage(spark, outputs):
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == collections.Counter(map(tuple, outputs[-1].collect()))


def test_odd_rows_and_none(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
            written(stage(spark, docs, SF), "odd")
        corpus_pipeline.encode(spark, docs, SF).collect()
