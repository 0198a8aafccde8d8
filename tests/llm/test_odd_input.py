"""Every operator over missing values, empty and long texts, repeats, clashing columns, and empty tables."""

import pytest

from tallyframe.llm import (boosted_trees, class_bigrams, decontaminate, jaccard_join, line_quality, personal_data,
                            secret_scan, source_mix, substring_dedup, toxicity)
from tests.llm.cases import SCHEMA, frame, odd_rows


def _labels(spark, rows=((5, 1, 0), (6, 1, 1), (12, 0, 0), (None, 1, 1), (10, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "çödé 🙂 text"), (4, "!!")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: secret_scan.report(d),
    "op2": lambda s, d: jaccard_join.linked(d),
    "op3": lambda s, d: substring_dedup.report(d),
    "op4": lambda s, d: line_quality.report(d),
    "op5": lambda s, d: source_mix.taken(d),
    "op6": lambda s, d: class_bigrams.scores(d),
    "op7": lambda s, d: personal_data.report(d),
    "op8": lambda s, d: decontaminate.report(d, _benchmark(s)),
    "op9": lambda s, d: toxicity.toxicity_scores(d, _labels(s)),
    "op10": lambda s, d: boosted_trees.quality_scores(d, _labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    found = OPERATORS[name](spark, frame(spark, odd_rows(), clashes=True)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in odd_rows())
    repeated = [r for r in found if r.doc_id == 5]
    assert len(repeated) == 2 and repeated[0] == repeated[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


FILTERS = {
    "quality": lambda s, d: line_quality.kept_documents(d),
    "near": lambda s, d: jaccard_join.one_of_each_group(d),
    "benchmark": lambda s, d: decontaminate.clean_documents(d, _benchmark(s)),
    "secrets": lambda s, d: secret_scan.documents_without_secrets(d),
    "mix": lambda s, d: source_mix.mix(d),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    docs = frame(spark, odd_rows(), clashes=True)
    out = FILTERS[name](spark, docs)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    assert out.columns[:len(docs.columns)] == docs.columns
    out.collect()
    assert FILTERS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_labels(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in boosted_trees.quality_scores(docs, none).collect()} == {0.5}
    assert len({round(r.score, 9) for r in toxicity.toxicity_scores(docs, none).collect()}) == 1


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.report(frame(spark, odd_rows()), none).collect()
    assert len(found) == len(odd_rows()) and not any(r.contaminated for r in found)
