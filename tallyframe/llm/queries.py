"""Registered queries of this package: one per operator over its whole table, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import (
    boosted_trees, class_bigrams, decontaminate, jaccard_join, line_quality, periodic_runs, personal_data, secret_scan, source_mix,
    substring_dedup, toxicity, url_aliases, vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of the named tables."""

    def register(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*[_table(spark, sf_dir, t) for t in tables])
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


query("op1_secret_scans", "documents", sql=secret_scan.REPORT_SQL)(secret_scan.report)
query("op2_ngram_jaccard_join", "documents", sql=jaccard_join.LINKED_SQL)(jaccard_join.linked)
query("op3_suffix_array_dedup", "documents", sql=substring_dedup.REPORT_SQL)(substring_dedup.report)
query("op4_quality_rules", "documents")(line_quality.report)
query("op5_source_mix", "documents", sql=source_mix.TAKEN_SQL)(source_mix.taken)
query("op6_lm_scoring", "documents")(class_bigrams.scores)
query("op7_personal_data", "documents")(personal_data.report)
query("op8_benchmark_decontamination", "documents", "benchmark", sql=decontaminate.REPORT_SQL)(decontaminate.report)
query("op9_toxicity", "documents", "labels")(toxicity.toxicity_scores)
query("op10_quality_classifier", "documents", "labels")(boosted_trees.quality_scores)
query("op11_vector_codes", "embeddings", sql=vector_codes.REPORT_SQL)(vector_codes.report)
query("op12_url_aliases", "pages", sql=url_aliases.REPORT_SQL)(url_aliases.report)
query("op13_periodic_runs", "documents")(periodic_runs.report)
