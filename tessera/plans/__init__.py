"""Queries over the test tables, one module for each part of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import aggregates, audits, cohorts, contracts, corpus, evaluation, fusion, inout, ranking, relational  # noqa: F401
from tessera.registry import QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["baseline_fold_change_rank"](spark, sf_dir)
