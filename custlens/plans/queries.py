"""Registered queries: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custlens.plans import core_queries, job_queries, model_queries, serving_queries, study_queries

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {
        **core_queries.QUERIES, **serving_queries.QUERIES, **model_queries.QUERIES, **job_queries.QUERIES, **study_queries.QUERIES,
    }
