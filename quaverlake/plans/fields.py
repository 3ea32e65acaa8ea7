"""Queries on packed fields (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaverlake.operators.multivalue import exploded_values
from quaverlake.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of every track whose performer text holds two or more, with its place."""
    return exploded_values(table(spark, sf_dir, "tracks"), "id", "performer", at_least=2).withColumnRenamed("id", "track_id")


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
