"""The known sources in their order, and what a request for sources stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Key, provider and mode of each source, in the order in which they are shown and run.
SOURCES = (
    ("chopin", "ia", "item"),
    ("bach_wtc1", "ia", "item"),
    ("goldberg", "ia", "item"),
    ("beethoven_pitman", "commons", "search"),
    ("marine", "commons", "search"),
    ("army", "commons", "search"),
    ("navy", "commons", "search"),
    ("airforce", "commons", "search"),
    ("coastguard", "commons", "search"),
    ("spaceforce", "commons", "search"),
    ("commons_classical", "commons", "classical_categories"),
)


def registry(spark: SparkSession, sources: tuple[tuple[str, str, str], ...] = SOURCES) -> DataFrame:
    """``(ord, key, provider, mode)`` of all sources."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(sources)], "ord int, key string, provider string, mode string")


def resolve(requested: list[str], sources: tuple[tuple[str, str, str], ...] = SOURCES) -> list[str]:
    """The sources asked for, as asked; none or "all" are all. An unknown one raises ValueError."""
    known = [s[0] for s in sources]
    if not requested or requested == ["all"]:
        return known
    for k in requested:
        if k not in known:
            raise ValueError(f"unknown source {k!r} (known: {known})")
    return list(requested)
