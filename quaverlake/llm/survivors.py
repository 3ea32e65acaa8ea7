"""Best representative of each duplicate group: field-by-field survivorship in one aggregation.

For each attribute the surviving value is the maximum of a composite struct (is there a value,
priority of its source, time, value); the surviving record is the extremum of the struct of the
ranks that judge a whole record. All of it is one ``groupBy`` with partial aggregation, so a group
that a third of all rows belong to is reduced where its rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.session import small

#: A file of fewer bytes cannot hold a recording (a container's headers alone take more).
LEAST_BYTES = 1_024
#: More than any single recording takes.
MOST_BYTES = 1 << 40
#: What a format text contains, and the format it then means; the first hit counts.
FORMAT_WORDS = (("opus", "opus"), ("flac", "flac"), ("ogg", "ogg"), ("oga", "ogg"), ("vorbis", "ogg"), ("wav", "wav"), ("pcm", "wav"), ("mp3", "mp3"), ("mpeg", "mp3"))


def source_key(c: Column) -> Column:
    """A source name in one form: lower case, no outer blanks, words joined by one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"[\s_\-]+", "_")


def format_key(c: Column) -> Column:
    """The format a free text means, or NULL."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for word, fmt in reversed(FORMAT_WORDS):
        out = F.when(low.contains(word), fmt).otherwise(out)
    return out


def real_size(c: Column) -> Column:
    """The size in bytes, or NULL if it is missing or impossible."""
    return F.when((c >= LEAST_BYTES) & (c <= MOST_BYTES), c)


def _ranked(groups: DataFrame, tracks: DataFrame, trust: DataFrame, pref: DataFrame) -> DataFrame:
    t = tracks.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.max(F.struct(F.col("updated_at").alias("at"), F.col("source").alias("source"), F.col("original_format").alias("format"), F.col("original_bytes").alias("bytes"))).alias("r")
    )
    trusts = trust.groupBy(source_key(F.col("source")).alias("sk")).agg(F.max("trust").alias("trust"))
    prefs = pref.groupBy(format_key(F.col("fmt")).alias("fk")).agg(F.min("pref").alias("pref"))
    members = groups.select(F.col("track_id").alias("id"), "group_id")
    return (
        members.join(t, "id", "left")
        .select("group_id", "id", source_key(F.col("r.source")).alias("sk"), format_key(F.col("r.format")).alias("fk"), real_size(F.col("r.bytes")).alias("size"), "r.at", "r.source", "r.format")
        .join(small(trusts), "sk", "left")
        .join(small(prefs), "fk", "left")
    )


def best_tracks(groups: DataFrame, tracks: DataFrame, trust: DataFrame, pref: DataFrame) -> DataFrame:
    """``(group_id, survivor_id)``: most trusted source, most preferred format, largest size, smallest id.

    A source without trust ranks below all, a format without preference after all, a missing or
    impossible size after all real ones; NULLs in any column rank so too. Repeated rows change
    nothing, ties end at the id, an empty table gives an empty result, other columns are not read.
    """
    ranked = _ranked(groups, tracks, trust, pref)
    judged = F.struct(
        F.col("trust").isNull().alias("untrusted"),
        (-F.col("trust")).alias("t"),
        F.col("pref").isNull().alias("unpreferred"),
        F.col("pref").alias("p"),
        F.col("size").isNull().alias("unsized"),
        (-F.col("size")).alias("s"),
        F.col("id").alias("id"),
    )
    return ranked.groupBy("group_id").agg(F.min(judged).alias("best")).select("group_id", F.col("best.id").alias("survivor_id"))


def golden_tracks(groups: DataFrame, tracks: DataFrame, trust: DataFrame, pref: DataFrame) -> DataFrame:
    """One built record per group, each attribute by itself: (has a value, trust, time, value) at most.

    ``(group_id, members, source, original_format, original_bytes)``; an attribute that no member
    has is NULL.
    """
    ranked = _ranked(groups, tracks, trust, pref)

    def field(value: Column, *rank: Column) -> Column:
        best = F.max(F.struct(value.isNotNull().alias("has"), F.coalesce("trust", F.lit(-1)).alias("trust"), *[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col("at").alias("at"), value.alias("value")))
        return best["value"]

    return ranked.groupBy("group_id").agg(
        F.count("*").alias("members"),
        field(F.col("sk")).alias("source"),
        field(F.col("fk"), -F.coalesce("pref", F.lit(1 << 30))).alias("original_format"),
        field(F.col("size")).alias("original_bytes"),
    )
