"""Browsing, counting and grouping the catalogue of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.text import blank_to_null, nocase, work_id
from quaverlake.session import small

DASH = "—"


def playable(t: str = "") -> Column:
    """Done, packaged and no duplicate."""
    c = lambda n: F.col(f"{t}{n}")
    return (c("status") == "done") & c("caf_path").isNotNull() & c("dup_of").isNull()


def browse(tracks: DataFrame, level: str, **at: str | None) -> DataFrame:
    """``(name, key, n)`` of the entries one level below ``at``: playable tracks counted.

    Levels are source, composer (below a source), title and work (below source and composer). An
    unknown composer is NULL and "" alike, and shown as a dash with key "". Titles that differ in
    ASCII case only are one entry, named by the smallest.
    """
    t = tracks.where(playable())
    for name in ("source", "composer"):
        if name in at:
            t = t.where(blank_to_null(F.col(name)).eqNullSafe(F.nullif(F.lit(at[name]), F.lit(""))))
    shown = lambda c: F.coalesce(blank_to_null(c), F.lit(DASH))
    if level in ("source", "composer"):
        key = F.coalesce(F.col(level), F.lit(""))
        return t.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(shown(F.col("key")).alias("name"), "key", "n")
    g = t.groupBy(nocase(F.coalesce(F.col("title"), F.lit(""))).alias("__k")).agg(F.min(F.coalesce(F.col("title"), F.lit(""))).alias("key"), F.count("*").alias("n"))
    return g.select(shown(F.col("key")).alias("name"), "key", "n")


def browse_works(tracks: DataFrame, works: DataFrame) -> DataFrame:
    """``(source, composer, key, name, sort_key, n)``: works with playable counts, all at once.

    Tracks without a work stand under their title, key ``title:<title>``; of a key's rows the one
    with the smallest id names it.
    """
    w = small(works.select(F.col("id").alias("work_id"), F.col("title").alias("wt"), F.col("sort_key").alias("ws")))
    t = tracks.where(playable()).join(w, "work_id", "left")
    key = F.coalesce("work_id", F.concat(F.lit("title:"), "title"))
    first = F.min(F.struct("id", F.coalesce("wt", "work_title", "title").alias("name"), F.coalesce("ws", "work_title", "title").alias("sort_key")))
    g = t.groupBy("source", blank_to_null(F.col("composer")).alias("composer"), key.alias("key")).agg(first.alias("f"), F.count("*").alias("n"))
    return g.select("source", "composer", "key", F.coalesce("f.name", F.lit(DASH)).alias("name"), "f.sort_key", "n")


def group_works(tracks: DataFrame) -> DataFrame:
    """``(id, composer_canonical, title, catalog, track_count)``: works grouped from enriched tracks."""
    t = tracks.where(playable() & F.col("enriched_at").isNotNull()).withColumn("wid", work_id(F.col("composer_canonical"), F.col("work_title"), F.col("catalog")))
    first = F.min(F.struct(F.col("id").alias("tid"), "composer_canonical", "work_title", "catalog"))
    g = t.where("wid is not null").groupBy("wid").agg(first.alias("f"), F.count("*").alias("track_count"))
    return g.select(F.col("wid").alias("id"), "f.composer_canonical", F.col("f.work_title").alias("title"), "f.catalog", "track_count")


def insert_if_absent(new: DataFrame, old: DataFrame, *keys: str) -> DataFrame:
    """``old`` with those rows of ``new`` whose keys it lacks, one for each key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(new: DataFrame, old: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` overwritten by ``new`` row by row; columns in ``keep`` stay as they were."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in old.columns if c != key], F.lit(True).alias("__new"))
    pick = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in keep else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
    return old.join(n, key, "full").select(key, *[pick(c).alias(c) for c in old.columns if c != key])


#: The order of the stages a track passes.
STAGES = ("discovered", "downloading", "downloaded", "converting", "converted", "packaging", "packaged", "cleaning", "done")


def funnel(tracks: DataFrame) -> DataFrame:
    """Per source: how many tracks have come at least so far; skipped ones count apart, failed ones as found."""
    rank = F.coalesce(F.array_position(F.lit(list(STAGES)), F.col("status")) - 1, F.lit(-1))
    live = ~F.col("status").isin("skipped", "failed")
    far = lambda s: F.count_if(live & (rank >= STAGES.index(s)))
    g = tracks.groupBy("source").agg(
        F.count_if(F.col("status") != "skipped").alias("found"), far("downloaded").alias("downloaded"), far("converted").alias("converted"), far("packaged").alias("packaged"), far("done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return g.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("done") * 100.0, F.col("found")), 6), F.lit(0.0)))


def best_variant(files: DataFrame, group: list[str], fmt: Column, prefer: list[str], order: Column) -> DataFrame:
    """The best file of each group: lowest preference, then first; a file of no listed format last.

    One aggregation with partial minima; no group's files are gathered.
    """
    rank = F.lit(len(prefer))
    for i, f in enumerate(prefer):
        rank = F.when(F.lower(fmt) == f, i).otherwise(rank)
    cols = [c for c in files.columns if c not in group]
    return files.groupBy(*group).agg(F.min(F.struct(rank.alias("__rank"), order.alias("__at"), *cols)).alias("f"), F.count("*").alias("variants")).select(*group, "variants", *[F.col(f"f.{c}").alias(c) for c in cols])
