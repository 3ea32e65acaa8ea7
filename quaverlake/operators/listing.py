"""Opening the catalogue, and the lists that its users and workers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions.rules import key_parts
from quaverlake.functions.text import match_terms, nocase
from quaverlake.operators.catalogue import playable
from quaverlake.operators.search import search
from quaverlake.session import exists

# The columns of the catalogue's table of tracks, and those of a full row as it is read.
TRACKS = (
    "id string, source string, source_item string, title string, work string, movement string, composer string, performer string, album string, year int, date_raw string, duration_sec double, "
    "original_url string, original_format string, original_codec string, original_bytes bigint, original_sha1 string, opus_path string, opus_bytes bigint, caf_path string, caf_bytes bigint, "
    "license_short string, license_url string, search_text string, status string, worker string, attempts int, stage_error string, next_attempt_at bigint, created_at bigint, updated_at bigint, "
    "composer_canonical string, work_id string, work_title string, catalog string, movement_index int, movement_title string, display_title string, composer_corrected boolean, "
    "audio_fingerprint string, dup_of string, enrich_model string, enrich_confidence double, enriched_at bigint"
)
UNREAD = ("search_text", "worker", "next_attempt_at", "created_at", "updated_at", "enrich_model", "enrich_confidence", "enriched_at")
TRACK_COLS = tuple(c.split()[0] for c in TRACKS.split(", ") if c.split()[0] not in UNREAD)


def open_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The tracks stored at ``path``, with the catalogue's schema; an empty table if there is none yet.

    Columns that an older table lacks come out NULL.
    """
    if exists(spark, path):
        return spark.read.schema(TRACKS).parquet(path)
    return spark.createDataFrame([], TRACKS)


def full_rows(tracks: DataFrame) -> DataFrame:
    """The columns of a full row: missing numbers are 0, missing texts "", a missing flag false."""
    kinds = dict(c.split() for c in TRACKS.split(", "))
    none = {"string": F.lit(""), "boolean": F.lit(False)}
    return tracks.select(*[F.coalesce(F.col(c), none.get(kinds[c], F.lit(0).cast(kinds[c] if kinds[c] not in none else "int"))).alias(c) for c in TRACK_COLS])


def lookup(tracks: DataFrame, id: str) -> DataFrame:
    """The rows of one id; the predicate reaches the scan."""
    return tracks.where(F.col("id") == id)


def eligible(now: Column) -> Column:
    """Whether a track's cooldown is over."""
    return F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)


def oldest(tracks: DataFrame, status: str, now: Column, n: int = 1) -> DataFrame:
    """The n oldest eligible tracks of a status, first come first; ties by id."""
    return tracks.where((F.col("status") == status) & eligible(now)).orderBy("created_at", "id").limit(n)


def to_enrich(tracks: DataFrame, force: bool = False, limit: int = 0) -> DataFrame:
    """Finished tracks that no model has described yet (all with ``force``), oldest first; 0 is no limit."""
    t = tracks.where((F.col("status") == "done") & (F.lit(force) | F.col("enriched_at").isNull())).orderBy("created_at", "id")
    return t.limit(limit) if limit > 0 else t


def packaged() -> Column:
    return (F.col("status") == "done") & F.col("caf_path").isNotNull()


def to_fingerprint(tracks: DataFrame, force: bool = False) -> DataFrame:
    """Packaged tracks without a fingerprint (all with ``force``)."""
    return tracks.where(packaged() & (F.lit(force) | F.col("audio_fingerprint").isNull()))


def fingerprinted(tracks: DataFrame) -> DataFrame:
    """Packaged tracks with a fingerprint that are not marked as duplicates."""
    return tracks.where(packaged() & F.col("audio_fingerprint").isNotNull() & F.col("dup_of").isNull())


def publishable(tracks: DataFrame) -> DataFrame:
    """``(waiting, ready)``: how many packaged tracks wait for duplicate detection; any forbids publishing."""
    return to_fingerprint(tracks).agg(F.count("*").alias("waiting")).withColumn("ready", F.col("waiting") == 0)


def upload_order(tracks: DataFrame) -> DataFrame:
    """Canonical packaged files in the order of upload."""
    return tracks.where(playable()).orderBy("id")


def work_tracks(tracks: DataFrame, key: str, limit: int) -> DataFrame:
    """The playable tracks of a work, or of a title for a key ``title:...``, by movement.

    The key alone counts, so a title's tracks come from all sources. A NULL title has no key.
    """
    part = F.lit(key)
    at = key_parts(part)
    hit = F.col("title").eqNullSafe(at["title"]) if key.startswith("title:") else F.col("work_id") == at["work_id"]
    return tracks.where(playable() & hit).orderBy("movement_index", nocase(F.col("title")), "id").limit(limit)


def listed(tracks: DataFrame, limit: int, work: str = "work") -> DataFrame:
    """Playable tracks by source, composer, work and title; ``work`` names the column that orders works."""
    return tracks.where(playable()).orderBy("source", "composer", work, "title", "id").limit(limit)


def all_tracks(tracks: DataFrame, limit: int) -> DataFrame:
    """All tracks by title, ASCII letters of any case alike."""
    return tracks.orderBy(nocase(F.col("title")), "created_at", "id").limit(limit)


def typed_search(tracks: DataFrame, postings: DataFrame, typed: str, playable_only: bool, limit: int, dialect: str = "ascii", work: str = "work") -> DataFrame:
    """The tracks that a typed query finds, best first; an empty query lists tracks instead."""
    terms = match_terms(typed, dialect)
    if not terms:
        return listed(tracks, limit, work) if playable_only else all_tracks(tracks, limit)
    hits = search(postings, "id", terms, limit, tracks.where(playable()) if playable_only else None)
    return tracks.join(hits, "id").orderBy(F.desc("score"), "id").drop("score")


def worker_register(events: DataFrame, by: str, at: Column) -> DataFrame:
    """The latest event of each worker: one aggregation of structs; ties by the whole event."""
    rest = [c for c in events.columns if c != by]
    return events.groupBy(by).agg(F.max(F.struct(at.alias("__at"), *rest)).alias("e")).select(by, *[F.col(f"e.{c}").alias(c) for c in rest])
