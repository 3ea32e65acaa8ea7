"""Queries of rules, lists, candidates and categories over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaverlake.functions import rules as R
from quaverlake.functions import text as X
from quaverlake.operators import candidates, dedup, listing
from quaverlake.operators import search as S
from quaverlake.plans.catalogue import _LOW, _T, PLAY, tracks
from quaverlake.session import current, cut, table
from quaverlake.sources import landed, registry

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: A moment amid the tables' times, for what depends on the present.
NOW = 1_700_000_000


# --- scans and sources

_KINDS = dict(c.split() for c in listing.TRACKS.split(", "))
_ZERO = {"string": "''", "boolean": "false", "double": "0::double", "int": "0::int", "bigint": "0::bigint"}


@query(_T + "select " + ", ".join(f"coalesce({c}, {_ZERO[_KINDS[c]]}) as {c}" for c in listing.TRACK_COLS) + " from t")
def s1_s2_full_rows(spark, sf):
    """Every track as a full row, from a catalogue opened with its schema."""
    return listing.full_rows(current(listing.open_catalogue(spark, f"{sf}/tracks.parquet")))


@query(_T + "select id, source, title, status from t where id = (select max(id) from tracks)")
def s3_lookup(spark, sf):
    last = table(spark, sf, "tracks").agg(F.max("id")).first()[0]
    return current(listing.lookup(table(spark, sf, "tracks"), last or ""), "source", "title", "status").select("id", "source", "title", "status")


@query(
    "select ord::int as ord, key, provider, mode from (values "
    "(0, 'chopin', 'ia', 'item'), (1, 'bach_wtc1', 'ia', 'item'), (2, 'goldberg', 'ia', 'item'), (3, 'beethoven_pitman', 'commons', 'search'), (4, 'marine', 'commons', 'search'), (5, 'army', 'commons', 'search'), "
    "(6, 'navy', 'commons', 'search'), (7, 'airforce', 'commons', 'search'), (8, 'coastguard', 'commons', 'search'), (9, 'spaceforce', 'commons', 'search'), (10, 'commons_classical', 'commons', 'classical_categories')) v(ord, key, provider, mode)"
)
def s17_registry(spark, sf):
    return registry.registry(spark).where(F.col("key").isin(registry.resolve(["all"])))


_ARCHIVE = _T + """, d as (select id, coalesce(source_item, '') as item, title as t, performer as pf, original_format as f, original_bytes as b, date_raw, license_url as l from t),
    e as (select *, case lower(trim(f)) when 'ogg vorbis' then 'ogg' when 'vbr mp3' then 'mp3' when 'mp3' then 'mp3' when '128kbps mp3' then 'mp3' when '64kbps mp3' then 'mp3' when 'opus' then 'opus' when 'ogg opus' then 'opus' when 'wave' then 'wav' when 'wav' then 'wav' when 'apple lossless audio' then 'other' when 'flac' then 'flac' else '' end as fmt from d),
    g as (select item as source_item, lower(id) as work_key, coalesce(nullif(trim(t), ''), id) as title, trim(coalesce(pf, '')) as performer,
      coalesce(try_cast(nullif(regexp_extract(date_raw, '(1[0-9]{3}|20[0-9]{2}|2100)', 1), '') as int), 0) as year,
      case when coalesce(l, '') = '' then '' when contains(l, 'publicdomain/zero') then 'CC0' when contains(l, 'publicdomain/mark') then 'Public domain' when contains(l, '/by-sa/') then 'CC BY-SA' when contains(l, '/by/') then 'CC BY' else 'see license url' end as license_short, fmt, id,
      case when fmt <> '' then coalesce(b, 0) end as own_bytes from e)
    """


def _archive(spark, sf):
    """Archive item documents, one for each track: its file, an MP3 made from it, and a text that is no audio."""
    t = tracks(spark, sf, "source_item", "title", "performer", "date_raw", "original_format", "original_bytes", "license_url")
    name = lambda end: F.concat("id", F.lit(end)).alias("name")
    file = lambda end, fmt, size: F.struct(name(end), fmt.alias("format"), size.alias("size"), "title", F.lit("1").alias("track"), F.col("performer").alias("artist"), F.lit("").alias("album"))
    files = F.array(file(".dat", F.col("original_format"), F.col("original_bytes").cast("string")), file(".mp3", F.lit("VBR MP3"), F.lit("1000")), file("_meta.xml", F.lit("Metadata"), F.lit("9")))
    item = F.struct(F.coalesce("source_item", F.lit("")).alias("identifier"), "title", F.lit("").alias("creator"), F.col("date_raw").alias("date"), F.col("license_url").alias("licenseurl"))
    doc = t.select(F.to_json(F.struct(item.alias("metadata"), files.alias("files"))).alias("doc"))
    return landed.archive_files(doc, "doc")


@query(_ARCHIVE + "select source_item, 0 as ord, work_key, title, performer, year, fmt as format, own_bytes as bytes, license_short from g where fmt <> '' union all select source_item, 1, work_key, title, performer, year, 'mp3', 1000, license_short from g")
def s4_archive_files(spark, sf):
    """Every audio file of the documents."""
    return _archive(spark, sf).select("source_item", "ord", "work_key", "title", "performer", "year", "format", "bytes", "license_short")


def _candidates(spark, sf):
    f = _archive(spark, sf).withColumn("source", F.lit("vellum"))
    file = {"url": F.col("url"), "format": F.col("format"), "bytes": F.col("bytes")}
    return candidates.group_variants(f, ["source", "source_item", "work_key"], ["ord"], file, ["title", "performer", "year", "license_short", "license_url"])


@query(_ARCHIVE + "select source_item, work_key, title, (1 + (fmt <> '')::int)::int as variants, case when fmt <> '' then fmt || ',mp3' else 'mp3' end as formats from g")
def a8_variants(spark, sf):
    """Files grouped into recordings, in order, with the first file's title."""
    c = _candidates(spark, sf)
    return c.select("source_item", "work_key", "title", F.size("files").alias("variants"), F.array_join(F.transform("files", lambda f: f["format"]), ",").alias("formats"))


_BEST = "case when fmt in ('flac', 'wav') then fmt when fmt = 'ogg' then 'ogg' when fmt = '' then 'mp3' else fmt end"


@query(_ARCHIVE + "select source_item, id as title_id, case when fmt in ('opus', 'ogg', 'wav') then fmt when fmt = '' or fmt = 'mp3' or fmt = 'flac' or fmt = 'other' then 'mp3' end as original_format, case when fmt in ('opus', 'ogg', 'wav', 'mp3') then own_bytes else 1000 end as original_bytes, case when license_short = '' then 'license not allowed' end as stage_error, case when license_short = '' then 'skipped' else 'discovered' end as status from g")
def g9_ingest(spark, sf):
    """Recordings as tracks to be: the preferred file of each, those without a licence skipped."""
    rows = candidates.ingest(_candidates(spark, sf), ["opus", "ogg", "wav", "mp3"], False, F.col("license_short") != "")
    return rows.select("source_item", F.upper("work_key").alias("title_id"), "original_format", "original_bytes", "stage_error", "status")


@query(_T + "select id, case lower(trim(original_format)) when 'wav' then id || '.wav' when 'flac' then id || '.flac' else id || '.mp3' end as best from t where original_format is not null")
def w1_select_best(spark, sf):
    """The best of three files of each track with fallback: its own, an AAC and an MP3."""
    t = tracks(spark, sf, "original_format").where("original_format is not null")
    own = F.lower(F.trim("original_format"))
    f = lambda end, fmt: F.struct(F.concat("id", F.lit("."), end).alias("url"), fmt.alias("format"))
    files = F.array(f(own, own), f(F.lit("aac"), F.lit("AAC")), f(F.lit("mp3"), F.lit("Mp3")))
    return t.select("id", candidates.select_best(files, ["wav", "flac", "mp3"], True)["url"].alias("best"))


_IMG = _T + """, i as (select id, coalesce(composer, '') as c, case when opus_path is not null then 'audio/ogg' when caf_path is not null then 'audio/midi' when original_format = 'flac' then 'application/octet-stream' else 'video/webm' end as mime, '.' || case when original_format in ('flac', 'ogg', 'mp3', 'wav', 'opus') then original_format else 'bin' end as ext, coalesce(original_bytes, 0) as b, coalesce(date_raw, '') as d, performer from t) """


def _images(spark, sf, classical):
    """Image-info documents, one page for each track."""
    t = tracks(spark, sf, "opus_path", "caf_path", "original_format", "original_bytes", "date_raw", "performer")
    fmt = F.col("original_format")
    mime = F.when(F.col("opus_path").isNotNull(), "audio/ogg").when(F.col("caf_path").isNotNull(), "audio/midi").when(fmt == "flac", "application/octet-stream").otherwise("video/webm")
    ext = F.when(fmt.isin("flac", "ogg", "mp3", "wav", "opus"), fmt).otherwise("bin")
    text = lambda c: F.struct(F.coalesce(F.col(c), F.lit("")).alias("value"))
    info = F.struct(F.concat(F.lit("https://files.example/"), "id").alias("url"), mime.alias("mime"), F.coalesce("original_bytes", F.lit(0)).alias("size"), F.create_map(F.lit("DateTimeOriginal"), text("date_raw")).alias("extmetadata"))
    page = F.struct(F.concat(F.lit("File:"), "id", F.lit("."), ext).alias("title"), F.array(info).alias("imageinfo"))
    doc = t.select(F.to_json(F.struct(F.struct(F.create_map(F.col("id"), page).alias("pages")).alias("query"))).alias("doc"))
    return landed.image_files(doc, "doc", classical)


_YEAR = "coalesce(try_cast(nullif(regexp_extract(d, '(1[0-9]{3}|20[0-9]{2}|2100)', 1), '') as int), 0)"


@query(_IMG + f"select 'File:' || id || ext as source_item, lower(id) as work_key, case when mime = 'audio/ogg' and ext = '.opus' then 'opus' when mime = 'audio/ogg' then 'ogg' else 'other' end as format, b as bytes, {_YEAR} as year from i where mime like 'audio/%'")
def s5_image_files(spark, sf):
    """Every audio file page of the documents."""
    return _images(spark, sf, False).select("source_item", "work_key", "format", "bytes", "year")


@query(
    _IMG
    + """select trim(c, ' ') as composer, 'File:' || id || ext as source_item, 'Category:Audio files of music by ' || c || case when md5(id) < '8' then '' else ' played by the House Band' end as via, case when md5(id) < '8' then '' else 'the House Band' end as performer,
    case when mime = 'audio/ogg' and ext = '.opus' then 'opus' when mime = 'audio/ogg' then 'ogg' when mime = 'audio/midi' then 'other' else substr(ext, 2) end as format from i
    where mime like 'audio/%' and mime <> 'audio/midi' or ext <> '.bin'"""
)
def s6_category_files(spark, sf):
    """Files found below the categories of all composers; half of them stand in a subcategory that names a
    performer. The categories also hold rings and categories to skip."""
    t = tracks(spark, sf, "composer", "original_format").select("id", F.coalesce("composer", F.lit("")).alias("c"), "original_format")
    fmt = F.col("original_format")
    file = F.concat(F.lit("File:"), "id", F.lit("."), F.when(fmt.isin("flac", "ogg", "mp3", "wav", "opus"), fmt).otherwise("bin"))
    top = F.concat(F.lit("Category:Audio files of music by "), "c")
    below = F.concat(top, F.lit(" played by the House Band"))
    link = lambda parent, child, leaf: F.struct(parent.alias("parent"), child.alias("child"), F.lit(leaf).alias("leaf"))
    own = F.when(F.md5("id") < "8", top).otherwise(below)
    skipped = F.concat(top, F.lit(" (midi files)"))
    edges = t.select(F.inline(F.array(link(F.lit(None).cast("string"), top, False), link(top, below, False), link(below, top, False), link(top, skipped, False), link(skipped, F.concat(file, F.lit(".not")), True), link(own, file, True)))).distinct()
    found = landed.category_files(edges, _images(spark, sf, True), 3, ["MIDI files"])
    return found.select("composer", "source_item", "via", "performer", "format")


# --- lists


@query(_T + f"select id, created_at from t where status = 'discovered' and (next_attempt_at is null or next_attempt_at <= {NOW}) order by created_at, id limit 50")
def f3_j8_o6_oldest(spark, sf):
    """The 50 oldest tracks that may be taken up."""
    return listing.oldest(tracks(spark, sf, "status", "next_attempt_at", "created_at"), "discovered", F.lit(NOW), 50).select("id", "created_at")


@query(_T + "select id, created_at from t where status = 'done' and enriched_at is null")
def f6_to_enrich(spark, sf):
    return listing.to_enrich(tracks(spark, sf, "status", "enriched_at", "created_at")).select("id", "created_at")


@query(_T + "select id, audio_fingerprint is null as todo from t where status = 'done' and caf_path is not null and (audio_fingerprint is null or dup_of is null)")
def f7_fingerprint_sets(spark, sf):
    """What is still to be fingerprinted, and what has been."""
    t = cut(tracks(spark, sf, "audio_fingerprint", *PLAY))
    return listing.to_fingerprint(t).select("id", F.lit(True).alias("todo")).unionByName(listing.fingerprinted(t).select("id", F.lit(False).alias("todo")))


@query(_T + "select count(*) as waiting, count(*) = 0 as ready from t where status = 'done' and caf_path is not null and audio_fingerprint is null")
def a11_publish_gate(spark, sf):
    return listing.publishable(tracks(spark, sf, "audio_fingerprint", *PLAY))


@query(_T + "select id, caf_path from p order by id")
def o7_upload_order(spark, sf):
    return listing.upload_order(tracks(spark, sf, *PLAY)).select("id", "caf_path")


@query(_T + f", k as (select max(work_id) as w, max(title) as ti from p) select id, title, movement_index, 'work' as by from (select p.* from p, k where work_id = w order by movement_index nulls first, {_LOW.format('title')} nulls first, id limit 500) union all select id, title, movement_index, 'title' from (select p.* from p, k where title = ti order by movement_index nulls first, {_LOW.format('title')} nulls first, id limit 500)")
def o4_x43_work_tracks(spark, sf):
    """The tracks of one work, and those of one title, by their browse keys."""
    t = cut(tracks(spark, sf, "title", "movement_index", "work_id", *PLAY))
    last = t.where(listing.playable()).agg(F.max("work_id"), F.max("title")).first()
    of = lambda key, by: listing.work_tracks(t, key, 500).select("id", "title", "movement_index", F.lit(by).alias("by"))
    return of(last[0] or "", "work").unionByName(of(f"title:{last[1]}", "title"))


@query(_T + f"(select id, 'playable' as list from p order by source nulls first, composer nulls first, work_title nulls first, title nulls first, id limit 200) union all (select id, 'all' from t order by {_LOW.format('title')} nulls first, created_at, id limit 200)")
def ft4_o5_empty_search(spark, sf):
    """What an empty query lists: playable tracks by work title, or all."""
    t = cut(tracks(spark, sf, "source", "composer", "work_title", "title", "created_at", *PLAY))
    ask = lambda only, name: listing.typed_search(t, None, " ?! ", only, 200, work="work_title").select("id", F.lit(name).alias("list"))
    return ask(True, "playable").unionByName(ask(False, "all"))


@query("select source, stage, track_id, completed, ts from (select *, row_number() over (partition by source order by ts desc, stage desc, track_id desc nulls last, completed desc nulls last) as k from progress) where k = 1")
def t11_latest_activity(spark, sf):
    """The latest event of each source, as a register of workers keeps it."""
    e = table(spark, sf, "progress").select("source", "stage", "track_id", "completed", "ts")
    return listing.worker_register(e, "source", F.col("ts"))


# --- rules over every track


@query(
    _T
    + """select id, coalesce(starts_with(lower(stage_error), 'http'), false) as http, coalesce(stage_error in ('http 429', 'http 403'), false) as limited, coalesce(stage_error in ('http 429', 'http 403') or starts_with(stage_error, 'http 5'), false) as again,
    coalesce(try_cast(regexp_extract(stage_error, 'http ([0-9]+)', 1) as int) = 429 or try_cast(regexp_extract(stage_error, 'http ([0-9]+)', 1) as int) >= 500, false) as model_again from t"""
)
def f5_f15_f19_errors(spark, sf):
    e = F.col("stage_error")
    code = X.blank_to_null(F.regexp_extract(e, "http ([0-9]+)", 1)).try_cast("int")
    return tracks(spark, sf, "stage_error").select("id", F.coalesce(R.like_prefix(e, "HTTP"), F.lit(False)).alias("http"), R.rate_limited(e).alias("limited"), R.retryable(e).alias("again"), R.retryable_status(code).alias("model_again"))


@query(_T + "select id, coalesce(lower(trim(original_format)) in ('opus', 'ogg', 'wav', 'mp3', 'flac', 'm4a', 'aac', 'oga', 'other'), false) as audio, regexp_matches(lower(original_url), '[.](opus|ogg|oga|flac|wav|mp3)$') as audio_file from t where original_url is not null and original_url <> ''")
def f10_f14_f17_audio(spark, sf):
    t = tracks(spark, sf, "original_format", "original_url").where(X.blank_to_null(F.col("original_url")).isNotNull())
    return t.select("id", R.audio_format(F.trim("original_format")).alias("audio"), R.audio_mime(F.lit(None).cast("string"), F.col("original_url")).alias("audio_file"))


_LIC = "case when regexp_matches(l, 'cc0|publicdomain/zero') then 4 when regexp_matches(l, 'public domain|publicdomain|pd') then 3 when l like '%by-sa%' then 1 when l like '%by%' then 2 else 0 end"


@query(_T + f"select license_short, license_url, {_LIC} as rank, case when coalesce(license_url, '') = '' then '' when contains(lower(license_url), 'publicdomain/zero') then 'CC0' when contains(lower(license_url), 'publicdomain/mark') then 'Public domain' when contains(lower(license_url), '/by-sa/') then 'CC BY-SA' when contains(lower(license_url), '/by/') then 'CC BY' else 'see license url' end as name, count(*) as n from (select *, lower(coalesce(license_short, '') || ' ' || coalesce(license_url, '')) as l from t) group by all")
def x18_x19_licences(spark, sf):
    t = tracks(spark, sf, "license_short", "license_url")
    return t.groupBy("license_short", "license_url").agg(F.count("*").alias("n")).select("license_short", "license_url", R.license_rank(F.col("license_short"), F.col("license_url")).alias("rank"), R.license_name(F.col("license_url")).alias("name"), "n")


@query("select source, trust, case source when 'vellum_archive' then 60 when 'open_harbour' then 20 else 10 end as rank from source_trust")
def x20_source_ranks(spark, sf):
    return table(spark, sf, "source_trust").select("source", "trust", R.source_rank(F.col("source"), {"vellum_archive": 60, "open_harbour": 20}).alias("rank"))


@query(_T + "select id, coalesce(nullif(title, ''), nullif(work, ''), source_item, '') as label, '/data/' || id || '.src.' || case when original_format in ('ogg', 'opus', 'wav', 'mp3', 'flac', 'oga') then original_format else 'dat' end as src, '/data/' || id || '.opus' as opus, '/data/' || id || '.caf' as caf from t")
def x24_x29_paths(spark, sf):
    t = tracks(spark, sf, "title", "work", "source_item", "original_format")
    return t.select("id", R.worker_label().alias("label"), R.artefact_paths("/data", F.col("id"), F.col("original_format")).alias("p")).select("id", "label", "p.*")


_SIZE = "case when {0} < 1024 then {0} || 'B' when {0} < 1048576 then printf('%.1fKB', {0} / 1024.0) when {0} < 1073741824 then printf('%.1fMB', {0} / 1048576.0) else printf('%.1fGB', {0} / 1073741824.0) end"


@query(_T + f"select id, case status when 'done' then '●' when 'failed' then '✗' when 'skipped' then '·' when 'discovered' then '○' else '◐' end || substring(status, 1, 4) as state, case when status = 'done' then 'opus ' || {_SIZE.format('coalesce(opus_bytes, 0)')} || ' caf ' || {_SIZE.format('coalesce(caf_bytes, 0)')} else '' end as size, rpad(coalesce(source, ''), 12, ' ') as source from t")
def x27_x36_cells(spark, sf):
    t = tracks(spark, sf, "status", "opus_bytes", "caf_bytes", "source")
    return t.select("id", R.status_cell(F.col("status")).alias("state"), R.size_cell(F.col("status"), F.col("opus_bytes"), F.col("caf_bytes")).alias("size"), R.padded(F.col("source"), 12).alias("source"))


@query("select source, '{\"i\":' || coalesce(total_known, 0) || '}' as cursor, coalesce(total_known, 0) as back, coalesce(try_cast(last_cursor as bigint), (try_cast(last_cursor as json) ->> '$.i')::bigint, 0) as stored from source_state")
def x37_cursors(spark, sf):
    """Cursors written and read back, and the stored ones read."""
    c = R.encode_cursor(F.col("total_known"))
    return table(spark, sf, "source_state").select("source", c.alias("cursor"), R.decode_cursor(c).alias("back"), R.decode_cursor(F.col("last_cursor")).alias("stored"))


@query(_T + "select id, 'exact:' || coalesce(caf_bytes, 0) || ':' || trunc(coalesce(duration_sec, 0))::bigint || ':' || coalesce(original_sha1, '') as signature, 'https://media.example/audio/' || id || '.caf' as url from t")
def x39_x48_s16_all_signatures(spark, sf):
    """The signature and URL of every track, missing parts too."""
    t = tracks(spark, sf, "caf_bytes", "duration_sec", "original_sha1")
    return t.select("id", R.exact_signature(F.col("caf_bytes"), F.col("duration_sec"), F.col("original_sha1")).alias("signature"), R.audio_url("https://media.example", F.col("id")).alias("url"))


@query(
    _T
    + """, f as (select id, nullif(opus_path, '') as o, nullif(caf_path, '') as c, coalesce(opus_bytes > 0, false) as ot, coalesce(caf_bytes > 0, false) as ct, original_url as u from t)
    select id, coalesce(case when ot then o end, case when ct then c end, o, c, '') as beep, coalesce(case when ct then c end, o, c, '') as afplay, coalesce(o, c, '') as other, u || '?X-Amz-Signature=REDACTED&part=1&X-Amz-Credential=REDACTED' as masked from f"""
)
def x41_x42_playback(spark, sf):
    """The file each player takes, and a signed URL as it may be shown."""
    t = tracks(spark, sf, "original_url", "opus_path", "opus_bytes", "caf_path", "caf_bytes")
    there = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    path = lambda b: R.playback_path(b, F.col("opus_path"), F.col("caf_path"), there("opus_bytes"), there("caf_bytes"))
    signed = F.concat("original_url", F.lit("?X-Amz-Signature="), F.md5("id"), F.lit("&part=1&X-Amz-Credential="), "id")
    return t.select("id", path("beep").alias("beep"), path("afplay").alias("afplay"), path("ffplay").alias("other"), R.masked_url(signed).alias("masked"))


# --- duplicates: tracks and copies of them under other ids, some longer, some without checksum


def with_copies(t):
    """The tracks and a copy of each: 0 to 4 seconds longer, every second one without checksum or package."""
    odd = F.col("created_at") % 2 == 1
    copy = t.withColumn("id", F.concat(F.lit("Z"), "id")).withColumn("duration_sec", F.col("duration_sec") + F.col("created_at") % 5)
    copy = copy.withColumn("original_sha1", F.when(~odd, F.col("original_sha1"))).withColumn("caf_bytes", F.col("caf_bytes") + 1)
    return t.unionByName(copy)


_COPIES = _T + """, b as (select id, source, duration_sec, original_sha1, audio_fingerprint, license_short, license_url, caf_bytes from p
    union all select 'Z' || id, source, duration_sec + created_at % 5, case when created_at % 2 = 0 then original_sha1 end, audio_fingerprint, license_short, license_url, caf_bytes + 1 from p)"""
_COLS = ("source", "duration_sec", "original_sha1", "audio_fingerprint", "license_short", "license_url", "caf_bytes", "created_at")


def _copies(spark, sf):
    return cut(with_copies(tracks(spark, sf, *_COLS, *PLAY).where(listing.playable())).drop("created_at"))


@query(_COPIES + " select a.id as id_a, c.id as id_b from b a join b c on a.original_sha1 = c.original_sha1 and a.id < c.id and abs(a.duration_sec - c.duration_sec) <= 3.0 where a.original_sha1 <> ''")
def j5_range_join(spark, sf):
    """Tracks and copies of equal checksum whose durations are within three seconds."""
    t = _copies(spark, sf).where("original_sha1 <> ''")
    return dedup.range_pairs(t, "id", "duration_sec", 3.0, same="original_sha1").select("id_a", "id_b")


_MATCH = (
    _COPIES
    + """, s as (select id, source, coalesce(duration_sec, 0) as d, nullif(original_sha1, '') as sha, coalesce(nullif(audio_fingerprint, ''), 'exact:' || coalesce(caf_bytes, 0) || ':' || trunc(coalesce(duration_sec, 0))::bigint || ':' || coalesce(original_sha1, '')) as fp, lower(coalesce(license_short, '') || ' ' || coalesce(license_url, '')) as l, coalesce(caf_bytes, 0) as bytes from b),
    x as (select *, case when fp like 'exact:%' then [] else list_filter(list_transform(string_split(fp, ','), lambda v: try_cast(trim(v) as bigint)), lambda v: v between 0 and 4294967295) end as w from s),
    near as (select a.id as id_a, c.id as id_b, a.w as u, c.w as v, coalesce(a.sha = c.sha, false) or (a.fp like 'exact:%' and a.fp = c.fp) as same from x a join x c on a.id < c.id and abs(a.d - c.d) <= 3.0
      where coalesce(a.sha = c.sha, false) or (a.fp like 'exact:%' and a.fp = c.fp) or (len(a.w) >= 20 and len(c.w) >= 20)),
    off as (select *, greatest(0, -o) as lo, least(len(u), len(v) - o) as hi from near, (select unnest(range(-12, 13)) as o) where not same),
    heard as (select distinct id_a, id_b from off where hi - lo >= 20 and list_sum(list_transform(range(lo, hi), lambda i: bit_count(xor(u[i + 1], v[i + o + 1])))) <= 0.2 * 32 * (hi - lo)),
    pairs as (select id_a, id_b from near where same union select id_a, id_b from heard),
    arcs as (select id_a as v, id_b as w from pairs union all select id_b, id_a from pairs),
    reach(v, w) as (select v, w from arcs union select r.v, a.w from reach r join arcs a on a.v = r.w),
    root as (select v as id, least(v, min(w)) as root from reach group by v),
    pick as (select root.id, root, first_value(root.id) over (partition by root order by """
    + _LIC
    + """ desc, bytes desc, root.id) as canonical from root join s using (id))
    """
)
_MATCH = _MATCH.replace("with t as", "with recursive t as", 1)


def _marked(spark, sf):
    t = cut(dedup.signed(_copies(spark, sf)))
    return dedup.marked_duplicates(t, cut(dedup.closure(dedup.duplicate_pairs(t))))


@query(_MATCH + "select id, canonical as dup_of from pick where id <> canonical")
def g6_duplicates(spark, sf):
    """Every duplicate among tracks and copies with the one that stays: signatures, links by equality and by
    bit errors, closure, choice by licence, source, size and id (the sources here all have one rank)."""
    return _marked(spark, sf).where("dup_of is not null").select("id", "dup_of")


@query(_MATCH + "select count(distinct root) as clusters, count(*) filter (where id <> canonical) as duplicates from pick")
def a13_cluster_summary(spark, sf):
    return dedup.cluster_summary(_marked(spark, sf))


@query(_T + f"select original_sha1 as sha, id as canonical from (select *, lower(coalesce(license_short, '') || ' ' || coalesce(license_url, '')) as l from t where original_sha1 is not null) qualify row_number() over (partition by original_sha1 order by {_LIC} desc, case source when 'vellum_archive' then 60 when 'isle_choirs' then 20 else 10 end desc, coalesce(caf_bytes, 0) desc, id) = 1")
def w2_canonical(spark, sf):
    """Of tracks with one checksum the one with the freest licence, most trusted source, largest file, smallest id."""
    t = tracks(spark, sf, "source", "original_sha1", "license_short", "license_url", "caf_bytes").where("original_sha1 is not null")
    ranks = {"vellum_archive": 60, "isle_choirs": 20}
    return dedup.canonical(t.withColumnRenamed("original_sha1", "sha"), "sha", R.license_rank(F.col("license_short"), F.col("license_url")), R.source_rank(F.col("source"), ranks), F.coalesce("caf_bytes", F.lit(0)))


# --- search over tracks

_FOLD = "list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: length(w) >= 2)))"


@query(
    "with recursive x as (select doc_id as id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(source), '[^a-z0-9]+'), lambda w: length(w) >= 2))) as term from documents where source is not null), "
    "dl as (select id, count(*) as dl from x group by id), h as (select id, count(*) as f from x where starts_with(term, 'note') group by id), s as (select count(*) as n, avg(dl) as mean from dl), d as (select count(*) as df from h) "
    "select id, round(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 9) as score from h join dl using (id), s, d"
)
def j1_o3_source_search(spark, sf):
    """Documents whose source has a word that begins so, ranked, from an index kept sorted by term."""
    d = table(spark, sf, "documents").where("source is not null").select(F.col("doc_id").alias("id"), "source")
    return S.search(S.built(S.index(d, "id", X.keywords(F.col("source"))), "id"), "id", ["note"]).select("id", F.round("score", 9).alias("score"))
