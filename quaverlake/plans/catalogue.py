"""Queries of the catalogue's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions import text as X
from quaverlake.operators import catalogue as C
from quaverlake.operators import graph, rates
from quaverlake.operators import search as S
from quaverlake.session import current, cut, table
from quaverlake.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_T = "with t as (select * from tracks qualify row_number() over (partition by id order by updated_at desc) = 1), p as (select * from t where status = 'done' and caf_path is not null and dup_of is null) "
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tracks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return current(table(spark, sf, "tracks"), *cols)


_KEY = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
_WORK_ID = "case when coalesce({0}, '') <> '' and coalesce({1}, '') <> '' then sha1(concat_ws('|', {0}, {1}, nullif({2}, ''))) end".format(*[_KEY.format(c) for c in ("composer_canonical", "work_title", "catalog")])

PLAY = ("status", "caf_path", "dup_of")


# --- browsing and counts


@query(_T + "select source as name, source as key, count(*) as n from p group by source")
def a3_browse_sources(spark, sf):
    return C.browse(tracks(spark, sf, "source", *PLAY), "source")


@query(_T + "select coalesce(nullif(composer, ''), '—') as name, coalesce(composer, '') as key, count(*) as n from p where source = 'vellum_archive' group by coalesce(composer, ''), 1")
def a4_browse_composers(spark, sf):
    return C.browse(tracks(spark, sf, "source", "composer", *PLAY), "composer", source="vellum_archive")


@query(_T + f"select coalesce(nullif(min(coalesce(title, '')), ''), '—') as name, min(coalesce(title, '')) as key, count(*) as n from p where source = 'vellum_archive' and nullif(composer, '') is not distinct from null group by {_LOW.format("coalesce(title, '')")}")
def a5_browse_titles(spark, sf):
    return C.browse(tracks(spark, sf, "source", "composer", "title", *PLAY), "title", source="vellum_archive", composer="")


@query(
    _T
    + """select source, nullif(composer, '') as composer, coalesce(work_id, 'title:' || p.title) as key, coalesce(arg_min(coalesce(w.title, work_title, p.title), p.id), '—') as name,
    arg_min(coalesce(w.sort_key, work_title, p.title), p.id) as sort_key, count(*) as n from p left join works w on w.id = p.work_id group by 1, 2, 3"""
)
def a6_browse_works(spark, sf):
    return C.browse_works(tracks(spark, sf, "source", "composer", "title", "work_id", "work_title", *PLAY), table(spark, sf, "works"))


@query(_T + "select source, status, count(*) as n from t group by all")
def a1_status_counts(spark, sf):
    return tracks(spark, sf, "source", "status").groupBy("source", "status").agg(F.count("*").alias("n"))


@query(_T + "select status, count(*) as n from t where status not in ('done', 'failed', 'skipped') group by status")
def a2_pending(spark, sf):
    return tracks(spark, sf, "status").where(~F.col("status").isin("done", "failed", "skipped")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    _T
    + """, r as (select *, list_position(['discovered','downloading','downloaded','converting','converted','packaging','packaged','cleaning','done'], status) - 1 as k from t)
    select source, count(*) filter (status <> 'skipped') as found, count(*) filter (k >= 2) as downloaded, count(*) filter (k >= 4) as converted, count(*) filter (k >= 6) as packaged,
    count(*) filter (k >= 8) as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'skipped') as skipped,
    coalesce(round(count(*) filter (k >= 8) * 100.0::double / nullif(count(*) filter (status <> 'skipped'), 0), 6), 0) as percent from r group by source""".replace("filter (", "filter (where ")
)
def a9_funnel(spark, sf):
    return C.funnel(tracks(spark, sf, "source", "status"))


@query(_T + "select count(*) as files, sum(opus_bytes)::bigint as bytes from p where opus_path is not null")
def a12_compact_totals(spark, sf):
    return tracks(spark, sf, "opus_path", "opus_bytes", *PLAY).where(C.playable() & F.col("opus_path").isNotNull()).agg(F.count("*").alias("files"), F.sum("opus_bytes").alias("bytes"))


@query(_T + "select count(distinct source) as sources, count(distinct coalesce(work_id, 'title:' || title)) as works, count(*) as tracks from p")
def a14_library_summary(spark, sf):
    return tracks(spark, sf, "source", "work_id", "title", *PLAY).where(C.playable()).agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.coalesce("work_id", F.concat(F.lit("title:"), "title"))).alias("works"), F.count("*").alias("tracks"))


@query(_T + "select title, min(id) as first_id, count(*) as n from t where title is not null group by title")
def a15_distinct_titles(spark, sf):
    return tracks(spark, sf, "title").where("title is not null").groupBy("title").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


# --- joins


@query(_T + "select t.id, w.title as listed_title, w.catalog as listed_catalog from t left join works w on w.id = t.work_id where t.work_id is not null")
def j2_tracks_works(spark, sf):
    w = table(spark, sf, "works").select(F.col("id").alias("work_id"), F.col("title").alias("listed_title"), F.col("catalog").alias("listed_catalog"))
    return tracks(spark, sf, "work_id").where("work_id is not null").join(w, "work_id", "left").select("id", "listed_title", "listed_catalog")


@query("select source, original_url, min(id) as id from tracks group by all")
def j3_insert_if_absent(spark, sf):
    """All tracks inserted into a table that already holds the finished ones, by source and URL."""
    t = table(spark, sf, "tracks").groupBy("source", "original_url").agg(F.min("id").alias("id"), F.max("status").alias("status"))
    t = cut(t)
    return C.insert_if_absent(t.select("source", "original_url", "id"), t.where("status = 'done'").select("source", "original_url", "id"), "source", "original_url")


@query(
    """with n as (select composer_canonical, count(*) as n, min(id) as first from works group by 1)
    select coalesce(w.id, n.first) as id, w.title, n.n as track_count, w.created_at from works w left join n on n.first = w.id where n.n is not null
    union all select w.id, w.title, w.track_count, w.created_at from works w anti join n on n.first = w.id"""
)
def j4_upsert(spark, sf):
    """Works whose track_count is renewed for the first of each composer; created_at stays."""
    w = table(spark, sf, "works").select("id", "title", "track_count", "created_at")
    n = table(spark, sf, "works").groupBy("composer_canonical").agg(F.min(F.struct("id", "title")).alias("f"), F.count("*").alias("track_count"))
    return C.upsert(n.select("f.id", "f.title", "track_count", F.lit(0).cast("bigint").alias("created_at")), w, "id", keep=("created_at",))




@query(_T + "select o.id, o.opus_bytes from t o where opus_path is not null and exists (select 1 from t c where c.caf_bytes > 0 and c.caf_path is not null and split_part(c.caf_path, '.', 1) = split_part(o.opus_path, '.', 1))")
def j6_sibling_files(spark, sf):
    t = tracks(spark, sf, "opus_path", "opus_bytes", "caf_path", "caf_bytes")
    stem = lambda c: F.split(c, r"\.")[0]
    cafs = t.where("caf_bytes > 0 and caf_path is not null").select(stem("caf_path").alias("stem"))
    return t.where("opus_path is not null").withColumn("stem", stem("opus_path")).join(cafs, "stem", "left_semi").select("id", "opus_bytes")


@query(_T + "select p.id, case when p.caf_bytes is null then 'missing' when s.bytes = p.caf_bytes then 'same' when s.bytes is null then 'upload' else 'replace' end as action from p left join (select id, caf_bytes - (duration_sec > 300)::int as bytes from t where status = 'done' and opus_bytes is not null) s on s.id = p.id")
def j7_upload_diff(spark, sf):
    """Packaged files against a remote inventory, here the files with opus bytes, long ones one byte short."""
    t = cut(tracks(spark, sf, "caf_bytes", "opus_bytes", "duration_sec", *PLAY))
    remote = t.where("status = 'done' and opus_bytes is not null").select("id", (F.col("caf_bytes") - F.when(F.col("duration_sec") > 300, 1).when(F.col("duration_sec").isNotNull(), 0)).alias("bytes"))
    act = F.when(F.col("caf_bytes").isNull(), "missing").when(F.col("bytes") == F.col("caf_bytes"), "same").when(F.col("bytes").isNull(), "upload").otherwise("replace")
    return t.where(C.playable()).join(remote, "id", "left").select("id", act.alias("action"))


@query("select d.doc_id from documents d where not exists (select 1 from works w where w.id = d.work_id)")
def j11_not_in(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "work_id").join(table(spark, sf, "works").select(F.col("id").alias("work_id")), "work_id", "left_anti").select("doc_id")


# --- ranking


_FMT = "case lower(trim(original_format)) when 'opus' then 0 when 'ogg' then 1 when 'wav' then 2 when 'mp3' then 3 when 'flac' then 4 else 5 end"


@query(_T + f"select source, title, count(*) as variants, arg_min(id, ({_FMT}) * 1000000000000 + created_at) as id from (select * from t where title is not null) group by source, title")
def w1_best_variant(spark, sf):
    t = tracks(spark, sf, "source", "title", "original_format", "created_at").where("title is not null")
    return C.best_variant(t, ["source", "title"], F.trim("original_format"), ["opus", "ogg", "wav", "mp3", "flac"], F.col("created_at")).select("source", "title", "variants", "id")




@query("with d as (select distinct * from progress), b as (select source, date_trunc('day', ts) as day, sum(completed::int) / 86400.0::double as v from d group by 1, 2) select source, round(list_reduce([0.0::double] || list(v order by day), lambda m, x: x * 0.2 + m * 0.8) * 86400, 6) as per_day from b group by source")
def w3_completion_ewma(spark, sf):
    d = table(spark, sf, "progress").distinct().groupBy("source", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg((F.count_if("completed") / 86400.0).alias("v"))
    return rates.ewma(d, "source", F.col("day"), F.col("v"), 0.2).select("source", F.round(F.col("ewma") * 86400, 6).alias("per_day"))


@query("with d as (select distinct * from progress), b as (select source, date_trunc('day', ts) as day, sum(coalesce(bytes_delta, 0))::double / 86400 / 1048576 as v from d group by 1, 2) select source, round(list_reduce([0.0::double] || list(v order by day), lambda m, x: x * 0.5 + m * 0.5), 9) as mb_per_sec from b group by source")
def w4_throughput_ewma(spark, sf):
    d = table(spark, sf, "progress").distinct().groupBy("source", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg((F.sum(F.coalesce("bytes_delta", F.lit(0))) / 86400.0 / 1048576).alias("v"))
    return rates.ewma(d, "source", F.col("day"), F.col("v"), 0.5).select("source", F.round("ewma", 9).alias("mb_per_sec"))


@query(
    _T
    + """, f as (select source, count(*) filter (where status <> 'skipped') - count(*) filter (where status in ('done', 'failed')) as open from t group by source),
    r as (select source, (count(*) filter (where completed)) / 86400.0::double as rate from (select distinct * from progress) group by source), e as (select f.source, open, rate, floor(open / rate)::bigint as s from f left join r using (source))
    select source, case when rate is null or rate <= 1e-9 then '--:--' when open <= 0 then '00:00' when s > 3596400 then '--:--' when s >= 3600 then printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end as eta from e"""
)
def w5_eta(spark, sf):
    """Time left per source at the rate of all completions in one day."""
    f = C.funnel(tracks(spark, sf, "source", "status"))
    r = table(spark, sf, "progress").distinct().groupBy("source").agg((F.count_if("completed") / 86400.0).alias("rate"))
    left = F.col("found") - F.col("done") - F.col("failed")
    eta = F.when(F.col("rate").isNull() | (F.col("rate") <= 1e-9), "--:--").when(left <= 0, "00:00").otherwise(X.clock(left / F.col("rate")))
    return f.join(r, "source", "left").select("source", eta.alias("eta"))


# --- sorts and limits: the limit is the feature


@query(_T + "select id, source, composer, work, title from p order by source nulls first, composer nulls first, work nulls first, title nulls first, id limit 200")
def o1_playable_list(spark, sf):
    t = tracks(spark, sf, "source", "composer", "work", "title", *PLAY).where(C.playable())
    return t.orderBy("source", "composer", "work", "title", "id").limit(200).select("id", "source", "composer", "work", "title")


@query(_T + f"select id, title from t order by {_LOW.format('title')} nulls first, created_at, id limit 500")
def o2_all_titles(spark, sf):
    return tracks(spark, sf, "title", "created_at").orderBy(X.nocase(F.col("title")), "created_at", "id").limit(500).select("id", "title")


@query(_T + "select id, title, movement_index from p where work_id is not null order by work_id, movement_index nulls first, title nulls first, id limit 200")
def o4_work_tracks(spark, sf):
    t = tracks(spark, sf, "title", "movement_index", "work_id", *PLAY).where(C.playable() & F.col("work_id").isNotNull())
    return t.orderBy("work_id", "movement_index", "title", "id").limit(200).select("id", "title", "movement_index")


@query(_T + "select id, stage_error from t where lower(stage_error) like 'http%' order by updated_at desc, id limit 256")
def o8_last_errors(spark, sf):
    return tracks(spark, sf, "stage_error", "updated_at").where(F.lower("stage_error").startswith("http")).orderBy(F.desc("updated_at"), "id").limit(256).select("id", "stage_error")


# --- text functions over whole tables


_BLANKS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_CLEAN = f"regexp_replace(translate(regexp_replace(regexp_replace(title, '^File:', ''), '\\.[^./]*\\z', ''), '_', ' '), '^{_BLANKS}+|{_BLANKS}+\\z', '', 'g')"


@query(f"select distinct title, {_CLEAN} as clean, trim(regexp_replace(lower(translate(regexp_replace({_CLEAN}, '(?i)[ _-]+(ogg|oga|opus|wav|wave|mp3|flac)\\z', ''), 'Σİ', 'σi')), '{_BLANKS}+', ' ', 'g')) as key from tracks where title is not null")
def x6_x7_titles(spark, sf):
    t = table(spark, sf, "tracks").where("title is not null").select("title").distinct()
    return t.select("title", X.clean_title(F.col("title")).alias("clean"), X.title_key(F.col("title")).alias("key"))


@query("select title, composer_canonical, trim(regexp_replace(strip_accents(lower(composer_canonical)), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) as composer_key, sha1(trim(regexp_replace(strip_accents(lower(composer_canonical)), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) || '|' || trim(regexp_replace(strip_accents(lower(title)), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) || '|' || trim(regexp_replace(strip_accents(lower(catalog)), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) as work_id from works")
def x9_x10_work_ids(spark, sf):
    c = F.col
    return table(spark, sf, "works").select("title", "composer_canonical", X.normalize_key(c("composer_canonical")).alias("composer_key"), X.work_id(c("composer_canonical"), c("title"), c("catalog")).alias("work_id"))


@query("select date_raw, coalesce(try_cast(nullif(regexp_extract(date_raw, '(1[0-9]{3}|20[0-9]{2}|2100)', 1), '') as int), 0) as year, count(*) as n from tracks where date_raw is not null group by all")
def x12_years(spark, sf):
    g = table(spark, sf, "tracks").where("date_raw is not null").groupBy("date_raw").agg(F.count("*").alias("n"))
    return g.select("date_raw", X.parse_year(F.col("date_raw")).alias("year"), "n")


@query(
    """with a as (select distinct title, trim(title) as t from tracks where title is not null), b as (select title, t, lower(regexp_extract(t, '^.+ - (.*?)$', 1)) as tail, trim(regexp_extract(t, '^(.+) - .*?$', 1)) as head from a),
    c as (select title, case when head <> '' and regexp_matches(tail, 'band|orchestra|performed|ensemble') then head else t end as t from b),
    d as (select title, t, trim(split_part(t, ',', 1)) as first, trim(regexp_extract(t, '^[^,]*,(.*)$', 1)) as rest from c),
    e as (select *, contains(t, ',') and len(list_filter(regexp_split_to_array(first, '""" + _BLANKS + """+'), lambda w: w <> '')) <= 2 and first <> '' and regexp_matches(first, '^[\\x00-\\x60\\x7B-\\x7F]') and not regexp_matches(first, '[0-9"]') as named from d),
    f as (select *, named and regexp_matches(rest, '^.+ - ') as split, trim(regexp_extract(rest, '^(.+) - .*?$', 1)) as w, trim(regexp_extract(rest, '^.+ - (.*?)$', 1)) as m from e)
    select title, case when named then first else '' end as composer, case when split then w when named then rest else t end as work, case when split then m else '' end as movement from f"""
)
def x13_title_parts(spark, sf):
    t = table(spark, sf, "tracks").where("title is not null").select("title").distinct()
    return t.select("title", X.parse_title(F.col("title")).alias("p")).select("title", "p.*")


@query("select original_format, case lower(trim(original_format)) when 'ogg vorbis' then 'ogg' when 'vbr mp3' then 'mp3' when 'mp3' then 'mp3' when '128kbps mp3' then 'mp3' when '64kbps mp3' then 'mp3' when 'opus' then 'opus' when 'ogg opus' then 'opus' when 'wave' then 'wav' when 'wav' then 'wav' when 'apple lossless audio' then 'other' when 'flac' then 'flac' else '' end as format, count(*) as n from tracks where original_format is not null group by all")
def x17_label_formats(spark, sf):
    g = table(spark, sf, "tracks").where("original_format is not null").groupBy("original_format").agg(F.count("*").alias("n"))
    return g.select("original_format", X.label_format(F.col("original_format")).alias("format"), "n")


@query(
    _T
    + """, d as (select id, coalesce(source, '') as source, coalesce(nullif(composer_canonical, ''), nullif(composer, '')) as c, coalesce(nullif(work_title, ''), nullif(work, '')) as w, nullif(catalog, '') as k, nullif(movement_title, '') as m,
    coalesce(nullif(title, ''), nullif(work, ''), nullif(source_item, ''), id) as raw from t), e as (select *, case when w is not null and k is not null and not contains(lower(w), lower(k)) then w || ', ' || k else w end as wk from d),
    g as (select *, nullif(concat_ws(' · ', wk, m), '') as body from e)
    select id, case when c is null and body is null then '[' || source || '] ' || raw else concat_ws(' — ', c, coalesce(body, raw)) end as global_label, coalesce(body, raw) as composer_label, coalesce(m, raw) as work_label from g"""
)
def x23_display_titles(spark, sf):
    t = tracks(spark, sf, "source", "composer", "composer_canonical", "work", "work_title", "catalog", "movement_title", "title", "source_item")
    return t.select("id", *[X.display_title(c).alias(f"{c}_label") for c in ("global", "composer", "work")])


@query(
    _T
    + """select id, case when b < 1024 then b || 'B' when b < 1048576 then printf('%.1fKB', b / 1024.0::double) when b < 1073741824 then printf('%.1fMB', b / 1048576.0::double) when b < 1099511627776 then printf('%.1fGB', b / 1073741824.0::double) when b is not null then printf('%.1fTB', b / 1099511627776.0::double) end as size,
    case when d is null or d < 0 or d > 3596400 then '--:--' when d >= 3600 then printf('%02d:%02d:%02d', trunc(d)::int // 3600, trunc(d)::int % 3600 // 60, trunc(d)::int % 60) else printf('%02d:%02d', trunc(d)::int // 60, trunc(d)::int % 60) end as clock from (select id, original_bytes as b, duration_sec as d from t)"""
)
def x25_x26_sizes(spark, sf):
    """Sizes and durations of every track: missing, negative and impossible ones too."""
    t = tracks(spark, sf, "original_bytes", "duration_sec")
    return t.select("id", X.human_bytes(F.col("original_bytes")).alias("size"), X.clock(F.col("duration_sec")).alias("clock"))


@query("select regexp_extract(original_url, '^[a-z]+://([^/]*)', 1) as host, count(*) as n from tracks group by 1")
def x28_hosts(spark, sf):
    return table(spark, sf, "tracks").groupBy(X.url_host(F.col("original_url")).alias("host")).agg(F.count("*").alias("n"))


@query("select (props::json ->> '$.k')::int as k, count(*) as n, round(sum(value), 6) as total from events group by 1")
def x33_json(spark, sf):
    e = table(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(_T + "select id, case when audio_fingerprint like 'exact:%' then 0 else len(list_filter(string_split(audio_fingerprint, ','), lambda x: try_cast(trim(x) as bigint) between 0 and 4294967295)) end as words, coalesce(list_sum(list_transform(case when audio_fingerprint like 'exact:%' then []::varchar[] else string_split(audio_fingerprint, ',') end, lambda x: bit_count(try_cast(trim(x) as bigint))))::bigint, 0) as bits from t where audio_fingerprint is not null")
def x38_fingerprints(spark, sf):
    t = tracks(spark, sf, "audio_fingerprint").where("audio_fingerprint is not null").select("id", X.fingerprint_words(F.col("audio_fingerprint")).alias("w"))
    return t.select("id", F.size("w").alias("words"), F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.bit_count(x).cast("bigint")).alias("bits"))


_ESCAPED = "url_encode('audio/' || title || '.caf')"
for _a, _b in (("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
    _ESCAPED = f"replace({_ESCAPED}, '{_a}', '{_b}')"


@query(f"select distinct title, {_ESCAPED} as object_key from tracks where title is not null")
def s14_object_keys(spark, sf):
    t = table(spark, sf, "tracks").where("title is not null").select("title").distinct()
    return t.select("title", X.path_escape(F.concat(F.lit("audio/"), F.col("title"), F.lit(".caf"))).alias("object_key"))


@query(_T + "select split_part(path, '.', 2) as kind, count(*) as files, sum(bytes)::bigint as bytes from (select opus_path as path, opus_bytes as bytes from t union all select caf_path, caf_bytes from t) where path is not null group by 1")
def s11_inventory(spark, sf):
    t = tracks(spark, sf, "opus_path", "opus_bytes", "caf_path", "caf_bytes").select(F.inline(F.array(F.struct(F.col("opus_path").alias("path"), F.col("opus_bytes").alias("bytes")), F.struct(F.col("caf_path").alias("path"), F.col("caf_bytes").alias("bytes")))))
    return t.where("path is not null").groupBy(F.split("path", r"\.")[1].alias("kind")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


# --- search

_TERMS = ["symph", "min", "op"]
_IX = """with d as (select id, list_sort(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', title, composer_canonical, catalog))), '[^\\p{L}\\p{Nd}]+'), lambda w: length(w) >= 2 and w not in ('a','an','and','are','as','at','be','but','by','for','from','had','has','have','he','her','his','in','into','is','it','its','of','on','or','that','the','their','then','there','these','they','this','to','was','were','will','with')))) as w from works), x as (select id, unnest(w) as term, len(w) as dl from d) """


def _index(spark, sf):
    w = table(spark, sf, "works")
    return S.index(w, "id", X.keywords(F.col("title"), F.col("composer_canonical"), F.col("catalog")))


@query(_IX + "select id, term, dl from x")
def ft1_index(spark, sf):
    return _index(spark, sf)


@query(
    _IX
    + """, q as (select unnest(['symph', 'min', 'op']) as q), h as (select id, q, count(*) as f, any_value(dl) as dl from x join q on starts_with(term, q) group by 1, 2), s as (select count(*) as n, avg(dl) as mean from (select distinct id, dl from x)),
    df as (select q, count(*) as df from h group by q), i as (select q, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end as idf from df, s)
    select id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))), 9) as score from h join i using (q), s group by id having count(*) = 3"""
)
def ft3_search(spark, sf):
    """All works with words beginning so, ranked by BM25."""
    return S.search(_index(spark, sf), "id", _TERMS).select("id", F.round("score", 9).alias("score"))


@query()
def ft2_track_search(spark, sf):
    """The best 200 playable tracks for a typed query, from the index of all tracks."""
    t = cut(tracks(spark, sf, "title", "work", "movement", "composer", "performer", "album", "source", *PLAY))
    ix = S.index(t, "id", X.keywords(*[F.col(c) for c in ("title", "work", "movement", "composer", "performer", "album", "source")]))
    return S.search(ix, "id", X.match_terms("Symphony minor"), 200, t.where(C.playable()))


@query(_IX + "select term, count(*) as n from x where term in ('sonata', 'nocturne', 'flat') group by term")
def ft5_facets(spark, sf):
    return _index(spark, sf).where(F.col("term").isin("sonata", "nocturne", "flat")).groupBy("term").agg(F.count("*").alias("n"))


# --- graph, works, duplicates, streams


@query(
    """with recursive e as (select 'r' || r_regionkey as parent, 'n' || n_nationkey as child from region join nation on n_regionkey = r_regionkey union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
    w(root, node, depth) as (select 'r' || r_regionkey, 'r' || r_regionkey, 0 from region union select w.root, e.child, w.depth + 1 from w join e on e.parent = w.node where w.depth < 3)
    select root, node, min(depth) as depth from w group by 1, 2"""
)
def g1_traversal(spark, sf):
    """Regions, nations and customers as a category graph with links back from nation to region."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    k = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    e = (
        n.select(k("r", "n_regionkey").alias("parent"), k("n", "n_nationkey").alias("child"), F.lit(False).alias("leaf"))
        .union(c.select(k("n", "c_nationkey"), k("c", "c_custkey"), F.lit(True)))
        .union(n.select(k("n", "n_nationkey"), k("r", "n_regionkey"), F.lit(False)))
    )
    return graph.reach(e, table(spark, sf, "region").select(k("r", "r_regionkey").alias("root")), 3).select("root", "node", "depth")


@query(_T + f", k as (select *, {_WORK_ID} as wid from p where enriched_at is not null) select wid as id, arg_min(composer_canonical, id) as composer_canonical, arg_min(work_title, id) as title, arg_min(struct_pack(c := catalog), id).c as catalog, count(*) as track_count from k where wid is not null group by wid")
def g2_works(spark, sf):
    return C.group_works(tracks(spark, sf, "composer_canonical", "work_title", "catalog", "enriched_at", *PLAY))


@query("select source, stage, count(*) as events, sum(coalesce(bytes_delta, 0))::bigint as bytes, count(*) filter (where completed) as completed, count(*) filter (where failed) as failed, count(*) filter (where skipped) as skipped from (select distinct * from progress) group by 1, 2")
def t6_progress_stream(spark, sf):
    """Totals of the progress stream, repeated events counted once."""
    s = progress.distinct_events(progress.events(spark, f"{sf}/progress.parquet"), "30 days")
    return progress.progress_by_source(progress.drained(s, spark))
