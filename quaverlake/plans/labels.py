"""Labels, keys, totals and enrichment of the catalogue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaverlake.functions import text as X
from quaverlake.operators import catalogue as C
from quaverlake.operators import enrich, rates
from quaverlake.plans.catalogue import _T, _WORK_ID, PLAY, tracks
from quaverlake.session import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(_T + "select count(*) filter (where status <> 'skipped') as found, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed, round(100.0::double * count(*) filter (where status = 'done') / count(*) filter (where status <> 'skipped'), 6) as percent from t")
def a10_progress_totals(spark, sf):
    f = C.funnel(tracks(spark, sf, "source", "status")).agg(*[F.sum(c).alias(c) for c in ("found", "done", "failed")])
    return f.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("done") * 100.0, F.col("found")), 6), F.lit(0.0)))


@query(_T + "select count(*) as nodes, sum(n)::bigint as tracks from (select source, count(*) as n from p group by source)")
def a16_browse_header(spark, sf):
    return C.browse(tracks(spark, sf, "source", *PLAY), "source").agg(F.count("*").alias("nodes"), F.sum("n").alias("tracks"))


@query("with d as (select distinct * from progress), b as (select source, date_trunc('day', ts) as day, sum(completed::int)::double as v from d group by 1, 2), e as (select list_reduce([0.0::double] || list(v order by day), lambda m, x: x * 0.2 + m * 0.8) as r from b group by source) select round(sum(r), 6) as per_day from e")
def a17_total_rate(spark, sf):
    d = table(spark, sf, "progress").distinct().groupBy("source", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.count_if("completed").cast("double").alias("v"))
    return rates.ewma(d, "source", F.col("day"), F.col("v"), 0.2).agg(F.round(F.sum("ewma"), 6).alias("per_day"))


@query("select work_id, arg_min(source, doc_id) as source, count(*) as documents from documents where work_id is not null and source is not null group by work_id")
def j10_first_source(spark, sf):
    d = table(spark, sf, "documents").where("work_id is not null and source is not null")
    return d.groupBy("work_id").agg(F.min_by("source", "doc_id").alias("source"), F.count("*").alias("documents"))


@query(_T + f"select id, case when enriched_at is not null then {_WORK_ID} end as work_id from t")
def j9_relink(spark, sf):
    return enrich.relink(tracks(spark, sf, "composer_canonical", "work_title", "catalog", "enriched_at"))


@query(_T + "select id, case when coalesce(composer_corrected, false) and nullif(composer_canonical, '') is not null then composer_canonical else composer end as composer from t")
def g8_apply_enrichment(spark, sf):
    """Stored answers applied to their tracks."""
    t = tracks(spark, sf, "composer", "composer_canonical", "composer_corrected", "enrich_confidence", "enriched_at")
    a = t.where("enriched_at is not null").select("id", F.struct("composer_canonical", "composer_corrected", F.col("enrich_confidence").alias("confidence")).alias("a"))
    return enrich.apply(t.select("id", "composer"), a.select("id", F.from_json(F.to_json("a"), enrich.ANSWER).alias("a")))


@query(
    _T
    + """select id, 'Title: ' || coalesce(title, '') || chr(10) || case when nullif(composer, '') is not null then 'Source-provided composer (may be wrong): ' || composer || chr(10) else '' end || case when nullif(performer, '') is not null then 'Performer: ' || performer || chr(10) else '' end
    || case when nullif(album, '') is not null then 'Album: ' || album || chr(10) else '' end || case when nullif(source_item, '') is not null then 'Source item: ' || source_item || chr(10) else '' end || 'Source: ' || coalesce(source, '') || chr(10) as prompt from t"""
)
def x34_prompts(spark, sf):
    return tracks(spark, sf, "title", "composer", "performer", "album", "source_item", "source").select("id", enrich.prompt().alias("prompt"))


@query("select doc_id, case when length(text) > 50 then substring(text, 1, 49) || '…' else text end as label, substring(text, 1, 60) as cut from documents")
def x44_x49_labels(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.ellipsis(F.col("text"), 50).alias("label"), F.substring("text", 1, 60).alias("cut"))


@query(_T + "select id, coalesce(title, '') as title, coalesce(composer, '') as composer, coalesce(duration_sec, 0) as duration, coalesce(nullif(display_title, ''), case when nullif(composer, '') is not null then composer || ' — ' || coalesce(title, '') else coalesce(title, '') end) as label, concat_ws(' › ', source, coalesce(nullif(composer, ''), '—'), coalesce(work_id, 'title:' || title)) as crumbs from t")
def x46_x47_rows(spark, sf):
    t = tracks(spark, sf, "title", "composer", "duration_sec", "display_title", "source", "work_id")
    title, composer = F.coalesce("title", F.lit("")), X.blank_to_null(F.col("composer"))
    label = F.coalesce(X.blank_to_null(F.col("display_title")), F.when(composer.isNotNull(), F.concat(composer, F.lit(" — "), title)).otherwise(title))
    crumbs = F.concat_ws(" › ", "source", F.coalesce(composer, F.lit(C.DASH)), F.coalesce("work_id", F.concat(F.lit("title:"), "title")))
    return t.select("id", title.alias("title"), F.coalesce("composer", F.lit("")).alias("composer"), F.coalesce("duration_sec", F.lit(0.0)).alias("duration"), label.alias("label"), crumbs.alias("crumbs"))


@query("select title, trim(regexp_replace(regexp_replace(translate(strip_accents(lower(regexp_replace(trim(translate(regexp_replace(regexp_replace(title, '^File:', ''), '\\.[^./]*$', ''), '_', ' ')), '(?i)[ _-]+(ogg|oga|opus|wav|wave|mp3|flac)$', ''))), 'ø', 'o'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as key from works")
def x8_plain_keys(spark, sf):
    return table(spark, sf, "works").select("title", X.plain_title_key(F.col("title")).alias("key"))


@query(_T + "select p.id, p.title from p where source = 'vellum_archive' and composer = 'Anselm Salvadović' order by translate(p.title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') nulls first, p.id limit 200")
def o10_composer_tracks(spark, sf):
    t = tracks(spark, sf, "source", "composer", "title", *PLAY).where(C.playable() & (F.col("source") == "vellum_archive") & (F.col("composer") == "Anselm Salvadović"))
    return t.orderBy(X.nocase(F.col("title")), "id").limit(200).select("id", "title")


@query(_T + "select count(*) as pending from t where status not in ('done', 'failed', 'skipped')")
def a17_pending_total(spark, sf):
    return tracks(spark, sf, "status").where(~F.col("status").isin("done", "failed", "skipped")).agg(F.count("*").alias("pending"))


@query()
def x8_all_plain_keys(spark, sf):
    """Plain keys of every title: no SQL, which has no compatibility forms."""
    t = table(spark, sf, "tracks").where("title is not null").select("title").distinct()
    return t.select("title", X.plain_title_key(F.col("title")).alias("key"))


@query()
def x9_x10_track_keys(spark, sf):
    """Keys and work ids of every composer and work text: no SQL, which has no compatibility forms."""
    c = F.col
    t = table(spark, sf, "tracks").select("composer", "work").distinct()
    return t.select("composer", "work", X.normalize_key(c("composer")).alias("composer_key"), X.work_id(c("composer"), c("work"), F.lit(None).cast("string")).alias("work_id"))
