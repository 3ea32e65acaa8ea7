"""The queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.canon import canonical_tracks
from quaverlake.llm.components import track_groups
from quaverlake.llm.leaks import leaked
from quaverlake.llm.lookalikes import disguised
from quaverlake.llm.mixing import mix, shares
from quaverlake.llm.sentences import split_sentences
from quaverlake.llm.survivors import best_tracks, golden_tracks
from quaverlake.llm.variants import name_entities, variant_pairs
from quaverlake.operators.multivalue import split_values
from quaverlake.session import cut, table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_groups(table(spark, sf_dir, "match_pairs"), table(spark, sf_dir, "tracks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list entry that each composer and work text means, or unmatched."""
    return canonical_tracks(*(table(spark, sf_dir, t) for t in ("tracks", "composer_list", "works")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every track that match_pairs links to another."""
    return _groups(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor of every group of p5."""
    return best_tracks(cut(_groups(spark, sf_dir)), *(table(spark, sf_dir, t) for t in ("tracks", "source_trust", "format_pref")))


def p4_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record built field by field of every group of p5."""
    return golden_tracks(cut(_groups(spark, sf_dir)), *(table(spark, sf_dir, t) for t in ("tracks", "source_trust", "format_pref")))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, name, w) of all composers and of the single names of all performers."""
    tracks = table(spark, sf_dir, "tracks")
    composers = tracks.where("composer <> ''").groupBy("composer").agg(F.count("*").alias("w")).select(F.lit("composer").alias("field"), F.col("composer").alias("name"), "w")
    texts = tracks.where("performer <> ''").groupBy("performer").agg(F.count("*").alias("w"))
    performers = split_values(texts, "performer").join(texts, "performer").select(F.lit("performer").alias("field"), F.explode("names").alias("name"), "w")
    return composers.unionByName(performers)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two different spellings of one composer, performer or ensemble."""
    return variant_pairs(_names(spark, sf_dir))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the entity it stands for: one row for each, where p3_found has pairs."""
    return name_entities(_names(spark, sf_dir)).select("field", "name", F.concat_ws("/", "e_sur", "e_giv").alias("entity"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and composer text that is partly made of other characters."""
    return disguised(table(spark, sf_dir, "tracks"), "id", ("title", "composer")).select(F.col("id").alias("track_id"), "field")


def p6_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those texts with the one form they are brought to."""
    return disguised(table(spark, sf_dir, "tracks"), "id", ("title", "composer")).withColumnRenamed("id", "track_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with ten or more consecutive words of a test item."""
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document occurs in the mix of sources."""
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of every source in the mix, beside its target."""
    return shares(cut(p8_mix(spark, sf_dir)), table(spark, sf_dir, "mix_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p3_found": p3_found, "p3_entities": p3_entities, "p4_found": p4_found, "p4_golden": p4_golden, "p5_found": p5_found, "p6_found": p6_found, "p6_rewritten": p6_rewritten, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found}

_GROUPS = """
pairs as (
  select distinct least(a.id, b.id) as a, greatest(a.id, b.id) as b
  from match_pairs m
  join (select distinct id from tracks) a on a.id = upper(trim(m.track_a))
  join (select distinct id from tracks) b on b.id = upper(trim(m.track_b))
  where a.id <> b.id),
arcs as (select a as v, b as w from pairs union all select b, a from pairs),
reach(v, w) as (select v, w from arcs union select r.v, a.w from reach r join arcs a on a.v = r.w),
groups as (select v as track_id, least(v, min(w)) as group_id from reach group by v)
"""
_RANKED = """
ranked as (
  select g.group_id, g.track_id as id, s.trust, f.pref, k.fmt, lower(k.source) as sk,
         case when k.original_bytes between 1024 and 1099511627776 then k.original_bytes end as size, k.seen
  from groups g
  join (select id, max(updated_at) as seen, max(original_bytes) as original_bytes,
               regexp_replace(lower(trim(max(source))), '[\\s_-]+', '_', 'g') as source,
               case when lower(max(original_format)) like '%opus%' then 'opus'
                    when lower(max(original_format)) like '%flac%' then 'flac'
                    when regexp_matches(lower(max(original_format)), 'ogg|oga|vorbis') then 'ogg'
                    when regexp_matches(lower(max(original_format)), 'wav|pcm') then 'wav'
                    when regexp_matches(lower(max(original_format)), 'mp3|mpeg') then 'mp3' end as fmt
        from tracks group by id) k on k.id = g.track_id
  left join source_trust s on s.source = k.source
  left join format_pref f on f.fmt = k.fmt)
"""
SQL: dict[str, str] = {
    "p5_found": f"with recursive {_GROUPS} select track_id, group_id from groups",
    "p4_found": f"""with recursive {_GROUPS}, {_RANKED}
        select group_id, id as survivor_id from (
          select *, row_number() over (partition by group_id order by trust desc nulls last, pref nulls last, size desc nulls last, id) as k from ranked)
        where k = 1""",
    "p4_golden": f"""with recursive {_GROUPS}, {_RANKED}
        select group_id, count(*) as members,
          (array_agg(sk order by coalesce(trust, -1) desc, seen desc, sk desc) filter (where sk is not null))[1] as source,
          (array_agg(fmt order by coalesce(trust, -1) desc, coalesce(pref, 1073741824), seen desc, fmt desc) filter (where fmt is not null))[1] as original_format,
          (array_agg(size order by coalesce(trust, -1) desc, seen desc, size desc) filter (where size is not null))[1] as original_bytes
        from ranked group by group_id""",
}
