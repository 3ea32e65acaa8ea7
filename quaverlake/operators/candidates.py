"""Candidates: files grouped into recordings, the best file of each, and their ingest as tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.rules import AUDIO_FORMATS
from quaverlake.functions.text import blank_to_null


def group_variants(files: DataFrame, by: list[str], order: list[str], file: dict[str, Column], meta: list[str]) -> DataFrame:
    """``(by, files, meta...)``: the files of each recording in order, and what its first file says of it.

    ``order`` makes the first file certain. A recording's files are the forms of one performance: a
    handful, which is why they may stand in an array.
    """
    first = F.min(F.struct(*order, *meta))
    each = F.sort_array(F.collect_list(F.struct(*order, *[c.alias(n) for n, c in file.items()])))
    g = files.groupBy(*by).agg(first.alias("m"), each.alias("files"))
    kept = F.transform("files", lambda f: F.struct(*[f[n].alias(n) for n in file]))
    return g.select(*by, kept.alias("files"), *[F.col(f"m.{c}").alias(c) for c in meta])


def select_best(files: Column, prefer: list[str], fallback: bool) -> Column:
    """The file of an array that is preferred most, the first of equals; NULL if none is.

    A format named twice counts by its last place. With ``fallback`` the first audio file of any
    format is taken where none is preferred. Letter case means nothing.
    """
    place = {f.lower(): i for i, f in enumerate(prefer)}
    rank = lambda f: F.coalesce(*[F.when(F.lower(f["format"]) == name, i) for name, i in place.items()]) if place else F.lit(None).cast("int")
    ranked = F.filter(F.transform(files, lambda f, i: F.struct(rank(f).alias("rank"), i.alias("i"), f.alias("f"))), lambda x: x["rank"].isNotNull())
    best = F.try_element_at(F.array_sort(F.transform(ranked, lambda x: F.struct(x["rank"].alias("rank"), x["i"].alias("i")))), F.lit(1))
    found = F.get(files, best["i"])
    if not fallback:
        return found
    audio = F.try_element_at(F.filter(files, lambda f: F.lower(f["format"]).isin(*AUDIO_FORMATS)), F.lit(1))
    return F.coalesce(found, audio)


def ingest(candidates: DataFrame, prefer: list[str], fallback: bool, allowed: Column | None = None) -> DataFrame:
    """Candidates as rows of tracks: the best file, else the first one marked as skipped with a reason.

    A candidate whose file has no URL is dropped. ``allowed`` says which licences may be kept. Rows of
    one source and URL count once (the first by source item).
    """
    best = select_best(F.col("files"), prefer, fallback)
    c = candidates.withColumn("best", best).withColumn("file", F.coalesce("best", F.get("files", F.lit(0))))
    reason = F.when(F.col("best").isNull(), "no preferred format")
    if allowed is not None:
        reason = reason.when(~F.coalesce(allowed, F.lit(False)), "license not allowed")
    rows = c.where(blank_to_null(F.col("file.url")).isNotNull()).select(
        *[x for x in candidates.columns if x != "files"], F.col("file.url").alias("original_url"), F.col("file.format").alias("original_format"), F.col("file.bytes").alias("original_bytes"), reason.alias("stage_error")
    )
    rest = [x for x in rows.columns if x not in ("source", "original_url")]
    once = rows.groupBy("source", "original_url").agg(F.min(F.struct("source_item", *[x for x in rest if x != "source_item"])).alias("r"))
    return once.select("source", "original_url", *[F.col(f"r.{x}").alias(x) for x in rest], F.when(F.col("r.stage_error").isNull(), "discovered").otherwise("skipped").alias("status"))
