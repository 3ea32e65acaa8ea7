"""Readers of landed provider JSON and file inventories, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions.rules import audio_mime, license_name
from quaverlake.functions.text import (
    blank_to_null,
    category_composer,
    category_performer,
    clean_title,
    json_text,
    label_format,
    lenient_int,
    media_format,
    parse_title,
    parse_year,
    path_escape,
    plain_title_key,
    strip_html,
    title_key,
)
from quaverlake.operators.graph import reach

# The parts that are read of an archive item's document and of an image-info document.
ARCHIVE = "metadata struct<identifier:string,title:string,creator:string,date:string,licenseurl:string>, files array<struct<name:string,format:string,size:string,title:string,track:string,artist:string,album:string>>"
IMAGES = "query struct<pages:map<string,struct<title:string,imageinfo:array<struct<url:string,mime:string,size:bigint,extmetadata:map<string,struct<value:string>>>>>>>"


def archive_files(docs: DataFrame, column: str, base: str = "https://archive.example/download/") -> DataFrame:
    """One row per audio file of each archive item document, in the item's order.

    Files of one name but for the ending share a ``work_key``; a file without a name has no row. A
    document that is no JSON, and a NULL one, has none.
    """
    d = docs.select(F.from_json(column, ARCHIVE).alias("d")).select("d.*")
    f = d.select("metadata.*", F.posexplode("files").alias("ord", "f"))
    fmt = label_format(F.col("f.format"))
    stem = F.regexp_replace("f.name", r"\.[^./]*\z", "")
    url = F.concat(F.lit(base), path_escape(F.col("identifier")), F.lit("/"), path_escape(F.col("f.name")))
    return f.where((fmt != "") & (F.trim(stem) != "")).select(
        F.col("identifier").alias("source_item"), "ord", F.lower(F.trim(stem)).alias("work_key"), F.coalesce(blank_to_null(F.trim("f.title")), stem).alias("title"),
        json_text(F.col("creator")).alias("composer"), F.trim(F.coalesce("f.artist", F.lit(""))).alias("performer"), F.trim(F.coalesce("f.album", F.lit(""))).alias("album"),
        F.col("date").alias("date_raw"), parse_year(F.col("date")).alias("year"), fmt.alias("format"), lenient_int(F.col("f.size")).alias("bytes"), url.alias("url"),
        license_name(F.col("licenseurl")).alias("license_short"), F.coalesce("licenseurl", F.lit("")).alias("license_url"),
    )


def image_files(docs: DataFrame, column: str, classical: bool = False) -> DataFrame:
    """One row per audio file page of each image-info document.

    ``classical`` takes the format from the ending where the type says nothing, and keys by plain
    letters. A page without information, or that is no audio, has no row.
    """
    d = docs.select(F.explode(F.from_json(column, IMAGES)["query"]["pages"]).alias("page", "p")).select("p.title", F.get("p.imageinfo", F.lit(0)).alias("i"))
    meta = lambda k: F.coalesce(strip_html(F.element_at(F.col("i.extmetadata"), k)["value"]), F.lit(""))
    title, fmt = F.col("title"), media_format(F.col("i.mime"), F.col("title"), classical)
    key = plain_title_key(title) if classical else title_key(title)
    gate = audio_mime(F.col("i.mime"), title) if classical else F.lit(True)
    parts = parse_title(clean_title(title))
    return d.where(F.col("i").isNotNull() & gate & (fmt != "")).select(
        F.col("title").alias("source_item"), key.alias("work_key"), clean_title(title).alias("title"), parts["composer"].alias("composer"), parts["work"].alias("work"), parts["movement"].alias("movement"),
        F.col("i.url").alias("url"), fmt.alias("format"), F.col("i.size").alias("bytes"), meta("Artist").alias("performer"), meta("DateTimeOriginal").alias("date_raw"),
        parse_year(meta("DateTimeOriginal")).alias("year"), meta("LicenseShortName").alias("license_short"), meta("LicenseUrl").alias("license_url"),
    )


def category_files(categories: DataFrame, images: DataFrame, depth: int = 3, skip: list[str] | None = None, allow: list[str] | None = None) -> DataFrame:
    """The audio files below each composer's category, with the composer and the category they came from.

    ``categories`` is ``(parent, child, leaf)``, where composers' categories are the children of a NULL
    parent; ``images`` are rows of :func:`image_files`. ``allow`` names the composers or categories that
    are read, in any case. The performer named by the category goes before the file's own.
    """
    roots = categories.where("parent is null and not leaf").select(F.col("child").alias("root")).distinct()
    name = category_composer(F.col("root"))
    roots = roots.withColumn("composer", name)
    if allow:
        low = [a.lower() for a in allow]
        roots = roots.where(F.lower("root").isin(low) | F.lower("composer").isin(low))
    found = reach(categories.where("parent is not null"), roots, depth + 1, skip).where("leaf")
    at = found.join(roots, "root").select("composer", F.col("node").alias("source_item"), "via")
    own = blank_to_null(category_performer(F.col("via")))
    return at.join(images.drop("composer"), "source_item").withColumn("performer", F.coalesce(own, "performer"))


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, id, bytes)`` of the files below a folder; their contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", F.split(name, r"\.")[0].alias("id"), F.col("length").alias("bytes"))


def snapshot(df: DataFrame, path: str) -> None:
    """Writes the catalogue, or any table, as one parquet snapshot."""
    df.write.mode("overwrite").parquet(path)
