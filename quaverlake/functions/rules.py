"""Rules over a track's fields as column expressions: formats, licences, errors, paths, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaverlake.functions.text import blank_to_null, first_text, human_bytes, nocase, path_escape

# Format tokens that are audio, and file endings of audio.
AUDIO_FORMATS = ("opus", "ogg", "wav", "mp3", "flac", "m4a", "aac", "oga", "other")
AUDIO_ENDINGS = (".opus", ".ogg", ".oga", ".flac", ".wav", ".mp3")
SOURCE_ENDINGS = ("ogg", "opus", "wav", "mp3", "flac", "oga")
# How far a source is trusted; all others have OTHER_RANK.
SOURCE_RANK = {"bach_wtc1": 60, "goldberg": 58, "chopin": 56, "beethoven_pitman": 54, "commons_classical": 40, "navy": 20, "marine": 20, "airforce": 20, "army": 20, "coastguard": 20}
OTHER_RANK = 10
# Query parameters that carry secrets.
SECRETS = ("X-Amz-Signature", "X-Amz-Credential")


def like_prefix(c: Column, *prefixes: str) -> Column:
    """Whether a text begins with one of the prefixes, ASCII letters of any case; NULL stays NULL."""
    low = nocase(c)
    out = low.startswith(nocase(F.lit(prefixes[0])))
    for p in prefixes[1:]:
        out = out | low.startswith(nocase(F.lit(p)))
    return out


def ending(title: Column) -> Column:
    """The ending of a file name with its dot, in lower case; "" if there is none."""
    return F.lower(F.regexp_extract(title, r"(\.[^./]*)$", 1))


def audio_mime(mime: Column, title: Column) -> Column:
    """Whether a file is audio by its MIME type or, failing that, its ending; MIDI is none by type."""
    m = F.coalesce(mime, F.lit(""))
    return (m.startswith("audio/") & (m != "audio/midi")) | m.isin("application/ogg", "application/x-ogg") | F.coalesce(ending(title), F.lit("")).isin(*AUDIO_ENDINGS)


def audio_format(c: Column) -> Column:
    """Whether a format token is audio; NULL is not."""
    return F.coalesce(F.lower(c).isin(*AUDIO_FORMATS), F.lit(False))


def rate_limited(err: Column) -> Column:
    """Whether an error text says that the host wants fewer requests; NULL is none."""
    return F.coalesce(err.isin("http 429", "http 403"), F.lit(False))


def retryable(err: Column) -> Column:
    """Whether a step that failed so may be tried again."""
    return rate_limited(err) | F.coalesce(err.startswith("http 5"), F.lit(False))


def retryable_status(code: Column) -> Column:
    """Whether a model's HTTP status is worth another call."""
    return F.coalesce((code == 429) | (code >= 500), F.lit(False))


def license_name(url: Column) -> Column:
    """The short name of the licence a URL stands for; "" without URL."""
    low = F.lower(url)
    return (
        F.when(blank_to_null(url).isNull(), "")
        .when(low.contains("publicdomain/zero"), "CC0")
        .when(low.contains("publicdomain/mark"), "Public domain")
        .when(low.contains("/by-sa/"), "CC BY-SA")
        .when(low.contains("/by/"), "CC BY")
        .otherwise("see license url")
    )


def license_rank(short: Column, url: Column) -> Column:
    """How free a licence is, 4 the freest; the order of the tests counts."""
    low = F.lower(F.concat(F.coalesce(short, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    return F.when(low.rlike("cc0|publicdomain/zero"), 4).when(low.rlike("public domain|publicdomain|pd"), 3).when(low.contains("by-sa"), 1).when(low.contains("by"), 2).otherwise(0)


def source_rank(source: Column, ranks: dict[str, int] | None = None, other: int = OTHER_RANK) -> Column:
    """How far a source is trusted."""
    out = F.lit(other)
    for name, rank in (SOURCE_RANK if ranks is None else ranks).items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def worker_label() -> Column:
    """What a worker's line calls a track: title, work or source item."""
    return F.coalesce(first_text(F.col("title"), F.col("work")), F.col("source_item"), F.lit(""))


def source_ending(fmt: Column) -> Column:
    """The ending of a downloaded file of a format; an unknown one is dat."""
    return F.when(fmt.isin(*SOURCE_ENDINGS), fmt).otherwise("dat")


def artefact_paths(folder: str, id: Column, fmt: Column) -> Column:
    """The struct of a track's files: src, opus and caf."""
    at = F.concat(F.lit(folder.rstrip("/") + "/"), id)
    return F.struct(F.concat(at, F.lit(".src."), source_ending(fmt)).alias("src"), F.concat(at, F.lit(".opus")).alias("opus"), F.concat(at, F.lit(".caf")).alias("caf"))


def status_cell(status: Column) -> Column:
    """A sign for the status and its first four letters."""
    sign = F.when(status == "done", "●").when(status == "failed", "✗").when(status == "skipped", "·").when(status == "discovered", "○").otherwise("◐")
    return F.concat(sign, F.substring(status, 1, 4))


def size_cell(status: Column, opus: Column, caf: Column) -> Column:
    """The sizes of a finished track's files; a missing one counts as 0."""
    size = lambda c: human_bytes(F.coalesce(c, F.lit(0).cast("bigint")))
    return F.when(status == "done", F.concat(F.lit("opus "), size(opus), F.lit(" caf "), size(caf))).otherwise("")


def exact_signature(caf_bytes: Column, duration: Column, sha1: Column) -> Column:
    """What stands for the fingerprint of a file that has none; missing parts count as 0 and ""."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").cast("string")
    return F.concat(F.lit("exact:"), n(caf_bytes), F.lit(":"), n(duration), F.lit(":"), F.coalesce(sha1, F.lit("")))


def masked_url(url: Column) -> Column:
    """The URL with the values of secret query parameters replaced; host and path stay.

    Empty values are left as they are. Parameters keep their order. NULL stays NULL.
    """
    out = url
    for name in SECRETS:
        out = F.regexp_replace(out, rf"([?&]{name}=)[^&#]+", "$1REDACTED")
    return out


def playback_path(backend: str, opus: Column, caf: Column, opus_there: Column, caf_there: Column) -> Column:
    """The file a player takes: ``beep`` opus before caf, of what exists; ``afplay`` an existing caf,
    else opus; any other opus if it is named. "" if neither is named."""
    opus, caf = blank_to_null(opus), blank_to_null(caf)
    there = lambda c, e: F.when(F.coalesce(e, F.lit(False)), c)
    if backend == "beep":
        order = (there(opus, opus_there), there(caf, caf_there), opus, caf)
    elif backend == "afplay":
        order = (there(caf, caf_there), opus, caf)
    else:
        order = (opus, caf)
    return F.coalesce(*order, F.lit(""))


def encode_cursor(i: Column) -> Column:
    """The place in the list of composers as the cursor's JSON."""
    return F.to_json(F.struct(F.coalesce(i, F.lit(0)).cast("bigint").alias("i")))


def decode_cursor(c: Column) -> Column:
    """The place that a cursor holds, as JSON or as a bare number; 0 if it is malformed or NULL."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.get_json_object(c, "$.i").try_cast("bigint"), F.lit(0).cast("bigint"))


def browse_key(work_id: Column, title: Column) -> Column:
    """The key under which a track stands: its work, or its title."""
    return F.coalesce(work_id, F.concat(F.lit("title:"), title))


def key_parts(key: Column) -> Column:
    """The struct (work_id, title) that a browse key stands for; one of them is NULL."""
    titled = key.startswith("title:")
    return F.struct(F.when(~titled, key).alias("work_id"), F.when(titled, F.substring(key, 7, 1 << 30)).alias("title"))


def object_url(base: str, key: Column) -> Column:
    """The public URL of an object, each segment of its key escaped."""
    return F.concat(F.lit(base.rstrip("/") + "/"), path_escape(key))


def audio_url(base: str, id: Column) -> Column:
    """Where a track's packaged file is served."""
    return object_url(base, F.concat(F.lit("audio/"), id, F.lit(".caf")))


def padded(c: Column, n: int) -> Column:
    """At most n characters, filled up with blanks; NULL is all blanks."""
    return F.rpad(F.coalesce(c, F.lit("")), n, " ")


def split_list(text: str) -> list[str]:
    """The entries of a comma list, without blanks around them and without empty ones."""
    return [p for p in map(str.strip, text.split(",")) if p]
