"""Text functions of the catalogue as column expressions; only compatibility folding needs Python."""

from __future__ import annotations

import unicodedata as U

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words that carry no meaning for search.
STOPWORDS = "a an and are as at be but by for from had has have he her his in into is it its of on or that the their then there these they this to was were will with".split()
# Letters and what a work key has for them; two-letter ones apart.
PLAIN_FROM = "äöüáàâãéèêëíìîïóòôõúùûýÿñçčšžřďťňěůłøåćśźńđħğşı"
PLAIN_TO = "aouaaaaeeeeiiiioooouuuyynccszrdtneuloacszndhgsi"
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe"}


# What counts as a blank in all scripts.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_blanks(c: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def nocase(c: Column) -> Column:
    """ASCII letters in lower case, all else as it is: the order and equality of NOCASE."""
    return F.translate(c, UPPER, LOWER)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*cs: Column) -> Column:
    """The first that is neither NULL nor empty; NULL if none is."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in U.normalize("NFKD", t) if U.category(c) != "Mn"))


def strip_diacritics(c: Column) -> Column:
    """Lower case, compatibility-decomposed, without combining marks. NULL stays NULL."""
    return _folded(F.lower(c))


def tokens(folded: Column) -> Column:
    """The words of a folded text in order: letters and digits, two or more, no stopwords."""
    words = F.split(folded, r"[^\p{L}\p{Nd}]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 2) & ~w.isin(STOPWORDS))


def keywords(*fields: Column) -> Column:
    """The distinct sorted words of several fields together."""
    return F.array_sort(F.array_distinct(tokens(strip_diacritics(F.concat_ws(" ", *fields)))))


def normalize_key(c: Column) -> Column:
    """Folded, all but letters and digits one blank."""
    return F.trim(F.regexp_replace(strip_diacritics(c), r"[^\p{L}\p{Nd}]+", " "))


def work_id(composer: Column, work: Column, catalog: Column) -> Column:
    """The stable id of a work, or NULL if composer or work is empty."""
    parts = F.concat_ws("|", blank_to_null(normalize_key(composer)), blank_to_null(normalize_key(work)), blank_to_null(normalize_key(catalog)))
    return F.when((F.coalesce(normalize_key(composer), F.lit("")) != "") & (F.coalesce(normalize_key(work), F.lit("")) != ""), F.sha1(parts))


def match_terms(query: str, dialect: str = "ascii") -> list[str]:
    """The prefixes that a search asks for; ``unicode`` splits at marks and keeps all letters."""
    if dialect == "unicode":
        folded = "".join(c for c in U.normalize("NFKD", query.lower()) if U.category(c) != "Mn")
        return "".join(c if c.isalnum() else " " for c in folded).split()
    kept = ("".join(c for c in w if c in LOWER + "0123456789") for w in query.lower().split())
    return [w for w in kept if w]


def clean_title(c: Column) -> Column:
    """Without "File:" and what follows the last dot; underscores are blanks."""
    return trim_blanks(F.translate(F.regexp_replace(F.regexp_replace(c, "^File:", ""), r"\.[^./]*\z", ""), "_", " "))


def title_key(c: Column) -> Column:
    """The cleaned title without a last format word, in lower case letter by letter, blanks collapsed."""
    bare = F.regexp_replace(clean_title(c), r"(?iu)[ _-]+(ogg|oga|opus|wav|wave|mp3|flac)\z", "")
    # lower() has another letter for a last sigma, and two for a dotted I
    return F.trim(F.regexp_replace(F.lower(F.translate(bare, "Σİ", "σi")), f"{BLANK}+", " "))


def plain_title_key(c: Column) -> Column:
    """:func:`title_key` with plain letters and digits only."""
    t = F.translate(title_key(c), PLAIN_FROM, PLAIN_TO)
    for a, b in DOUBLE.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(_folded(t), "[^a-z0-9 ]", ""), " +", " "))


def strip_html(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(c, "<[^>]*>", ""), F.lit("&amp;"), F.lit("&")))


def parse_year(c: Column) -> Column:
    """The first four digits that make a year from 1000 to 2100, else 0."""
    return F.coalesce(blank_to_null(F.regexp_extract(c, "(1[0-9]{3}|20[0-9]{2}|2100)", 1)).try_cast("int"), F.lit(0))


def likely_name(c: Column) -> Column:
    """No digit, no double quote, and no small ASCII letter or other script first."""
    return c.rlike(r"^[\x00-\x60\x7B-\x7F]") & ~c.rlike('[0-9"]')


def parse_title(c: Column) -> Column:
    """A struct (composer, work, movement) read from "Composer, Work - Movement - Performer"."""
    t = trim_blanks(c)
    tail = F.lower(F.regexp_extract(t, r"^.+ - (.*?)$", 1))
    head = trim_blanks(F.regexp_extract(t, r"^(.+) - .*?$", 1))
    t = F.when((head != "") & tail.rlike("band|orchestra|performed|ensemble"), head).otherwise(t)
    first = trim_blanks(F.substring_index(t, ",", 1))
    rest = trim_blanks(F.regexp_extract(t, r"^[^,]*,(.*)$", 1))
    named = t.contains(",") & (F.size(F.filter(F.split(first, f"{BLANK}+"), lambda w: w != "")) <= 2) & (first != "") & likely_name(first)
    work, movement = trim_blanks(F.regexp_extract(rest, r"^(.+) - .*?$", 1)), trim_blanks(F.regexp_extract(rest, r"^.+ - (.*?)$", 1))
    split = named & rest.rlike("^.+ - ")
    return F.struct(
        F.when(named, first).otherwise("").alias("composer"),
        F.when(split, work).when(named, rest).otherwise(t).alias("work"),
        F.when(split, movement).otherwise("").alias("movement"),
    )


def category_composer(c: Column) -> Column:
    """The composer a category of recordings names."""
    lead = r"^Category:Audio files of (?:classical )?music by "
    t = F.regexp_replace(F.regexp_replace(c, "^Category:", ""), "^Audio files of ", "")
    owner = F.regexp_extract(t, r"^(.+?)'s ", 1)
    by = F.regexp_extract(t, r"(?i)^.*?music by (.*)$", 1)
    return F.trim(F.when(c.rlike(lead), F.regexp_replace(c, lead, "")).when((owner != "") & ~F.lower(owner).contains("played by"), owner).when(F.lower(t).contains("music by "), by).otherwise(t))


def category_performer(c: Column) -> Column:
    """The performer after "played by", up to a comma or bracket; "" if there is none."""
    rest = F.trim(F.regexp_extract(c, "(?i)played by(.*)$", 1))
    for sep in (",", r"\(", r"\["):
        rest = F.trim(F.regexp_replace(rest, f"^(.+?){sep}.*$", "$1"))
    return rest


def json_text(c: Column) -> Column:
    """A JSON value that may be a text, a list of texts, or another scalar, as one text."""
    t = F.trim(c)
    return (
        F.when(t.isNull() | (t == "") | (t == "null"), "")
        .when(t.startswith("["), F.array_join(F.from_json(t, "array<string>"), "; "))
        .when(t.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"))
        .otherwise(t)
    )


def first_json_object(c: Column) -> Column:
    """From the first { to the last }, or ""."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def lenient_int(c: Column) -> Column:
    """A whole number, else 0."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def path_escape(c: Column) -> Column:
    """Each segment percent-encoded, slashes kept."""
    e = F.url_encode(c)
    for a, b in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def url_host(c: Column) -> Column:
    """The host with its port; "" if there is none."""
    return F.coalesce(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def human_bytes(c: Column) -> Column:
    """1536 is 1.5KB; below 1024, and negative, plain bytes; terabytes have no end; NULL stays NULL."""
    out = F.format_string("%dB", c)
    for k, unit in enumerate("KMGT", 1):
        # format_string rounds a half up, the reference to even
        out = F.when(c >= 1024**k, F.format_string(f"%.1f{unit}B", F.bround(c / float(1024**k), 1))).otherwise(out)
    return F.when(c.isNotNull(), out)


def clock(seconds: Column) -> Column:
    """MM:SS, HH:MM:SS from an hour on, --:-- below 0 and over 999 hours."""
    s = seconds.cast("long")
    hms = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(seconds.isNull() | (seconds < 0) | (seconds > 3600 * 999), "--:--").when(s >= 3600, hms).otherwise(F.format_string("%02d:%02d", F.floor(s / 60), s % 60))


def short_clock(seconds: Column) -> Column:
    """M:SS without hours; below 0 is 0:00."""
    s = F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def ellipsis(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if some are left out."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def cut_bytes(c: Column, n: int) -> Column:
    """At most n bytes of the text, whole characters only."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n).cast("string")), "\ufffd+$", "")


def display_title(context: str = "global") -> Column:
    """A track's label where its composer and work are not (global), or are known from around it."""
    col = F.col
    composer = first_text(col("composer_canonical"), col("composer"))
    work = first_text(col("work_title"), col("work"))
    catalog = blank_to_null(col("catalog"))
    work = F.when(work.isNotNull() & catalog.isNotNull() & ~F.lower(work).contains(F.lower(catalog)), F.concat(work, F.lit(", "), catalog)).otherwise(work)
    movement = blank_to_null(col("movement_title"))
    raw = F.coalesce(first_text(col("title"), col("work"), col("source_item"), col("id")), F.lit(""))
    body = blank_to_null(F.concat_ws(" · ", work, movement))
    if context == "work":
        return F.coalesce(movement, raw)
    if context == "composer":
        return F.coalesce(body, raw)
    plain = F.concat(F.lit("["), F.coalesce(col("source"), F.lit("")), F.lit("] "), raw)
    return F.when(composer.isNull() & body.isNull(), plain).otherwise(F.concat_ws(" — ", composer, F.coalesce(body, raw)))


def media_format(mime: Column, title: Column, by_extension: bool = False) -> Column:
    """The format token of a MIME type and file name, "" for what is no audio. The types are fixed values."""
    ext = F.lower(F.regexp_extract(title, r"(\.[^./]*)$", 1))
    t = (
        F.when(mime == "audio/ogg", F.when(ext == ".opus", "opus").otherwise("ogg"))
        .when(mime == "audio/opus", "opus")
        .when(mime.isin("audio/x-wav", "audio/wav", "audio/wave", "audio/vnd.wave"), "wav")
        .when(mime.isin("audio/mpeg", "audio/mp3"), "mp3")
        .when(mime.isin("audio/flac", "audio/x-flac"), "flac")
        .when(mime.isin("application/ogg", "application/x-ogg"), F.when(ext == ".opus", "opus").when(ext.isin(".ogg", ".oga"), "ogg").otherwise(""))
        .when(mime.startswith("audio/"), "other")
        .otherwise("")
    )
    if not by_extension:
        return t
    own = F.when(ext == ".opus", "opus").when(ext.isin(".ogg", ".oga"), "ogg").when(ext == ".flac", "flac").when(ext.isin(".wav", ".wave"), "wav").when(ext == ".mp3", "mp3").otherwise("")
    return F.coalesce(blank_to_null(t), own)


def label_format(c: Column) -> Column:
    """The format token of an archive's label, "" for what is no audio. The labels are fixed values."""
    low = F.lower(F.trim(c))
    return (
        F.when(low == "ogg vorbis", "ogg").when(low.isin("vbr mp3", "mp3", "128kbps mp3", "64kbps mp3"), "mp3").when(low.isin("opus", "ogg opus"), "opus")
        .when(low.isin("wave", "wav"), "wav").when(low == "apple lossless audio", "other").when(low == "flac", "flac").otherwise("")
    )


def fingerprint_words(c: Column) -> Column:
    """The 32-bit words of a fingerprint text, bad ones skipped; empty for an exact signature."""
    words = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.when(c.startswith("exact:"), F.array().cast("array<bigint>")).otherwise(F.filter(words, lambda x: x.between(0, 4294967295)))
