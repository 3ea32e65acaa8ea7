"""Scalar functions against fixed values."""

import pytest
from pyspark.sql import functions as F

from quaverlake.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("raw", "year"), [("1965", 1965), ("recorded in 1842", 1842), ("no year here", 0), ("2024-05-01", 2024)])
def test_year(spark, raw, year):
    assert one(spark, X.parse_year, raw) == year


@pytest.mark.parametrize(("label", "fmt"), [("Ogg Vorbis", "ogg"), ("VBR MP3", "mp3"), ("Apple Lossless Audio", "other"), ("WAVE", "wav"), ("Opus", "opus"), ("PNG", "")])
def test_label(spark, label, fmt):
    assert one(spark, X.label_format, label) == fmt


@pytest.mark.parametrize(
    ("mime", "name", "fmt"),
    [("audio/ogg", "a.oga", "ogg"), ("audio/ogg", "a.opus", "opus"), ("audio/x-wav", "a", "wav"), ("audio/mpeg", "a", "mp3"), ("application/ogg", "a.ogg", "ogg"), ("application/ogg", "a.ogv", ""), ("video/webm", "a.webm", "")],
)
def test_mime(spark, mime, name, fmt):
    assert one(spark, X.media_format, mime, name) == fmt


@pytest.mark.parametrize(
    ("a", "b"),
    [("Beethoven_Symphony_5_opus.ogg", "Beethoven_Symphony_5.mp3"), ("Antonín Dvořák - Symphony 9.ogg", "Antonin Dvorak - Symphony 9.wav")],
)
def test_plain_keys_meet(spark, a, b):
    assert one(spark, X.plain_title_key, a) == one(spark, X.plain_title_key, b) != ""


@pytest.mark.parametrize(("a", "b"), [("Béla_Bartók", "bela bartok"), ("Georg_Frideric_Händel", "georg frideric handel"), ("Leoš_Janáček", "leos janacek"), ("Mozart Requiem FLAC", "mozart requiem")])
def test_plain_key(spark, a, b):
    assert one(spark, X.plain_title_key, a) == b


def test_keywords(spark):
    got = one(spark, X.keywords, "The Pathétique Sonata and the Op. 13", "Sonata")
    assert list(got) == ["13", "op", "pathetique", "sonata"]


def test_title_parts(spark):
    p = one(spark, X.parse_title, "Chopin, Ballade No. 1 - United States Marine Band")
    assert (p.composer, p.work, p.movement) == ("Chopin", "Ballade No. 1", "")
    p = one(spark, X.parse_title, "Bach, Suite 1, BWV 1007 - Prelude")
    assert (p.composer, p.work, p.movement) == ("Bach", "Suite 1, BWV 1007", "Prelude")


@pytest.mark.parametrize(
    ("cat", "composer"),
    [
        ("Category:Audio files of music by Ludwig van Beethoven", "Ludwig van Beethoven"),
        ("Category:Audio files of classical music by Frédéric Chopin", "Frédéric Chopin"),
        ("Category:Beethoven's Piano Sonatas Played by Artur Schnabel", "Beethoven"),
        ("Category:Beethoven Misc", "Beethoven Misc"),
    ],
)
def test_category_composer(spark, cat, composer):
    assert one(spark, X.category_composer, cat) == composer


@pytest.mark.parametrize(("cat", "who"), [("Played by Artur Schnabel", "Artur Schnabel"), ("x Played by John Smith, orchestra", "John Smith"), ("Played by Perlman (violin)", "Perlman"), ("none", "")])
def test_category_performer(spark, cat, who):
    assert one(spark, X.category_performer, cat) == who


@pytest.mark.parametrize(("raw", "text"), [('"hello"', "hello"), ('["a","b"]', "a; b"), ("null", ""), ("12", "12")])
def test_json_text(spark, raw, text):
    assert one(spark, X.json_text, raw) == text


@pytest.mark.parametrize(("q", "terms"), [("Beethoven Symphony 5", ["beethoven", "symphony", "5"]), ("  op. 67 !!", ["op", "67"]), ("", [])])
def test_unicode_terms(q, terms):
    assert X.match_terms(q, "unicode") == terms


def test_ascii_terms():
    assert X.match_terms("Dvořák op.23") == ["dvok", "op23"]


def test_clocks_and_sizes(spark):
    df = spark.createDataFrame([(75.4, 1536), (3700.0, 10), (-1.0, 5 * 1024**3)], "d double, b bigint")
    got = df.select(X.clock(F.col("d")), X.short_clock(F.col("d")), X.human_bytes(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("01:15", "1:15", "1.5KB"), ("01:01:40", "61:40", "10B"), ("--:--", "0:00", "5.0GB")]


def test_display(spark):
    cols = "id string, source string, source_item string, title string, work string, composer string, composer_canonical string, work_title string, catalog string, movement_title string"
    rows = [
        ("1", "s", "i", "t", "", "", "Ludwig van Beethoven", "Symphony No. 5 in C minor", "Op. 67", "I. Allegro con brio"),
        ("2", "s", "i", "t", "", "", "", "Prelude No. 1 in C major, BWV 846", "BWV 846", ""),
        ("3", "navy", "i", "Anchors Aweigh", None, None, None, None, None, None),
        ("4", "s", "i", "Ballade No. 1", None, "Chopin", None, None, None, None),
    ]
    got = spark.createDataFrame(rows, cols).orderBy("id").select(*[X.display_title(c) for c in ("global", "composer", "work")]).collect()
    assert tuple(got[0]) == ("Ludwig van Beethoven — Symphony No. 5 in C minor, Op. 67 · I. Allegro con brio", "Symphony No. 5 in C minor, Op. 67 · I. Allegro con brio", "I. Allegro con brio")
    assert got[1][0] == "Prelude No. 1 in C major, BWV 846"
    assert got[2][0] == "[navy] Anchors Aweigh"
    assert got[3][0] == "Chopin — Ballade No. 1"


def test_path_host_and_bytes(spark):
    assert one(spark, X.path_escape, "a b/ü(1)~&=.ogg") == "a%20b/%C3%BC%281%29~&=.ogg"
    assert one(spark, X.url_host, "https://u:p@h.example:81/x") == "h.example:81"
    assert one(spark, X.url_host, "nonsense") == ""
    assert one(spark, lambda c: X.cut_bytes(c, 4), "aüüü") == "aü"
    assert one(spark, lambda c: X.ellipsis(c, 4), "abcdef") == "abc…"
    assert one(spark, X.first_json_object, 'x ```{"a":{"b":1}}``` y') == '{"a":{"b":1}}'
    assert one(spark, X.lenient_int, " 12 ") == 12 and one(spark, X.lenient_int, "x") == 0
    assert one(spark, X.strip_html, "<b>A &amp; B</b> ") == "A & B"
