"""Rules, lists, candidates and categories on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.functions import rules as R
from quaverlake.functions import text as X
from quaverlake.operators import candidates, dedup, listing, search
from quaverlake.sources import landed, registry


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_registry():
    assert registry.resolve([]) == registry.resolve(["all"]) == [s[0] for s in registry.SOURCES] and len(registry.SOURCES) == 11
    assert registry.resolve(["navy", "chopin"]) == ["navy", "chopin"]
    with pytest.raises(ValueError, match="unknown source"):
        registry.resolve(["nope"])


def test_audio_gate(spark):
    yes = ["audio/ogg", "audio/opus", "audio/x-wav", "audio/mpeg", "audio/flac", "audio/x-flac", "audio/mp3", "application/ogg", "application/x-ogg"]
    no = ["audio/midi", "video/webm", "image/jpeg", "application/pdf", "application/octet-stream", "", None, "video/mp4"]
    rows = [(m, "x.bin", True) for m in yes] + [(m, "x.bin", False) for m in no] + [("application/octet-stream", f"x{e}", True) for e in (".ogg", ".oga", ".flac", ".wav", ".mp3", ".OPUS")] + [(None, None, False)]
    t = spark.createDataFrame(rows, "m string, t string, want boolean")
    assert t.where(R.audio_mime(F.col("m"), F.col("t")) != F.col("want")).count() == 0
    f = spark.createDataFrame([("OGG", True), ("m4a", True), ("png", False), (None, False)], "f string, want boolean")
    assert f.where(R.audio_format(F.col("f")) != F.col("want")).count() == 0


def test_scalars(spark):
    lit = F.lit
    assert one(spark, R.license_name(lit("http://x/publicdomain/zero/1.0")), R.license_name(lit("http://x/BY-SA/4.0")), R.license_name(lit("http://x/by/3.0")), R.license_name(lit("")), R.license_name(lit("http://y"))) == ("CC0", "CC BY-SA", "CC BY", "", "see license url")
    assert one(spark, R.license_rank(lit("CC-BY"), lit(None)), R.license_rank(lit("CC0"), lit("")), R.license_rank(lit("PD"), lit(None)), R.license_rank(lit(None), lit("by-sa"))) == (2, 4, 3, 1)
    assert one(spark, R.source_rank(lit("navy")), R.source_rank(lit("bach_wtc1")), R.source_rank(lit(None))) == (20, 60, 10)
    assert one(spark, R.rate_limited(lit("http 403")), R.retryable(lit("http 503")), R.retryable(lit("timeout")), R.retryable(lit(None)), R.retryable_status(lit(500)), R.retryable_status(lit(404))) == (True, True, False, False, True, False)
    assert one(spark, R.like_prefix(lit("CAP: x"), "cap:", "requeue:"), R.like_prefix(lit("no"), "cap:")) == (True, False)
    assert one(spark, R.source_ending(lit("oga")), R.source_ending(lit("aac")), R.source_ending(lit(None))) == ("oga", "dat", "dat")
    assert one(spark, R.status_cell(lit("done")), R.status_cell(lit("converting")), R.size_cell(lit("done"), lit(1536), lit(None).cast("bigint"))) == ("●done", "◐conv", "opus 1.5KB caf 0B")
    assert one(spark, R.exact_signature(lit(5), lit(73.9), lit("ab")), R.exact_signature(lit(None), lit(None), lit(None))) == ("exact:5:73:ab", "exact:0:0:")
    assert one(spark, R.masked_url(lit("https://h/o.caf?X-Amz-Credential=k&a=1&X-Amz-Signature=s")), R.masked_url(lit("https://h/o"))) == ("https://h/o.caf?X-Amz-Credential=REDACTED&a=1&X-Amz-Signature=REDACTED", "https://h/o")
    assert one(spark, R.decode_cursor(lit('{"i":7}')), R.decode_cursor(lit("12")), R.decode_cursor(lit("{broken")), R.decode_cursor(lit(None)), R.decode_cursor(R.encode_cursor(lit(3)))) == (7, 12, 0, 0, 3)
    assert one(spark, R.key_parts(lit("title:a:b")), R.key_parts(lit("w1"))) == ((None, "a:b"), ("w1", None))
    assert one(spark, R.padded(lit("ab"), 4), R.padded(lit("abcdef"), 4), R.padded(lit(None), 2)) == ("ab  ", "abcd", "  ")
    assert R.split_list(" a, ,b,") == ["a", "b"]
    assert one(spark, R.audio_url("https://m/", lit("x y"))) == ("https://m/audio/x%20y.caf",)


@pytest.mark.parametrize(
    ("backend", "opus", "caf", "opus_there", "caf_there", "want"),
    [("beep", "o", "c", True, True, "o"), ("beep", "o", "c", False, True, "c"), ("beep", "o", "c", False, False, "o"), ("beep", "", "c", False, False, "c"), ("afplay", "o", "c", True, True, "c"), ("afplay", "o", "c", True, False, "o"), ("afplay", None, "c", False, False, "c"), ("ffplay", "o", "c", False, True, "o"), ("ffplay", None, "c", False, False, "c"), ("ffplay", None, None, None, None, "")],
)
def test_playback(spark, backend, opus, caf, opus_there, caf_there, want):
    assert one(spark, R.playback_path(backend, F.lit(opus), F.lit(caf), F.lit(opus_there), F.lit(caf_there))) == (want,)


def test_select_best_and_variants(spark):
    f = spark.createDataFrame([("s", "i", 2, "x", "wav", 3, "T2"), ("s", "i", 0, "a", "MP3", 1, "T0"), ("s", "i", 1, "b", "ogg", 2, "T1"), ("s", "j", 0, "c", "aac", 1, "U"), ("s", "k", 0, "", "ogg", 1, "V"), ("s", "l", 0, "d", "txt", 1, "W")], "source string, source_item string, ord int, url string, format string, bytes bigint, title string")
    c = candidates.group_variants(f, ["source", "source_item"], ["ord"], {"url": F.col("url"), "format": F.col("format"), "bytes": F.col("bytes")}, ["title"])
    got = {r.source_item: r for r in c.collect()}
    assert got["i"].title == "T0" and [x.format for x in got["i"].files] == ["MP3", "ogg", "wav"]
    best = lambda prefer, fallback: {r.source_item: r.b and r.b.format for r in c.select("source_item", candidates.select_best(F.col("files"), prefer, fallback).alias("b")).collect()}
    assert best(["opus", "ogg", "wav", "mp3"], False) == {"i": "ogg", "j": None, "k": "ogg", "l": None}
    assert best(["mp3", "ogg", "mp3"], True) == {"i": "ogg", "j": "aac", "k": "ogg", "l": None}
    rows = {r.source_item: r for r in candidates.ingest(c, ["ogg"], False).collect()}
    assert set(rows) == {"i", "j", "l"}  # k has no URL
    assert (rows["i"].status, rows["i"].original_url, rows["j"].status, rows["j"].stage_error) == ("discovered", "b", "skipped", "no preferred format")
    assert {r.stage_error for r in candidates.ingest(c, ["ogg"], True, F.col("title") == "T0").collect()} == {None, "license not allowed", "no preferred format"}
    assert candidates.ingest(c.limit(0), ["ogg"], False).count() == 0


COLS = "id string, source string, composer string, work string, work_title string, title string, work_id string, movement_index int, status string, caf_path string, dup_of string, audio_fingerprint string, created_at bigint, next_attempt_at bigint, enriched_at bigint"


def library(spark):
    rows = [
        ("3", "s", "A", "b", "y", "t2", "w", 2, "done", "c", None, None, 3, None, None),
        ("2", "s", "A", "a", "z", "T1", "w", 1, "done", "c", None, "1,2", 2, None, 5),
        ("1", "s", "A", None, None, "t2", None, None, "done", "c", "2", "1,2", 1, None, None),
        ("4", "s", None, None, None, None, None, None, "discovered", None, None, None, 4, 10, None),
        ("5", "s", None, None, None, None, None, None, "discovered", None, None, None, 5, None, None),
    ]
    return spark.createDataFrame(rows, COLS)


def test_lists(spark):
    t = library(spark)
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(listing.work_tracks(t, "w", 9)) == ["2", "3"] and ids(listing.work_tracks(t, "title:t2", 9)) == ["3"] and ids(listing.work_tracks(t, "title:none", 9)) == []
    assert ids(listing.listed(t, 9)) == ["2", "3"] and ids(listing.listed(t, 9, "work_title")) == ["3", "2"] and ids(listing.all_tracks(t, 3)) == ["4", "5", "2"]
    assert ids(listing.oldest(t, "discovered", F.lit(9), 2)) == ["5"] and ids(listing.oldest(t, "discovered", F.lit(10), 1)) == ["4"]
    assert ids(listing.to_enrich(t)) == ["1", "3"] and ids(listing.to_enrich(t, True, 2)) == ["1", "2"]
    assert ids(listing.to_fingerprint(t)) == ["3"] and ids(listing.fingerprinted(t)) == ["2"]
    assert tuple(listing.publishable(t).first()) == (1, False) and tuple(listing.publishable(t.limit(0)).first()) == (0, True)
    assert ids(listing.lookup(t, "4")) == ["4"] and ids(listing.upload_order(t)) == ["2", "3"]
    ix = search.built(search.index(t, "id", X.keywords(F.col("title"))), "id")
    assert ids(listing.typed_search(t, ix, " ? ", True, 9)) == ["2", "3"] and ids(listing.typed_search(t, ix, "T2", True, 9)) == ["3"] and sorted(ids(listing.typed_search(t, ix, "t2 T2", False, 9))) == ["1", "3"]
    assert ids(listing.typed_search(t, ix, "absent", False, 9)) == []
    empty = search.built(search.index(t.limit(0), "id", X.keywords(F.col("title"))), "id")
    assert ids(listing.typed_search(t, empty, "t2", False, 9)) == []
    e = spark.createDataFrame([("w", 1, "a"), ("w", 2, None), (None, 1, "b")], "worker string, at int, what string")
    assert sorted(map(tuple, listing.worker_register(e, "worker", F.col("at")).collect()), key=str) == [("w", 2, None), (None, 1, "b")]


def test_catalogue_schema(spark, tmp_path):
    none = listing.open_catalogue(spark, str(tmp_path / "new"))
    assert none.count() == 0 and len(none.columns) == 44 and len(listing.TRACK_COLS) == 36
    library(spark).write.parquet(str(tmp_path / "t"))
    full = listing.full_rows(listing.open_catalogue(spark, str(tmp_path / "t"))).where("id = '4'").first()
    assert full.title == "" and full.year == 0 and full.composer_corrected is False and full.status == "discovered"


def test_categories(spark):
    links = [(None, "Category:Audio files of music by Ann Bell", False), (None, "Category:Cy Dorn's recordings", False), ("Category:Audio files of music by Ann Bell", "Category:Sonata played by Bo Crane", False), ("Category:Sonata played by Bo Crane", "Category:Audio files of music by Ann Bell", False), ("Category:Sonata played by Bo Crane", "File:One.ogg", True), ("Category:Audio files of music by Ann Bell", "File:Two.ogg", True), ("Category:Audio files of music by Ann Bell", "Category:Scores of Bell", False), ("Category:Scores of Bell", "File:Three.ogg", True), ("Category:Cy Dorn's recordings", "File:Two.ogg", True)]
    edges = spark.createDataFrame(links, "parent string, child string, leaf boolean")
    pages = ",".join(f'"{i}":{{"title":"File:{n}.ogg","imageinfo":[{{"url":"u{i}","mime":"application/ogg","size":5,"extmetadata":{{"Artist":{{"value":"<i>Own</i>"}}}}}}]}}' for i, n in enumerate(("One", "Two", "Three")))
    images = landed.image_files(spark.createDataFrame([('{"query":{"pages":{' + pages + "}}}",), ('{"query":{"pages":{"9":{"title":"File:None.ogg"}}}}',)], "d string"), "d", True)
    assert images.count() == 3
    got = {(r.composer, r.source_item, r.performer) for r in landed.category_files(edges, images, 3, ["scores"]).collect()}
    assert got == {("Ann Bell", "File:One.ogg", "Bo Crane"), ("Ann Bell", "File:Two.ogg", "Own"), ("Cy Dorn", "File:Two.ogg", "Own")}
    assert {r.composer for r in landed.category_files(edges, images, 3, None, ["ANN BELL"]).collect()} == {"Ann Bell"}


def test_links_close_to_the_same_groups_as_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    base = [r.integers(0, 1 << 32, 60, dtype=np.uint64) for _ in range(12)]
    rows = []
    for i in range(120):
        w = base[i % 12].copy()
        flip = r.random((len(w), 32)) < r.choice([0.05, 0.15, 0.3])
        w ^= (flip * (np.uint64(1) << np.arange(32, dtype=np.uint64))).sum(1).astype(np.uint64)
        w = w[r.integers(0, 6) :]
        fp = ",".join(map(str, w)) if i % 10 else f"exact:1:2:{i % 3}"
        rows.append((f"{i:03d}", float(r.uniform(0, 30)) if i % 17 else None, f"s{i % 40}" if i % 4 == 0 else "", fp))
    rows += [("x", 5.0, None, "1,2,3"), ("y", 5.0, None, None), ("z", 5.0, None, "exact:1:2:0")]
    t = spark.createDataFrame(rows, "id string, duration_sec double, original_sha1 string, audio_fingerprint string")
    words = lambda fp: np.array([] if fp.startswith("exact:") else [int(x) for x in fp.split(",")], np.uint32)
    want = set()
    for a, da, sa, fa in rows:
        for b, db, sb, fb in rows:
            if a < b and fa and fb and abs((da or 0) - (db or 0)) <= 3:
                same = sa and sa == sb or fa.startswith("exact:") and fa == fb
                if same or dedup.bit_error_rate(words(fa), words(fb)) <= 0.2:
                    want.add((a, b))
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in want:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    roots = {v: find(v) for v in up}
    for block in (256, 7):
        monkeypatch.setattr(dedup, "BLOCK", block)
        pairs = dedup.duplicate_pairs(t)
        assert {tuple(p) for p in pairs.collect()} <= want
        assert {q.id: q.root for q in dedup.closure(pairs).collect()} == roots
    assert dedup.duplicate_pairs(t.limit(0)).count() == 0
