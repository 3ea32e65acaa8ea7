"""Operators of the catalogue on small tables, ties, nulls and empty tables."""

import numpy as np
from pyspark.sql import functions as F

from quaverlake.operators import catalogue as C
from quaverlake.operators import dedup, graph, rates, search
from quaverlake.session import current
from quaverlake.sources import landed
from quaverlake.streaming import progress


def test_current_takes_the_newest_and_drops_null_ids(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, None), (None, 3, "z")], "id string, updated_at bigint, status string")
    assert sorted(map(tuple, current(df, "status").collect())) == [("a", "y"), ("b", None)]
    assert current(df.limit(0), "status").count() == 0


def test_browse_and_works(spark):
    cols = "id string, source string, composer string, title string, work_id string, work_title string, status string, caf_path string, dup_of string"
    rows = [
        ("01A", "orchestral", "Ludwig", "mvt1", "w1", "Symphony No. 5", "done", "a.caf", None),
        ("01B", "orchestral", "Ludwig", "MVT1", "w1", "Symphony No. 5", "done", "b.caf", None),
        ("01C", "piano", None, "ballade", "w2", "Ballade", "done", "c.caf", None),
        ("01D", "piano", "", None, None, None, "done", "d.caf", None),
        ("01E", "piano", "X", "t", None, None, "failed", None, None),
    ]
    t = spark.createDataFrame(rows, cols)
    works = spark.createDataFrame([("w1", "Symphony No. 5 in C", "symphony 5")], "id string, title string, sort_key string")
    assert sorted(map(tuple, C.browse(t, "source").collect())) == [("orchestral", "orchestral", 2), ("piano", "piano", 2)]
    assert sorted(map(tuple, C.browse(t, "composer", source="piano").collect())) == [("—", "", 2)]
    assert sorted(map(tuple, C.browse(t, "title", source="orchestral", composer="Ludwig").collect())) == [("MVT1", "MVT1", 2)]
    assert C.browse(t, "title", source="piano", composer="").count() == 2
    got = {r.key: (r["name"], r.n) for r in C.browse_works(t, works).collect()}
    assert got == {"w1": ("Symphony No. 5 in C", 2), "w2": ("Ballade", 1), None: ("—", 1)}
    assert C.browse_works(t.limit(0), works).count() == 0


def test_insert_and_upsert(spark):
    old = spark.createDataFrame([("s", "u1", "1")], "source string, original_url string, id string")
    new = spark.createDataFrame([("s", "u1", "2"), ("s", "u2", "3"), ("s", "u2", "3")], old.schema)
    once = C.insert_if_absent(new, old, "source", "original_url")
    assert once.count() == 2 and C.insert_if_absent(new, once, "source", "original_url").count() == 2
    a = spark.createDataFrame([("k", 1, 10)], "id string, n int, made int")
    b = spark.createDataFrame([("k", 2, 20), ("l", 3, 30)], a.schema)
    assert sorted(map(tuple, C.upsert(b, a, "id", ("made",)).collect())) == [("k", 2, 10), ("l", 3, 30)]


def test_best_variant(spark):
    f = spark.createDataFrame([("i", "mp3", 0), ("i", "ogg", 1), ("i", "OGG", 2), ("j", "aac", 0)], "item string, format string, ord int")
    got = {r.item: (r.format, r.variants) for r in C.best_variant(f, ["item"], F.col("format"), ["opus", "ogg", "wav", "mp3"], F.col("ord")).collect()}
    assert got == {"i": ("ogg", 3), "j": ("aac", 1)}


def test_range_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:04d}", float(v)) for i, v in enumerate(rng.uniform(0, 60, 300))] + [("x", None), ("y", 3.0), ("z", 6.0)]
    got = {(r.id_a, r.id_b) for r in dedup.range_pairs(spark.createDataFrame(rows, "id string, v double"), "id", "v", 3.0).collect()}
    v = [r for r in rows if r[1] is not None]
    assert got == {(a, b) for a, x in v for b, y in v if a < b and abs(x - y) <= 3.0}


def test_fingerprints(spark):
    a = np.arange(1, 22, dtype=np.uint32)
    assert dedup.bit_error_rate(a, a) == 0.0
    assert dedup.bit_error_rate(np.zeros(40, np.uint32), np.full(40, 0xFFFFFFFF, np.uint32)) == 1.0
    assert dedup.bit_error_rate(a[:10], a[:10]) == 1.0
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 40, dtype=np.uint32)
    text = lambda w: ",".join(map(str, w))
    rows = [
        ("a", 10.0, "s1", text(base)),
        ("b", 11.0, "s2", text(np.concatenate([base[3:], base[:3]]))),
        ("c", 12.0, "s2", "exact:1:2:3"),
        ("d", 30.0, "s2", text(base)),
        ("e", 31.0, None, text(rng.integers(0, 1 << 32, 40, dtype=np.uint32)) + ",oops"),
        ("f", None, "s1", text(base)),
        ("g", 9.0, "", ""),
    ]
    t = spark.createDataFrame(rows, "id string, duration_sec double, original_sha1 string, audio_fingerprint string")
    pairs = dedup.duplicate_pairs(t)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("b", "c")]
    assert sorted(map(tuple, dedup.closure(pairs).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert dedup.closure(pairs.limit(0)).count() == 0


def test_long_chain_closes(spark):
    n = 200
    chain = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(n)], "id_a string, id_b string")
    assert {r.root for r in dedup.closure(chain).collect()} == {"0000"}


def test_canonical(spark):
    m = spark.createDataFrame([("g", "b", 2, 100), ("g", "a", 4, 50), ("h", "y", 1, 5), ("h", "x", 1, 5)], "root string, id string, licence int, bytes int")
    assert sorted(map(tuple, dedup.canonical(m, "root", F.col("licence"), F.col("bytes")).collect())) == [("g", "a"), ("h", "x")]


def test_traversal_cycles(spark):
    e = spark.createDataFrame([("r", "a", False), ("a", "r", False), ("a", "b", False), ("b", "c", False), ("r", "c", False), ("c", "f", True), ("r", "MIDI files", False)], "parent string, child string, leaf boolean")
    roots = spark.createDataFrame([("r",)], "root string")
    got = {(r.node, r.depth) for r in graph.reach(e, roots, 3, ["midi"]).collect()}
    assert got == {("r", 0), ("a", 1), ("c", 1), ("b", 2), ("f", 2)}


def test_ewma(spark):
    df = spark.createDataFrame([("s", 2, 10.0), ("s", 1, 0.0), ("s", 3, -5.0)], "k string, at int, v double")
    assert abs(rates.ewma(df, "k", F.col("at"), F.col("v"), 0.2).first().ewma - (0.2 * 10 * 0.8)) < 1e-12


def test_search_on_accents_and_missing_terms(spark):
    from quaverlake.functions.text import keywords, match_terms

    d = spark.createDataFrame([("1", "Dvořák Symphony"), ("2", "Symphony of the Sea"), ("3", None)], "id string, t string")
    ix = search.index(d, "id", keywords(F.col("t")))
    assert [r.id for r in search.search(ix, "id", match_terms("Dvořák symph", "unicode")).collect()] == ["1"]
    assert search.search(ix, "id", ["nothing"]).count() == 0
    assert [r.id for r in search.search(ix, "id", ["symph"], 1, d.where("id = '2'")).collect()] == ["2"]


def test_landed_json(spark):
    doc = '{"metadata":{"identifier":"it","title":"T","creator":["A","B"],"date":"c. 1901"},"files":[{"name":"x y.ogg","format":"Ogg Vorbis","size":"12"},{"name":"x.png","format":"PNG","size":"1"}]}'
    r = landed.archive_files(spark.createDataFrame([(doc,), (None,), ("broken",)], "d string"), "d").collect()
    assert len(r) == 1 and (r[0].composer, r[0].year, r[0].format, r[0].bytes, r[0].url) == ("A; B", 1901, "ogg", 12, "https://archive.example/download/it/x%20y.ogg")
    page = '{"query":{"pages":{"7":{"title":"File:A_b.oga","imageinfo":[{"url":"u","mime":"audio/ogg","size":5,"extmetadata":{"LicenseShortName":{"value":"<b>CC0</b>"}}}]}}}}'
    p = landed.image_files(spark.createDataFrame([(page,)], "d string"), "d").first()
    assert (p.work_key, p.format, p.license_short, p.performer) == ("a b", "ogg", "CC0", "")


def test_files(spark, tmp_path):
    (tmp_path / "01A.caf").write_bytes(b"1234")
    (tmp_path / "01A.opus").write_bytes(b"12")
    got = {(r.id, r.bytes) for r in landed.inventory(spark, str(tmp_path), "*.caf").collect()}
    assert got == {("01A", 4)}


def test_stream_drops_repeats_and_ingest_is_idempotent(spark, tmp_path):
    rows = [("s", "download", "t", 5, True, False, False, None, "2024-01-01 00:00:00"), ("s", "download", "t", 5, True, False, False, None, "2024-01-01 00:00:00"), ("s", "discover", None, None, False, True, False, "e", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "source string, stage string, track_id string, bytes_delta bigint, completed boolean, failed boolean, skipped boolean, err string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    s = progress.distinct_events(progress.events(spark, str(tmp_path / "in")))
    got = {(r.stage, r.events, r.bytes, r.failed) for r in progress.progress_by_source(progress.drained(s, spark)).collect()}
    assert got == {("download", 1, 5, 0), ("discover", 1, 0, 1)}
    new = spark.createDataFrame([("s", "u1"), ("s", "u2"), ("s", "u2")], "source string, url string")
    for _ in range(2):
        progress.ingest(new, spark, str(tmp_path / "t"), "source", "url")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
