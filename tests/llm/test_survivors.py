"""Survivors and built records, with ties, missing and impossible values."""

from quaverlake.llm.survivors import best_tracks, golden_tracks

COLS = "id string, source string, original_format string, original_bytes bigint, updated_at bigint, trust string"


def tables(spark):
    rows = [
        ("a", "Good-Source ", ".ogg", 5000, 1, "x"),
        ("a", "Good-Source ", ".ogg", 5000, 1, "x"),
        ("b", "good source", "Ogg Vorbis", 9000, 2, "x"),
        ("c", "good_source", "flac", 10**6, 3, "x"),
        ("d", "bad", "opus", 10**7, 4, "x"),
        ("e", None, None, None, 5, "x"),
        ("f", "nowhere", "bin", 2**63 - 1, 6, "x"),
        ("g", "nowhere", "bin", -1, 7, "x"),
        ("h", "nowhere", "bin", 4096, 8, "x"),
    ]
    tracks = spark.createDataFrame(rows, COLS)
    trust = spark.createDataFrame([("good_source", 60), ("bad", 5)], "source string, trust int")
    pref = spark.createDataFrame([("opus", 1), ("ogg", 2), ("flac", 5)], "fmt string, pref int")
    groups = spark.createDataFrame([(t, "a") for t in "abcd"] + [(t, "e") for t in "ef"] + [(t, "g") for t in "gh"] + [("zz", "zz")], "track_id string, group_id string")
    return groups, tracks, trust, pref


def test_best(spark):
    got = {r.group_id: r.survivor_id for r in best_tracks(*tables(spark)).collect()}
    assert got == {"a": "b", "e": "e", "g": "h", "zz": "zz"}


def test_golden(spark):
    got = {r.group_id: tuple(r)[1:] for r in golden_tracks(*tables(spark)).collect()}
    assert got["a"] == (4, "good_source", "ogg", 10**6)
    assert got["e"] == (2, "nowhere", None, None)
    assert got["g"] == (2, "nowhere", None, 4096)


def test_empty(spark):
    g, t, a, b = tables(spark)
    assert best_tracks(g.limit(0), t, a, b).count() == 0
    assert {r.survivor_id for r in best_tracks(g, t.limit(0), a.limit(0), b.limit(0)).collect()} == {"a", "e", "g", "zz"}
