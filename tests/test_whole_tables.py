"""Catalogue queries over every row, against plain Python on small tables."""

import re

from quaverlake.plans import catalogue, labels

QUERIES = catalogue.QUERIES | labels.QUERIES

TITLES = ["File:Dvořák_Symphony_9.ogg", "  Été  FLAC.mp3", "ΟΔΥΣΣΕΥΣ ΣΑΣ.ogg", "Соната_№_1 - OGG.wav", "夜想曲　第1番　.flac", "\tTab\tbed\u00a0title\u2003wav.x", "ＦＵＬＬ　Ｗｉｄｔｈ", "İstanbul OPUS.ogg", "Plain title.ogg", "v1.2/name", "line\nbreak.og\n", ""]


def _clean(t):
    t = t.removeprefix("File:")
    dot = t.rfind(".")
    return (t[:dot] if dot > t.rfind("/") else t).replace("_", " ").strip()


def _key(t):
    t = re.sub(r"(?i)[ _-]+(ogg|oga|opus|wav|wave|mp3|flac)\Z", "", _clean(t))
    return " ".join("".join("i" if ch == "İ" else ch.lower() for ch in t).split())


def test_all_titles(spark, tmp_path):
    spark.createDataFrame([(t,) for t in TITLES + TITLES[:3] + [None]], "title string").write.parquet(str(tmp_path / "tracks.parquet"))
    got = {r.title: (r.clean, r.key) for r in QUERIES["x6_x7_titles"](spark, str(tmp_path)).collect()}
    assert got == {t: (_clean(t), _key(t)) for t in TITLES}


def test_all_sizes(spark, tmp_path):
    rows = [
        ("a", None, None, None, "--:--"), ("b", 1536, None, "1.5KB", "--:--"), ("c", None, 75.9, None, "01:15"), ("d", -5, 3600.0, "-5B", "01:00:00"), ("e", 0, -1.0, "0B", "--:--"),
        ("f", 1280, 3599.9, "1.2KB", "59:59"), ("g", 3 * 1024**4, 360000.5, "3.0TB", "100:00:00"), ("h", 2**62, 3600.0 * 999, "4194304.0TB", "999:00:00"), ("i", 10**12, 3600.0 * 999 + 1, "931.3GB", "--:--"), ("j", 1023, 0.0, "1023B", "00:00"), ("k", 5, float("nan"), "5B", "--:--"),
    ]
    spark.createDataFrame([(i, 1, b, d) for i, b, d, _, _ in rows], "id string, updated_at bigint, original_bytes bigint, duration_sec double").write.parquet(str(tmp_path / "tracks.parquet"))
    got = {r.id: (r["size"], r["clock"]) for r in QUERIES["x25_x26_sizes"](spark, str(tmp_path)).collect()}
    assert got == {i: (size, clock) for i, _, _, size, clock in rows}


def test_keys_of_every_text(spark, tmp_path):
    import hashlib
    import re
    import unicodedata as U

    rows = [(t, c) for t in ("Sonata № 1", "", None, "Straße", "ｗｉｄｅ", "é" * 3000, "秋雨") for c in ("Dvořák", None, "  ", "Ørsted")]
    spark.createDataFrame([(t, t, c) for t, c in rows + rows[:2]], "title string, work string, composer string").write.parquet(str(tmp_path / "tracks.parquet"))

    def key(t):
        s = "".join(c for c in U.normalize("NFKD", t.lower()) if U.category(c) != "Mn")
        return re.sub(r"[\W_]+", " ", s).strip()

    got = {(r.work, r.composer): (r.composer_key, r.work_id) for r in QUERIES["x9_x10_track_keys"](spark, str(tmp_path)).collect()}
    want = {(w, c): (None if c is None else key(c), hashlib.sha1(f"{key(c)}|{key(w)}".encode()).hexdigest() if c and w and key(c) and key(w) else None) for w, c in rows}
    assert got == want
    plain = {r.title: r.key for r in QUERIES["x8_all_plain_keys"](spark, str(tmp_path)).collect()}
    assert (plain["Straße"], plain["ｗｉｄｅ"], plain[""], plain["秋雨"]) == ("strasse", "wide", "", "") and None not in plain
