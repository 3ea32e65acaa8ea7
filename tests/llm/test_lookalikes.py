"""One form for texts that look the same."""

import pytest

from quaverlake.llm.lookalikes import Rewriter, classes, confusable_letters, count_lookalikes, disguised

REWRITE = Rewriter()
SAME = ["", "plain", "Dvořák", "秋雨小夜曲", "سماعي الميناء", "नदी का गीत", "Песня старого маяка", "Габриел Зеллесхофер", "Sonata Песня", "น้ำใจ", "ΣΩΚΡΑΤΗΣ", "5º – “x”"]
CHANGED = {
    "\uff21\uff4e\uff4e\u3000\uff22": "Ann B",
    "Ann\xa0Bell": "Ann Bell",
    "Ann\u2007Bell": "Ann Bell",
    "A\u200bn\u200dn\ufeff": "Ann",
    "so\xadnata": "sonata",
    "Dvor\u030ca\u0301k": "Dvo\u0159\xe1k",
    "\u041carch in \u0410 minor": "March in A minor",
    "N\u03bf. 1": "No. 1",
    "\ufb02ute": "flute",
    "1867\u20111940": "1867-1940",
    "\u041fe\u0441\u043d\u044f \u043ca\u044f\u043a\u0430": "\u041f\u0435\u0441\u043d\u044f \u043c\u0430\u044f\u043a\u0430",
}


@pytest.mark.parametrize("text", SAME)
def test_same(text):
    assert REWRITE(text) == text


@pytest.mark.parametrize("text", CHANGED)
def test_changed(text):
    assert REWRITE(text) == CHANGED[text]
    assert REWRITE(REWRITE(text)) == REWRITE(text)


def test_classes_are_transitive():
    assert {"A", "Ａ", "А", "Α"} <= set(classes()["A"])


def test_frequent_form_stands_for_the_class():
    odd = "a\u00a0b c"
    assert Rewriter({" ": 5, "\u00a0": 1})(odd) == "a b c"
    assert Rewriter({" ": 1, "\u00a0": 5})(odd) == "a\u00a0b\u00a0c"


def test_operator(spark):
    sonata, combining, composed = "S\u043enata", "Dvor\u030ca\u0301k", "Dvo\u0159\u00e1k"
    rows = [("1", sonata, "Ann", 0), ("1", sonata, "Ann", 1), ("2", None, "", 0), ("3", "x" * 20000 + "\u200b", "Ann\u00a0Bell", 0), (None, sonata, "a b", 0), ("4", composed, combining, 0)]
    df = spark.createDataFrame(rows, "id string, title string, composer string, text int")
    got = sorted((r.id, r.field, r.plain) for r in disguised(df, "id", ("title", "composer")).collect())
    assert got == [("1", "title", "Sonata"), ("3", "composer", "Ann Bell"), ("3", "title", "x" * 20000), ("4", "composer", composed)]
    assert disguised(df.limit(0), "id", ("title", "composer")).count() == 0
    counts = count_lookalikes(df, "title")
    assert counts["\u043e"] == 3 and counts["n"] >= 3


def test_letters_of_all_scripts(spark):
    more = confusable_letters(spark)
    assert {("Ꭺ", "A"), ("ꓢ", "S"), ("Օ", "O")} <= set(more)
    rewrite = Rewriter(None, more)
    assert [rewrite(t) for t in ("Ꮪonatа", "Տonata", "ꓢonata", "ⅼa")] == ["Sonata", "Sonata", "Sonata", "la"]
    assert all(rewrite(t) == t for t in ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "Sonata ᏣᎳᎩ", "Սիմֆոնիա in C", "Συμφωνία", "Śnieg", "שלום in C"))


def test_rewriting_goes_on_until_nothing_changes():
    odd = "e" + "​́" * 1 + "".join("­́" for _ in range(8))
    once = REWRITE(odd)
    assert REWRITE(once) == once and "­" not in once and "​" not in once
