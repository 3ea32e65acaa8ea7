"""Names: parts, distances, the trie join against brute force, variants and canonical entries."""

import random

import pytest

from quaverlake.llm.canon import canonical_tracks, work_parts
from quaverlake.llm.names import bound, flat, given_fits, osa, person, placeholder
from quaverlake.llm.triejoin import Trie, near_words
from quaverlake.llm.variants import ensemble, name_entities, variant_pairs


@pytest.mark.parametrize(
    ("text", "parts"),
    [("Ann Bell", ("bell", ["ann"])), ("Bell, A.", ("bell", ["a."])), ("Prof. Ann T. Bell (1801-1850)", ("bell", ["ann", "t."])), ('Ann "Nan" Bell', ("bell", ["ann"])), ("Анн Белл", ("bell", ["ann"])), ("ＡＮＮ　ＢＥＬＬ", ("bell", ["ann"])), ("Bell", ("bell", [])), ("", ("", []))],
)
def test_person(text, parts):
    assert person(text) == parts


def test_flat_placeholder_and_fit():
    assert flat("Söndrå Øst") == "sondra ost"
    assert all(map(placeholder, ["???", "n/a", "[none]", "Trad.", "Anonymous", ""])) and not placeholder("Ann Bell")
    assert given_fits("j.", "johannes") > 0 and given_fits("hans", "johannes") > 0 and given_fits("joh.", "johannes") > 0 and given_fits("k.", "johannes") == 0


def test_osa():
    assert osa("abcd", "abdc", 2) == 1 and osa("abcd", "abcd", 2) == 0 and osa("abcdef", "xyzdef", 2) == 3 and osa("ca", "abc", 5) == 3


@pytest.mark.parametrize(
    ("text", "body"),
    [("The Fiveburg Wind Band", ("fiveburg", "wind band")), ("Windband of Fiveburg", ("fiveburg", "wind band")), ("Fiveburg HPB", ("fiveburg", "harbour police band")), ("Op. Chorus (Fiveburg)", ("fiveburg", "opera chorus")), ("Fiveburg Munic. Chorus", ("fiveburg", "municipal choir")), ("Fiveburg Reed&Bow Cons.", ("fiveburg", "reed bow consort")), ("Fiveburg Symphnoy Orchesrta", ("fiveburg", "symphony orchestra")), ("Ann Bell", None), ("Vienna Jazz Trio", ("vienna", "jazz trio")), ("Jazz Trio, Vienna", ("vienna", "jazz trio")), ("Radiochor", None), ("Berlin Radio Chor", ("berlin", "radio choir")), ("The Radio Choir of Berlin", ("berlin", "radio choir"))],
)
def test_ensemble(text, body):
    assert ensemble(text) == body


def test_trie_join_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    seeds = ["".join(r.choices("abcde", k=r.randrange(4, 12))) for _ in range(60)]
    words = set(seeds) | {"ab", "", "tamsin", "tmasan", "abcdefgh", "acbdegfh"}
    for s in seeds:
        for _ in range(3):
            t = list(s)
            for _ in range(r.randrange(1, 3)):
                i = r.randrange(len(t))
                r.choice([lambda: t.insert(i, r.choice("abcde")), lambda: t.pop(i) if len(t) > 4 else None, lambda: t.__setitem__(i, r.choice("abcde"))])()
            words.add("".join(t))
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    lev = lambda a, b: _levenshtein(a, b)
    must = {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) > 3 and lev(a, b) <= min(bound(a), bound(b))}
    may = {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) > 3 and osa(a, b, 2) <= min(bound(a), bound(b))}
    got = {(x.word, x.near) for x in near_words(df, "w").collect()}
    assert must <= got == may
    import quaverlake.llm.triejoin as M

    monkeypatch.setattr(M, "QUESTIONS", 3)
    monkeypatch.setattr(M, "HELD", 2)
    assert {(x.word, x.near) for x in near_words(df, "w").collect()} == got
    assert near_words(df.limit(0), "w").count() == 0


def test_automaton_equals_comparison():
    r = random.Random(3)
    words = sorted({"".join(r.choices("abc", k=r.randrange(4, 10))) for _ in range(400)})
    for n in range(4, 10):
        t = Trie()
        held = [w for w in words if len(w) == n]
        for w in held:
            t.add(w)
        for w in words:
            if n <= len(w) <= n + bound("x" * n):
                most = bound("x" * n)
                got = dict(t.near(w))
                assert got == {x: d for x in held if (len(x) < len(w) or x < w) and (d := osa(w, x, most)) <= most}


def _levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_variants(spark):
    ann = ["Konstantin Orrunander", "Orrunander, Konstantin", "K. Orrunander", "Kostya Orrunander", "Konstarnin Orrunander", "ORRUNANDER KONSTANTIN", "Константин Оррунандер", "Dr. Konstantin Orrunader"]
    cy = ["Birgit Orrunander", "Birgit T. Orrunander"]
    band = ["Fiveburg Wind Band", "Wind Band of Fiveburg", "Fiveburgr Windband", "Fiveburger Wind Band"]
    names = [("performer", n, 20 if n in (ann[0], cy[0], band[0]) else 1) for n in ann + cy + band] + [("performer", "n/a", 3), ("performer", "Ann Bell", 2), ("performer", None, 1), ("performer", ann[0], 1)]
    df = spark.createDataFrame(names, "field string, name string, w bigint")
    got = {(r.name_a, r.name_b) for r in variant_pairs(df).collect()}
    want = {(a, b) for g in (ann, cy, band) for a in g for b in g if a < b}
    assert got == want
    assert variant_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ('Sonata No. 2 in E flat major "The Sea Road"', {"g": "sonata", "n": "2", "k": "e flat major", "w": "sea road"}),
        ("Streichquartett Nr. 1 Es-Dur", {"g": "string quartet", "n": "1", "k": "e flat major"}),
        ("Symphonie n° 2 en fa dièse mineur", {"g": "symphony", "n": "2", "k": "f sharp minor"}),
        ("Prelude #4 C Op. 40", {"g": "prelude", "n": "4", "k": "c major", "o": "40"}),
        ("Str. Qt. 3, F#m", {"g": "string quartet", "n": "3", "k": "f sharp minor"}),
        ("Bell: March 3 (Op. 36)", {"g": "march", "n": "3", "o": "36"}),
        ("Sonata No. 3 in C major: IV. Menuetto", {"g": "sonata", "n": "3", "k": "c major"}),
        ("First Piano Concerto", {"g": "piano concerto", "n": "1"}),
        ("Sonata the Second", {"g": "sonata", "n": "2"}),
        ("Piano Concerto II", {"g": "piano concerto", "n": "2"}),
        ("op 6", {"o": "6"}),
        ("The Sea Road", {"w": "sea road"}),
        ("Nachtstück Nr. 3 h-Moll", {"g": "nocturne", "n": "3", "k": "b minor"}),
    ],
)
def test_work_parts(text, parts):
    assert work_parts(text) == parts


def test_canonical(spark):
    composers = spark.createDataFrame([("c1", "Konstantin Orrunander"), ("c2", "Birgit Orrunander"), ("c3", "Edda Brannevuld")], "composer_id string, name string")
    works = spark.createDataFrame(
        [("w1", "Konstantin Orrunander", "Sonata No. 1 in C minor", "Op. 4"), ("w2", "Konstantin Orrunander", 'March No. 2 in D major "The Sea Road"', "Op. 9"), ("w3", "Edda Brannevuld", "Sonata No. 1 in C minor", "Op. 4")],
        "id string, composer_canonical string, title string, catalog string",
    )
    rows = [
        ("1", "Orrunander, K.", "Sonate Nr. 1 c-Moll"),
        ("1", "Orrunander, K.", "Sonate Nr. 1 c-Moll"),
        ("2", "Konstantin Orrunander", "the sea road"),
        ("3", "Konstantin Orrunander", "Sonata No. 1 in C minor"),
        ("4", "Edda Branevuld", "Sonata No. 7 in C minor"),
        ("5", "Wanda Mezutigard", "Sonata No. 1 in C minor"),
        ("6", "n/a", None),
        ("7", "", "op 4"),
        ("8", None, "op 4"),
        ("9", "Edda Brannevuld", "Sonatta No. 1 in C minor"),
        ("10", "Frieda Brannevuld", ""),
    ]
    t = spark.createDataFrame(rows, "id string, composer string, work string").selectExpr("*", "'x' as ref_id", "'y' as field")
    got = {(r.track_id, r.field): r.ref_id for r in canonical_tracks(t, composers, works).collect()}
    assert got == {
        ("1", "composer"): "c1", ("1", "work"): "w1", ("2", "work"): "w2", ("4", "composer"): "c3", ("4", "work"): "unmatched", ("5", "composer"): "unmatched", ("5", "work"): "unmatched",
        ("6", "composer"): "unmatched", ("9", "work"): "w3", ("10", "composer"): "unmatched",
    }
    assert canonical_tracks(t.limit(0), composers, works).count() == 0
    assert {r.ref_id for r in canonical_tracks(t, composers.limit(0), works.limit(0)).collect()} == {"unmatched"}


def test_variants_hold_as_the_table_grows(spark):
    edda = ["Edda Haskadström", "Haskadstrom, Edda", "Edda Haskadstroem", "Haskadstroem, Edda", "Haskadstroem Edda"]
    jo = ["Josephine Haskadström", "Josephine Haskadstroem", "Haskadstroem, Josephine"]
    typed = ["Pavel Farriliere", "Psvel Farriliere", "Farriliere, Psvel"]
    near = ["Viola Quilavuld", "Viola Quilemuld"]
    weight = {typed[0]: 40, near[0]: 9, near[1]: 13}
    want = {(a, b) for g in (edda, jo, typed) for a in g for b in g if a < b}
    for times in (1, 100):
        names = [("composer", n, times * weight.get(n, 5)) for n in edda + jo + typed + near]
        df = spark.createDataFrame(names, "field string, name string, w bigint")
        assert {(r.name_a, r.name_b) for r in variant_pairs(df).collect()} == want


def test_long_chains_of_spellings_end_in_one(spark):
    spelled = ["".join("bcdfghklmnpr"[j] if j < i else "o" for j in range(12)) for i in range(12)]
    names = [("composer", f"Ann {s}", 3**i) for i, s in enumerate(spelled)]
    got = name_entities(spark.createDataFrame(names, "field string, name string, w bigint")).collect()
    assert len(got) == 12 and len({(r.e_sur, r.e_giv) for r in got}) == 1
