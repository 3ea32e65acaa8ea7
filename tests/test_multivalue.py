"""Packed fields: fixed cases, awkward tables, and splitting by brute force."""

import pytest

from quaverlake.operators.multivalue import exploded_values, spans, split_values

CASES = {
    "Ann Bell; Cy Dorn": ["Ann Bell", "Cy Dorn"],
    "Ann Bell;; Cy Dorn ;": ["Ann Bell", "Cy Dorn"],
    "Bell, Ann": ["Bell, Ann"],
    "Bell, A.": ["Bell, A."],
    "Wind Band, Fiveburg": ["Wind Band, Fiveburg"],
    "Ann Bell, Cy Dorn and Eve Fox": ["Ann Bell", "Cy Dorn", "Eve Fox"],
    "Ann Bell, Cy Dorn, and Eve Fox": ["Ann Bell", "Cy Dorn", "Eve Fox"],
    "Bell, Ann & Cy Dorn": ["Bell, Ann", "Cy Dorn"],
    '"Bell, Ann", Cy Dorn , "Fox, E."': ["Bell, Ann", "Cy Dorn", "Fox, E."],
    '["Ann \\"Nan\\" Bell", "Cy Dorn"]': ['Ann "Nan" Bell', "Cy Dorn"],
    '"Ann ""Nan"" Bell","Cy Dorn"': ['Ann "Nan" Bell', "Cy Dorn"],
    'Ann "Nan" Bell': ['Ann "Nan" Bell'],
    "'Ann Bell' / 'Cy Dorn'": ["Ann Bell", "Cy Dorn"],
    "«Ann Bell» / «Bell, Cy»": ["Ann Bell", "Bell, Cy"],
    "“Ann Bell”, “Dorn, C.”": ["Ann Bell", "Dorn, C."],
    "Ann Bell\tCy Dorn\r\nEve Fox": ["Ann Bell", "Cy Dorn", "Eve Fox"],
    "Ann Bell // Cy Dorn || Eve Fox": ["Ann Bell", "Cy Dorn", "Eve Fox"],
    "Ann Bell feat. Cy Dorn; Eve Fox": ["Ann Bell", "Cy Dorn", "Eve Fox"],
    "Fiveburg Reed & Bow Consort": ["Fiveburg Reed & Bow Consort"],
    "Drum/Fife Cps of Fiveburg & Ann Bell": ["Drum/Fife Cps of Fiveburg", "Ann Bell"],
    "Fiveburg Rede & Bow Consort, Ann Bell": ["Fiveburg Rede & Bow Consort", "Ann Bell"],
    "String Quartet (Fiveburg) | Ann Bell": ["String Quartet (Fiveburg)", "Ann Bell"],
    "Sandy Andrews": ["Sandy Andrews"],
    "": [],
    " ; ,": [],
}


def test_cases(spark):
    got = {r.t: list(r.names) for r in split_values(spark.createDataFrame([(t,) for t in CASES], "t string"), "t").collect()}
    assert got == CASES


def test_positions_and_awkward_rows(spark):
    rows = [("1", "Ann Bell; Cy Dorn", 1), ("1", "Ann Bell; Cy Dorn", 2), ("2", None, 1), ("3", "", 1), (None, "A B; C D", 1), ("4", "Ann Bell", 1)]
    df = spark.createDataFrame(rows, "id string, performer string, names int")
    assert sorted(map(tuple, exploded_values(df, "id", "performer", 2).collect())) == [("1", 1, "Ann Bell"), ("1", 2, "Cy Dorn")]
    assert exploded_values(df.limit(0), "id", "performer").count() == 0


def test_long_text(spark):
    names = [f"Ann B{'e' * (i % 7 + 1)}ll{'x' * (i // 7 % 9)}" for i in range(3000)]
    got = split_values(spark.createDataFrame([(" | ".join(names),)], "t string"), "t").first()
    assert list(got.names) == names


@pytest.mark.parametrize("skeleton", ["", " ", "A", "a, a", '"', '""', "[", "[]", "J", "A J", "«A", "q"])
def test_spans_never_fail(skeleton):
    for a, b, _ in spans(skeleton):
        assert 0 <= a < b <= len(skeleton)
