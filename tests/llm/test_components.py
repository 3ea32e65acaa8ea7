"""Groups of linked records: shapes, awkward rows, random graphs against union-find."""

import random

from quaverlake.llm import components as M


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").withColumnRenamed("a", "vertex").withColumnRenamed("b", "group")
    return {r.vertex: r.group for r in M.components(df, "vertex", "group").collect()}


def name(i):
    return f"{i:05d}"


SHAPES = {
    "pair": [("a", "b")],
    "chain": [(name(i), name(i + 1)) for i in range(300)],
    "ring": [(name(i), name((i + 1) % 64)) for i in range(64)],
    "triangle and tail": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")],
    "two hubs": [("h", name(i)) for i in range(150)] + [("g", name(i)) for i in range(150)],
    "clique": [(name(i), name(j)) for i in range(12) for j in range(i)],
    "nulls, selves, repeats": [("a", None), (None, "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e")],
    "parallel chains": [("s", "a"), ("a", "b"), ("b", "t"), ("s", "c"), ("c", "d"), ("d", "t"), ("s", "t"), ("s", "x"), ("t", "y")],
}


def test_all_shapes_at_once(spark):
    tag = lambda s, x: None if x is None else f"{s}/{x}"
    pairs = [(tag(s, a), tag(s, b)) for s, ps in SHAPES.items() for a, b in ps]
    for seed in (1, 2):
        r = random.Random(seed)
        pairs += [(f"{seed}/{r.randrange(400):05d}", f"{seed}/{r.randrange(400):05d}") for _ in range(180 + 90 * seed)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert M.components(df, "a", "b").count() == 0


def test_core_alone(spark):
    edges = [(name(i), name(j)) for i in range(40) for j in range(40) if i < j and (i * j + i + j) % 7 == 0]
    df = spark.createDataFrame(edges, "a string, b string")
    want = brute(edges)
    got = {r.v: r.parent for r in M._core(df).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_track_ids(spark):
    tracks = spark.createDataFrame([("T1",), ("T2",), ("T2",), ("T3",), (None,)], "id string")
    pairs = spark.createDataFrame([(" t1", "T2 "), ("T2", "T9"), ("t3", "T3"), (None, "T1")], "track_a string, track_b string")
    assert sorted(map(tuple, M.track_groups(pairs, tracks).collect())) == [("T1", "T1"), ("T2", "T1")]
