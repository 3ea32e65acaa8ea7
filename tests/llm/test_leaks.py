"""Leaks against brute force over random texts."""

import random

from quaverlake.llm.leaks import RUN, Index, leaked, words


def test_words():
    assert words("L'Œuvre: Dvořák­ian ＴＷＯ—three") == ["l", "œuvre", "dvorakian", "two", "three"]


def brute(docs, items):
    out = set()
    for d, t in docs:
        ws = words(t)
        runs = {tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1)}
        for k, u in items:
            us = words(u)
            if any(tuple(us[i : i + RUN]) in runs for i in range(len(us) - RUN + 1)):
                out.add((d, k))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(5, 40)))) for i in range(40)]
    docs = []
    for d in range(150):
        ws = r.choices(vocab + ["zz", "yy"], k=r.randrange(0, 300))
        if d % 3 == 0:
            part = items[r.randrange(40)][1].split()
            at, n = r.randrange(max(1, len(part))), r.randrange(7, 15)
            ws[r.randrange(len(ws) + 1) : 0] = [w.upper() + "," for w in part[at : at + n]]
            ws += part[:n]
        docs.append((d, "\n".join(ws)))
    return docs, items


def test_index_equals_brute_force():
    for seed in range(6):
        docs, items = corpus(seed)
        ix = Index(items)
        assert {(d, k) for d, t in docs for k in ix.leaks(t)} == brute(docs, items)


def test_search_finds_all_above_threshold():
    docs, items = corpus(9)
    ix = Index(items)
    for _, t in docs[:60]:
        q = {w for w in words(t)[:64] if w in ix.top}
        score = {}
        for w in q:
            for b in ix.blocks[w]:
                for k, s in b[3].items():
                    score[k] = score.get(k, 0) + s
        assert set(ix.search(q)) == {k for k, s in score.items() if s >= ix.threshold and s >= ix.least[k] * (1 - 1e-9)}


def test_operator(spark, monkeypatch):
    docs, items = corpus(4)
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, docs[0][1])], "doc_id bigint, text string").selectExpr("*", "1 as item_id")
    i = spark.createDataFrame([*items, items[0], (77, None), (78, "short")], "item_id bigint, text string")
    got = set(map(tuple, leaked(d, "doc_id", "text", i, "item_id", "text").collect()))
    assert got == brute([*docs, (902, docs[0][1])], items)
    import quaverlake.llm.leaks as M

    monkeypatch.setattr(M, "ITEMS", 15)
    assert set(map(tuple, leaked(d, "doc_id", "text", i, "item_id", "text").collect())) == got
    assert leaked(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
