"""Variant spellings of names typed by people: link those that mean the same person or body.

Distinct names are read into a surname and given part, or a place and kind for ensembles. A trie
join (:mod:`triejoin`) finds the neighbours of every surname, place and given name; a name then
points to the commoner name that both its parts are near to, in either order of its words, and
pointers are followed to the name that stands for the entity. Names with initials, short forms or a
surname alone go to the entity of that surname they fit, if one stands out. Everything is keyed by
words or entities; a text is handled once however many rows hold it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaverlake.llm.names import flat, full_names, given_fits, osa, person, placeholder, sound, turned
from quaverlake.llm.triejoin import near_words
from quaverlake.session import cut, release

# Kinds of bodies by their words, each with its short forms and other names.
KINDS = {
    "symphony orchestra": (("symphony", "symph", "sym", "sinfonie"), ("orchestra", "orch", "orchester")),
    "philharmonic society": (("philharmonic", "philh", "phil"), ("society", "soc")),
    "chamber players": (("chamber", "chamb", "ch"), ("players", "plyrs", "plrs")),
    "string quartet": (("string", "str"), ("quartet", "qt", "quartett", "quart")),
    "brass ensemble": (("brass", "br"), ("ensemble", "ens")),
    "wind band": (("wind", "wd"), ("band", "bd")),
    "municipal choir": (("municipal", "munic", "mun"), ("choir", "chorus", "ch", "chor")),
    "opera chorus": (("opera", "op"), ("chorus", "ch", "chor", "choir")),
    "harbour police band": (("harbour", "harb", "hbr", "harbor"), ("police", "pol"), ("band", "bd")),
    "sinfonietta": (("sinfonietta", "sinf", "sinfta"),),
    "reed bow consort": (("reed",), ("bow",), ("consort", "cons")),
    "drum fife corps": (("drum",), ("fife",), ("corps", "cps")),
}
# One-word names of kinds in another language.
GLUED = {"sinfonieorchester": "symphony orchestra", "streichquartett": "string quartet", "kammerorchester": "chamber players", "blaserensemble": "brass ensemble", "blasorchester": "wind band", "stadtchor": "municipal choir", "opernchor": "opera chorus"}
# Nouns that head the name of a body, in several languages and short, and what they come to.
HEADS = {
    form: noun
    for noun, forms in {
        "orchestra": "orch orchester orchestre orquesta orkest orkester", "choir": "chor chorus choeur coro koor", "band": "bands banda", "quartet": "quartett quatuor cuarteto quartetto kwartet",
        "trio": "terzett", "duo": "duet duett", "quintet": "quintett quintette quinteto quintetto", "sextet": "sextett sexteto", "septet": "septett", "octet": "octett oktett", "ensemble": "ens ensembles", "consort": "consorts",
        "players": "spieler", "society": "gesellschaft", "singers": "sanger cantores", "sinfonietta": "", "philharmonic": "philharmonie philharmoniker filarmonica", "symphony": "", "camerata": "", "kapelle": "capella cappella", "collegium": "", "corps": "",
    }.items()
    for form in [noun, *forms.split()]
}
_ACRONYM = {"".join(w[0] for w in k.split()): k for k in KINDS if " " in k}


def _stands(token: str, words: tuple[str, ...]) -> bool:
    bare = token.rstrip(".")
    return bare in words or token.endswith(".") and len(bare) >= 2 and words[0].startswith(bare)


@lru_cache(200_000)
def ensemble(text: str) -> tuple[str, str] | None:
    """(place, kind) of a body's name in any order of its parts, or None if it names no body."""
    tokens = [t for t in re.findall(r"[^\W\d_]+\.?", flat(text)) if t.rstrip(".") not in ("the", "of", "and", "von", "de", "a")]
    if len(tokens) < 2:
        return None
    for i, town in enumerate(tokens):
        if len(town) < 4:
            continue
        rest = tokens[:i] + tokens[i + 1 :]
        bare = "".join(t.rstrip(".") for t in rest)
        if len(rest) == 1 and (bare in GLUED or bare in _ACRONYM and re.search(r"\b[A-Z]{2,4}\b", text)):
            return sound(town.rstrip(".")), GLUED.get(bare) or _ACRONYM[bare]
        for kind, groups in KINDS.items():
            if len(rest) == len(groups) and all(_stands(t, g) for t, g in zip(rest, groups, strict=True)):
                return sound(town.rstrip(".")), kind
    best = (4, "", "")
    for i, town in enumerate(tokens):
        bare = "".join(t.rstrip(".") for j, t in enumerate(tokens) if j != i)
        if len(town) < 4 or len(bare) < 6:
            continue
        d, kind = _near_kind(bare)
        if d < best[0]:
            best = (d, town, kind)
    if best[2]:
        return sound(best[1].rstrip(".")), best[2]
    return _headed(text, tokens)


_SPELT = {k.replace(" ", ""): GLUED.get(k, k) for k in [*KINDS, *GLUED]}


@lru_cache(200_000)
def _near_kind(bare: str) -> tuple[int, str]:
    """The edits to the nearest kind's letters, if they are few, and that kind."""
    best = (4, "")
    for full, kind in _SPELT.items():
        most = 3 if len(full) > 9 else 2
        # each letter that only one of them has is an edit
        if abs(len(full) - len(bare)) <= 3 and len(set(full) - set(bare)) <= most and len(set(bare) - set(full)) <= most and (d := osa(bare, full, 3)) <= most and d < best[0]:
            best = (d, kind)
    return best


def _headed(text: str, tokens: list[str]) -> tuple[str, str] | None:
    """(place, kind) of a body of no listed kind, known by the noun that heads it ("Vienna Jazz Trio").

    The place is what a comma, bracket or "of" sets apart, else the first word; the rest is the kind.
    """
    heads = [HEADS.get(t.rstrip(".")) for t in tokens]
    if not any(heads):
        return None
    s = flat(text)
    apart = re.search(r"\(([^()]*)\)|\bof ([^,()]*)|,\s*([^,()]*)$", s)
    place = [t.rstrip(".") for t in re.findall(r"[^\W\d_]+", next(filter(None, apart.groups()), "")) if t != "the"] if apart else []
    if not place or any(t in HEADS for t in place) or len(place) >= len(tokens):
        place = [tokens[0].rstrip(".")]
    left = list(place)
    kind = []
    for t, head in zip(tokens, heads, strict=True):
        bare = t.rstrip(".")
        if bare in left:
            left.remove(bare)
        else:
            kind.append(head or bare)
    if not kind or any(t in HEADS for t in place):
        return None
    return sound("".join(place)), " ".join(kind)


_PARSED = "field string, name string, w long, sur string, giv string, full boolean, sur2 string, giv2 string"
#: A name this many times as common as another may be what the other was meant to be; more edits ask for more.
RARER = 2


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for field, name, w in pdf[["field", "name", "w"]].itertuples(index=False, name=None):
            if placeholder(name):
                continue
            body = ensemble(name) if field != "composer" else None
            if body:
                out.append((field, name, w, body[0], "#" + body[1], True, None, None))
                continue
            sur, giv = person(name)
            if not sur:
                continue
            t = turned(sur, giv) if "," not in name else None
            first = giv[0] if giv else ""
            full = len(first.rstrip(".")) > 1 and not first.endswith(".") and not full_names(first)
            out.append((field, name, w, sur, first, full, t[0] if t else None, t[1][-1] if t else None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.split(", ")])


def name_entities(names: DataFrame) -> DataFrame:
    """``(field, name, e_sur, e_giv)``: the entity of each name of ``(field, name, w)``.

    ``w`` is how often the name occurs. NULL and empty names and placeholders have no row; repeated
    rows add up; an empty table gives an empty result; further columns are not read.
    """
    summed = names.where(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("field", "name").agg(F.sum("w").alias("w"))
    parsed = cut(summed.repartition("name").mapInPandas(_parse, _PARSED))
    # the order of two whole words: by how often each is a first and a last word
    roles = (
        parsed.where("giv not like '#%'")
        .select("field", F.inline(F.array(F.struct(F.col("sur").alias("word"), F.lit(0).alias("g"), F.col("w").alias("s")), F.struct(F.regexp_replace("giv", r"\.$", "").alias("word"), F.col("w").alias("g"), F.lit(0).cast("long").alias("s")))))
        .groupBy("field", "word")
        .agg(F.ln((F.sum("g") + 0.5) / (F.sum("s") + 0.5)).alias("lean"))
    )
    both = (
        parsed.join(roles.select("field", F.col("word").alias("sur"), F.col("lean").alias("ls")), ["field", "sur"], "left")
        .join(roles.select("field", F.col("word").alias("sur2"), F.col("lean").alias("lg")), ["field", "sur2"], "left")
        .withColumn("turn", F.col("sur2").isNotNull() & (F.col("ls") - F.col("lg") > 0))
    )
    f = cut(
        both.select(
            "field", "name", "w",
            F.when(F.col("turn"), F.col("sur2")).otherwise(F.col("sur")).alias("sur"),
            F.when(F.col("turn"), F.col("giv2")).otherwise(F.col("giv")).alias("giv"),
            F.when(F.col("turn"), F.lit(True)).otherwise(F.col("full")).alias("full"),
        )
    )
    f_full = f.where("full")
    near_s = cut(near_words(f.select("sur"), "sur"))
    near_g = cut(near_words(f_full.where("giv not like '#%'").select("giv"), "giv"))
    e = f_full.groupBy("field", "sur", "giv").agg(F.sum("w").alias("w"))
    # "Fiveburger" is of Fiveburg and "Haskadstroem" is Haskadström however often written so, and counts for it
    bare = lambda c: F.when(F.col(c).startswith("#"), F.col(c)).otherwise(F.regexp_replace(c, "([ao])e", "$1"))
    as_read = [F.struct(s.alias("sur"), g.alias("giv")) for s, g in ((F.regexp_replace("sur", "er$", ""), F.col("giv")), (bare("sur"), F.col("giv")), (F.col("sur"), bare("giv")), (bare("sur"), bare("giv")))]
    kin = e.select("field", "w", F.struct("sur", "giv").alias("own"), F.explode(F.array_distinct(F.array(*as_read))).alias("read")).where("own <> read")
    kin = kin.groupBy("field", "read.sur", "read.giv").agg(F.sum("w").alias("kw"))
    e = cut(e.join(kin, ["field", "sur", "giv"], "left").select("field", "sur", "giv", (F.col("w") + F.coalesce("kw", F.lit(0))).alias("w")))

    def toward(word: str, near: DataFrame, to: str, d: str) -> DataFrame:
        """(field, word, to, d, top): the words of entities that each word may be an error for, itself too.

        A word and its ö, ø, ä or æ written out are the same (d is 0).

        ``top`` is the weight of the commonest entity with the other word: none rarer can be meant.
        """
        words = e.groupBy("field", F.col(word).alias(to)).agg(F.max("w").alias(f"{to}_top"))
        n = near.where(F.col("near") != F.concat("word", F.lit("er"))).select(F.col("word").alias(word), F.col("near").alias(to), F.when(F.col("word") == F.concat("near", F.lit("er")), 1).otherwise(F.col("edits")).alias(d))
        every = f.select(word).distinct()
        same = every.select(word, F.explode(F.array_distinct(F.array(F.col(word), bare(word)))).alias(to), F.lit(0).alias(d))
        least = n.unionByName(same).groupBy(word, to).agg(F.min(d).alias(d))
        return cut(words.join(least, to))

    to_s = toward("sur", near_s, "ts", "ds")
    to_g = toward("giv", near_g, "tg", "dg")
    target = e.select("field", F.col("sur").alias("ts"), F.col("giv").alias("tg"), F.col("w").alias("tw"))
    d = F.col("ds") + F.col("dg")
    placed = F.col("sur") == F.concat("ts", F.lit("er"))
    commoner = (F.col("tw") > F.col("w")) | ((F.col("tw") == F.col("w")) & (F.struct("ts", "tg") < F.struct("sur", "giv")))
    # relative, so that a link made on a small table holds on a larger one; 1 is for what is seen once
    rare = F.col("tw") + 1 >= F.col("w") * F.when(F.col("ds") == 0, RARER).otherwise(RARER - 1 + d)
    best = W.partitionBy("field", "sur", "giv").orderBy(d, F.desc("tw"), "ts", "tg")
    point = cut(
        e.join(to_s, ["field", "sur"]).where("ts_top >= w").join(to_g, ["field", "giv"]).where("tg_top >= w").join(target, ["field", "ts", "tg"])
        .where(((F.col("sur") != F.col("ts")) | (F.col("giv") != F.col("tg"))) & (d <= 3) & commoner & (placed | (d == 0) | rare))
        .withColumn("k", F.row_number().over(best)).where("k = 1")
        .select("field", "sur", "giv", "ts", "tg")
    )
    root = e.join(point, ["field", "sur", "giv"], "left").select("field", "sur", "giv", "w", F.coalesce("ts", "sur").alias("rs"), F.coalesce("tg", "giv").alias("rg"))
    root = cut(root)
    moved = True
    while moved:  # pointers go to ever commoner names, so there is no ring
        up = root.select("field", F.col("sur").alias("rs"), F.col("giv").alias("rg"), F.col("rs").alias("us"), F.col("rg").alias("ug"))
        further = cut(root.join(up, ["field", "rs", "rg"]).select("field", "sur", "giv", "w", F.col("us").alias("rs"), F.col("ug").alias("rg"), ((F.col("us") != F.col("rs")) | (F.col("ug") != F.col("rg"))).alias("moved")))
        moved = not further.where("moved").isEmpty()
        release(root)
        root = further.drop("moved")
    whole = f.where("full").join(root.select("field", "sur", "giv", F.col("rs").alias("e_sur"), F.col("rg").alias("e_giv")), ["field", "sur", "giv"]).select("field", "name", "e_sur", "e_giv")

    # initials, short forms, surnames alone: distinct (surname, given part) against the entities there
    part = cut(f.where("not full").groupBy("field", "sur", "giv").agg(F.sum("w").alias("pw")))
    known = root.groupBy("field", F.col("sur").alias("ts"), "rs", "rg").agg(F.sum("w").alias("ew"))
    # a surname most of whose people stand for themselves is no error for another
    own = root.groupBy("field", "sur").agg((2 * F.sum(F.when(F.col("rs") == F.col("sur"), F.col("w")).otherwise(0)) > F.sum("w")).alias("own"))
    met = part.join(to_s.drop("ts_top"), ["field", "sur"]).join(own, ["field", "sur"], "left").join(known, ["field", "ts"])
    met = met.where((F.col("ds") == 0) | ~F.coalesce("own", F.lit(False)) & (F.col("ew") + 1 >= RARER * F.col("pw"))).drop("own", "pw")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(fit=[0.5 if not g else given_fits(g, r) for g, r in zip(pdf["giv"], pdf["rg"], strict=True)])

    fits = met.where("rg not like '#%'").mapInPandas(fit, "field string, ts string, sur string, giv string, ds int, rs string, rg string, ew long, fit double").where("fit > 0")
    each = fits.groupBy("field", "sur", "giv", "rs", "rg").agg(F.min("ds").alias("ds"), F.max("fit").alias("fit"), F.sum("ew").alias("ew"))
    order = W.partitionBy("field", "sur", "giv").orderBy("ds", F.desc(F.col("fit") >= 0.65), F.desc("ew"), "rs", "rg")
    ranked = each.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead(F.struct("ds", (F.col("fit") >= 0.65).alias("sure"), "ew")).over(order))
    stands_out = F.col("next").isNull() | (F.col("next.ds") > F.col("ds")) | ((F.col("fit") >= 0.65) & ~F.col("next.sure")) | (F.col("ew") >= 2 * F.col("next.ew"))
    chosen = ranked.where((F.col("k") == 1) & stands_out).select("field", "sur", "giv", F.col("rs").alias("e_sur"), F.col("rg").alias("e_giv"))
    rest = f.where("not full").join(chosen, ["field", "sur", "giv"], "left")
    partial = rest.select("field", "name", F.coalesce("e_sur", "sur").alias("e_sur"), F.coalesce("e_giv", F.concat(F.lit("?"), F.substring("giv", 1, 1))).alias("e_giv"))
    return whole.unionByName(partial)


def variant_pairs(names: DataFrame) -> DataFrame:
    """``(field, name_a, name_b)``: every two different names of one field and entity, a before b."""
    e = cut(name_entities(names))
    a, b = e.withColumnRenamed("name", "name_a"), e.withColumnRenamed("name", "name_b")
    return a.join(b, ["field", "e_sur", "e_giv"]).where("name_a < name_b").select("field", "name_a", "name_b")
