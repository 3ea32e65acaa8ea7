"""Mapping free-entered values to a canonical list: token repair, then soft TF-IDF.

Each distinct token of the typed texts is joined to the vocabulary of the reference list by edit
distance (a trie join over both). A text's repaired tokens are then looked up in the list's
postings; the sum of similarity times inverse document frequency ranks whole entries, and the parts
of text and entry are checked against each other. Works are sought among the works of the composer
found. Texts are handled once each, the lists are small and broadcast only after a size check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaverlake.llm.names import bound, flat, given_fits, osa, person, placeholder, turned
from quaverlake.llm.triejoin import near_words
from quaverlake.session import cut, small

NONE = "unmatched"

# Kinds of works with their names in other languages and short forms, longest first.
GENRES = {
    "string quartet": ("string quartet", "streichquartett", "quatuor a cordes", "cuarteto de cuerda", "str. qt.", "str qt", "str. quartet", "string qt."),
    "piano concerto": ("piano concerto", "klavierkonzert", "concerto pour piano", "concierto para piano", "pf. conc.", "pf conc", "piano conc."),
    "symphony": ("symphony", "sinfonie", "symphonie", "sinfonia", "symph.", "sym."),
    "sonata": ("sonata", "sonate", "son."),
    "march": ("march", "marsch", "marche", "marcha", "mch."),
    "nocturne": ("nocturne", "nachtstuck", "notturno", "nocturno", "noct."),
    "overture": ("overture", "ouverture", "obertura", "ov."),
    "prelude": ("prelude", "praludium", "preludio", "prel."),
    "serenade": ("serenade", "serenata", "standchen", "ser."),
    "fantasy": ("fantasy", "fantasie", "fantaisie", "fantasia", "fant."),
}
# Ordinals and Roman numerals.
ORDINALS = {w: i + 1 for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split())}
ROMAN = {w: i + 1 for i, w in enumerate("i ii iii iv v vi vii viii ix x xi xii".split())}
# Notes in German and French.
GERMAN = {"c": "c", "d": "d", "e": "e", "f": "f", "g": "g", "a": "a", "h": "b", "b": "b flat", "es": "e flat", "as": "a flat", "des": "d flat", "ges": "g flat", "ces": "c flat", "fis": "f sharp", "cis": "c sharp", "gis": "g sharp", "dis": "d sharp", "ais": "a sharp"}
FRENCH = {"do": "c", "ut": "c", "re": "d", "mi": "e", "fa": "f", "sol": "g", "la": "a", "si": "b"}
_FIXED_WORDS = frozenset(w for v in GENRES.values() for a in v for w in re.findall(r"\w+", a)) | frozenset(ORDINALS) | frozenset("major minor flat sharp opus majeur mineur bemol diese moll".split())


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text)


def work_parts(text: str, repairs: dict[str, str] | None = None) -> dict[str, str]:
    """The parts a work's title gives: g kind, n number, k key, o opus, w words of its by-name.

    ``own`` says that the kind is the title's own word and none of :data:`GENRES`.
    """
    s = flat(text).replace("_", " ")
    if repairs:
        s = re.sub(r"[^\W\d_]+", lambda m: repairs.get(m[0], m[0]), s)
    s = re.sub(r"\s+", " ", s).strip()
    out: dict[str, str] = {}

    def kind(x: str) -> tuple[str, re.Match[str]] | None:
        for g, names in GENRES.items():
            for name in names:
                if m := re.search(rf"(?<!\w){re.escape(name)}(?!\w)", x):
                    return g, m
        return None

    if m := re.match(r"([^:\"]*):\s*(.*)$", s):
        s = m[1] if kind(m[1]) and not kind(m[2]) else m[2]
    if m := re.search(r"[\"“„«]\s*([^\"“”»]+?)\s*[\"”“»]", s):
        out["w"] = " ".join(w for w in _words(m[1]) if w != "the")
        s = s[: m.start()] + " " + s[m.end() :]
    if m := re.search(r"(?<!\w)op(?:us)?\.?\s*(\d+)", s):
        out["o"] = m[1].lstrip("0")
        s = s[: m.start()] + " " + s[m.end() :]
    if m := re.search(r"(?<!\w)(?:in )?([a-g])[\s-]*(flat|sharp)?[\s-]*(major|minor)(?!\w)", s):
        out["k"] = " ".join(filter(None, (m[1], m[2], m[3])))
    elif m := re.search(r"(?<!\w)([a-h](?:is|es|s)?)[\s-]+(dur|moll)(?!\w)", s):
        if m[1] in GERMAN:
            out["k"] = f"{GERMAN[m[1]]} {'major' if m[2] == 'dur' else 'minor'}"
    elif m := re.search(r"(?<!\w)(?:en )?(do|ut|re|mi|fa|sol|la|si)(?: (bemol|diese))? (majeur|mineur)(?!\w)", s):
        out["k"] = " ".join(filter(None, (FRENCH[m[1]], {"bemol": "flat", "diese": "sharp"}.get(m[2]), "major" if m[3] == "majeur" else "minor")))
    elif m := re.search(r"(?:#\s*\d+|\d+,)\s*([a-g])(b|#)?(m)?(?!\w)", s):
        out["k"] = " ".join(filter(None, (m[1], {"b": "flat", "#": "sharp"}.get(m[2]), "minor" if m[3] else "major")))
        s = s[: m.start(1)] + " " + s[m.end() :]
    if m and "k" in out and not s[m.start() : m.end()].lstrip().startswith("#") and m.re.pattern.find("#") < 0:
        s = s[: m.start()] + " " + s[m.end() :]
    if found := kind(s):
        out["g"] = found[0]
        rest = s[: found[1].start()] + " | " + s[found[1].end() :]
        number = re.search(r"(?:(?<!\w)n[ro°º]?\s*[.°º]*\s*|#\s*)(\d+)", rest) or re.search(r"\|\s*,?\s*(\d+)", rest)
        if number:
            out["n"] = str(int(number[1]))
        else:
            for w in _words(rest):
                if w in ORDINALS or w in ROMAN:
                    out["n"] = str(ORDINALS.get(w) or ROMAN[w])
                    break
        rest = rest.replace("|", " ")
    else:
        rest = s
        # a kind that the list above lacks goes by its own word, if a number or key says it is one
        number = re.search(r"(?:(?<!\w)n[ro°º]?\s*[.°º]*\s*|#\s*|[^\W\d_]\s+)(\d+)", rest)
        plain = [w for w in _words(rest) if w not in ("the", "no", "nr", "n", "in")]
        counted = [w for w in plain if w in ORDINALS or w in ROMAN]
        named = " ".join(w for w in plain if w not in counted)
        if named and (number or counted and (len(plain) > 1) or "k" in out):
            out["g"], out["own"] = named, "1"
            if number or counted:
                out["n"] = str(int(number[1])) if number else str(ORDINALS.get(counted[0]) or ROMAN[counted[0]])
    if "w" not in out and "g" not in out and not re.search(r"\d", rest):
        left = [w for w in _words(rest) if w != "the" and len(w) > 1]
        if left:
            out["w"] = " ".join(left)
    return out


def _features(parts: dict[str, str], alike: dict[str, float]) -> list[tuple[str, float]]:
    """The features of a title, each with how alike it is to what was typed."""
    return [(f"{k}:{v}", min((alike.get(w, 1.0) for w in v.split()), default=1.0)) for k, v in parts.items() if k in "gnko"] + [(f"w:{w}", alike.get(w, 1.0)) for w in parts.get("w", "").split()]


def match_composers(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``(text, ref_id)`` for each distinct text of ``(text, n)``: the entry of ``(ref_id, name)`` meant.

    ``n`` is how often a text occurs; of entries that fit alike the one whose own name occurs most is
    meant. A text that fits none, and a placeholder, has ``unmatched``. NULL and empty texts have no
    row; repeated rows count once; an empty list leaves all unmatched.
    """
    distinct = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("text").agg(F.sum("n").alias("n"))
    entries = refs.where("ref_id is not null and name is not null").groupBy("ref_id").agg(F.min("name").alias("name"))
    exact = entries.join(distinct, F.col("name") == F.col("text"), "left").select("ref_id", "name", F.coalesce("n", F.lit(0)).alias("prior"))
    shape = "sur string, giv string, sur2 string, giv2 string"

    def parse(column: str, keep: tuple[str, ...]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for t in pdf[column]:
                    sur, giv = ("", []) if placeholder(t) else person(t)
                    other = turned(sur, giv) if sur and "," not in t else None
                    rows.append((sur, giv[0] if giv else "", other[0] if other else None, other[1][-1] if other else None))
                yield pd.concat([pdf[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=["sur", "giv", "sur2", "giv2"])], axis=1)

        return run

    p = cut(distinct.select("text").mapInPandas(parse("text", ("text",)), f"text string, {shape}"))
    e = cut(exact.mapInPandas(parse("name", ("ref_id", "prior")), f"ref_id string, prior long, {shape}"))
    typed = p.select("text", F.explode(F.array_distinct(F.array("sur", F.regexp_replace("giv", r"\.$", ""), "sur2"))).alias("token")).where("token <> ''")
    postings = e.select("ref_id", F.explode(F.array("sur", "giv")).alias("ref")).where("ref <> ''").distinct()
    n = e.count()
    idf = postings.groupBy("ref").agg(F.log(F.lit(1.0 + n) / F.count("*")).alias("idf"))
    weighted = small(cut(postings.join(idf, "ref")))
    vocabulary = idf.select("ref")
    near = near_words(typed.select("token").union(vocabulary), "token").join(small(cut(vocabulary)), F.col("near") == F.col("ref"), "left_semi")
    repaired = near.select(F.col("word").alias("token"), F.col("near").alias("ref"), (1 - 0.25 * F.col("edits")).alias("sim")).unionByName(vocabulary.select(F.col("ref").alias("token"), "ref", F.lit(1.0).alias("sim")))
    scored = typed.join(repaired, "token").join(weighted, "ref").groupBy("text", "ref_id", "token").agg(F.max(F.col("sim") * F.col("idf")).alias("s")).groupBy("text", "ref_id").agg(F.sum("s").alias("score"))
    joined = scored.join(p, "text").join(small(e).select("ref_id", "prior", F.col("sur").alias("rsur"), F.col("giv").alias("rgiv")), "ref_id")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fit = []
            for sur, giv, sur2, giv2, rsur, rgiv in pdf[["sur", "giv", "sur2", "giv2", "rsur", "rgiv"]].itertuples(index=False, name=None):
                best = 0.0
                for s, g in ((sur, giv), (sur2, giv2)):
                    if s and (d := osa(s, rsur, bound(rsur))) <= bound(rsur):
                        f = given_fits(g, rgiv) if g else 0.4
                        best = max(best, f - 0.1 * d if f else 0.0)
                fit.append(best)
            yield pdf[["text", "ref_id", "score", "prior"]].assign(fit=fit)

    checked = joined.mapInPandas(check, "text string, ref_id string, score double, prior long, fit double").where("fit > 0")
    order = W.partitionBy("text").orderBy(F.desc(F.round("score", 6)), F.desc(F.round("fit", 1)), F.desc("prior"), "ref_id")
    best = checked.withColumn("k", F.row_number().over(order)).where("k = 1").select("text", "ref_id")
    return distinct.select("text").join(best, "text", "left").select("text", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))


def match_works(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``(owner, text, ref_id)`` for each distinct ``(owner, text)``: the owner's entry that is meant.

    ``refs`` is ``(ref_id, owner, title, catalog)``. Entries are ranked by the weight of the parts
    they share with the text and must contradict none. A text that fits no entry of its owner, as
    all texts of an owner without entries, has ``unmatched``; NULL owners or texts have no row.
    """
    distinct = cut(texts.where(F.col("owner").isNotNull() & F.col("text").isNotNull()).select("owner", "text").distinct())
    held = refs.where("ref_id is not null and owner is not null and title is not null").select("ref_id", "owner", "title", "catalog").distinct()

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, w) for t in pdf["text"] for w in set(_words(flat(t).replace("_", " "))) if len(w) > 3]
            yield pd.DataFrame(rows, columns=["text", "word"])

    spell = "text string, word string"
    typed = cut(distinct.select("text").distinct().mapInPandas(spelled, spell))
    spark = texts.sparkSession
    fixed = spark.createDataFrame([(w,) for w in sorted(_FIXED_WORDS) if len(w) > 3], "word string")
    vocabulary = cut(held.select(F.col("title").alias("text")).distinct().mapInPandas(spelled, spell).select("word").union(fixed).distinct())
    near = near_words(typed.select("word").union(vocabulary), "word")
    fixes = cut(
        near.join(small(vocabulary.select(F.col("word").alias("near"))), "near", "left_semi").join(small(vocabulary), "word", "left_anti").select("word", "near", "edits")
    )
    # every word of the list that a typed one may be, those of the owner's works first
    owned = held.select("owner", F.col("title").alias("text")).join(held.select(F.col("title").alias("text")).distinct().mapInPandas(spelled, spell), "text").select("owner", F.col("word").alias("near"), F.lit(True).alias("held")).distinct()
    asked_words = distinct.join(typed.join(fixes, "word"), "text").join(small(cut(owned)), ["owner", "near"], "left")
    chosen = asked_words.groupBy("owner", "text", "word").agg(F.min(F.struct("edits", F.col("held").isNull().alias("other"), "near")).alias("m"))
    repairs = chosen.groupBy("owner", "text").agg(F.sort_array(F.collect_set(F.struct("word", "m.near", "m.edits"))).alias("repairs"))
    shape = "g string, own string, n string, k string, o string, w string"
    names = ("g", "own", "n", "k", "o", "w")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, r in zip(pdf["text"], pdf["repairs"], strict=True):
                fixed = [] if r is None else [(x["word"], x["near"], x["edits"]) for x in r]
                p = work_parts(t, {w: n for w, n, _ in fixed})
                alike = {n: 1 - 0.25 * e for _, n, e in fixed}
                rows.append((t, r, [{"feature": f, "alike": a} for f, a in _features(p, alike)], *(p.get(x) for x in names)))
            yield pd.DataFrame(rows, columns=["text", "repairs", "features", *names])

    fixed_kind = "array<struct<word:string,near:string,edits:int>>"
    feature_kind = "array<struct<feature:string,alike:double>>"
    read = f"text string, repairs {fixed_kind}, features {feature_kind}, {shape}"
    # a text is read once for each set of repairs
    asked = cut(distinct.join(repairs, ["owner", "text"], "left"))
    parsed = cut(asked.select("text", "repairs").distinct().mapInPandas(parts, read))
    catalogued = held.select("ref_id", "owner", F.concat_ws(", ", "title", "catalog").alias("text"))
    entry = cut(catalogued.join(catalogued.select("text").distinct().withColumn("repairs", F.lit(None).cast(fixed_kind)).mapInPandas(parts, read).drop("repairs"), "text"))
    feature = entry.select("owner", "ref_id", F.explode("features.feature").alias("feature")).distinct()
    n = max(entry.count(), 1)
    idf = feature.groupBy("feature").agg(F.log(F.lit(1.0 + n) / F.count("*")).alias("idf"))
    postings = small(cut(feature.join(idf, "feature")))
    # an own word that is no kind of the list says nothing
    kinds = small(cut(entry.where("g is not null").select("g", F.lit(True).alias("listed")).distinct()))
    read = parsed.join(kinds, "g", "left").withColumn("g", F.when(F.col("own").isNull() | F.col("listed"), F.col("g")))
    asked = cut(asked.join(read.withColumnRenamed("repairs", "as_read"), (asked["text"] == read["text"]) & asked["repairs"].eqNullSafe(F.col("as_read"))).select("owner", asked["text"], "features", *"gnkow"))
    scored = asked.select("owner", "text", F.inline("features")).join(postings, ["owner", "feature"]).groupBy("owner", "text", "ref_id").agg(F.sum(F.col("alike") * F.col("idf")).alias("score"))
    both = scored.join(asked.drop("features"), ["owner", "text"]).join(small(entry).select("ref_id", *[F.col(c).alias(f"r{c}") for c in "gnkow"]), "ref_id")
    agree = lambda c: F.coalesce(F.col(c) == F.col(f"r{c}"), F.lit(False))
    clash = lambda c: F.coalesce(F.col(c) != F.col(f"r{c}"), F.lit(False))
    fits = both.where(~(clash("g") | clash("n") | clash("k") | clash("o") | clash("w")) & (agree("o") | agree("w") | (agree("g") & (agree("n") | agree("k")))))
    order = W.partitionBy("owner", "text").orderBy(F.desc("score"), "ref_id")
    best = fits.withColumn("r", F.row_number().over(order)).where("r = 1").select("owner", "text", "ref_id")
    return distinct.join(best, ["owner", "text"], "left").select("owner", "text", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))


def canonical_tracks(tracks: DataFrame, composers: DataFrame, works: DataFrame) -> DataFrame:
    """``(track_id, field, ref_id)`` of every composer and work text that is not the entry's own.

    A composer equal to a list name, or a work equal to a title of the composer meant, is no case;
    NULL and empty texts are none either. A track's rows count once.
    """
    t = cut(tracks.where("id is not null and composer <> ''").select(F.col("id").alias("track_id"), "composer", "work").distinct())
    names = composers.select(F.col("composer_id").alias("ref_id"), "name")
    meant = cut(match_composers(t.groupBy(F.col("composer").alias("text")).agg(F.count("*").alias("n")), names))
    listed = names.groupBy(F.col("name").alias("composer")).agg(F.min("ref_id").alias("own"))
    known = meant.withColumnRenamed("text", "composer").join(small(listed), "composer", "left").select("composer", F.coalesce("own", "ref_id").alias("ref_id"), F.col("own").isNotNull().alias("exact"))
    known = cut(known)
    first = t.join(known.where("not exact"), "composer").select("track_id", F.lit("composer").alias("field"), "ref_id")
    w = t.where("work <> ''").join(known.select("composer", F.col("ref_id").alias("owner")), "composer").select("track_id", "owner", F.col("work").alias("text"))
    owned = cut(works.select(F.col("id").alias("ref_id"), "composer_canonical", "title", "catalog").join(names.select(F.col("ref_id").alias("owner"), F.col("name").alias("composer_canonical")), "composer_canonical").drop("composer_canonical"))
    cases = cut(w.join(small(owned).select("owner", F.col("title").alias("text")).distinct(), ["owner", "text"], "left_anti"))
    found = match_works(cases.where(F.col("owner") != NONE), owned)
    second = cases.join(found, ["owner", "text"], "left").select("track_id", F.lit("work").alias("field"), F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))
    return first.unionByName(second)
