"""Several values packed in one field: split into one row per value, by delimiter skeletons.

A text is cut into atoms: runs of ordinary words, joining words, blanks, and single marks. Its
*skeleton* masks each run by a class of one letter and keeps the marks, so that millions of texts
share a few thousand skeletons. A splitting rule (the atom spans of its values) is worked out once
for each distinct skeleton, the rules are joined back (broadcast while their number is within
``session.BROADCAST_ROWS``, shuffled beyond) and the values are taken out by position. Texts are
handled once per distinct value, so a text that a third of all rows holds costs one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.session import cut, small

#: Words that join two values; a comma list may end with one.
JOINING = ("and", "with", "feat", "featuring", "ft", "und", "et", "con", "mit", "avec")
#: Instrument words that a joining mark holds together within one body's name.
COUPLES = (("reed", "bow"), ("drum", "fife"))

_WORD = r"[\p{L}\p{M}\p{N}\p{Cf}\x{AD}]+(?:['’.\-‐‑][\p{L}\p{M}\p{N}\p{Cf}]+)*\.?|\([^()]*\)"
_JOIN = r"(?:" + "|".join(JOINING) + r")(?![\p{L}\p{M}])\.?"
_COUPLE = (
    r"\p{L}{3,5}(?:\s*[&/]\s*|\s+and\s+)\p{L}{2,5}\s+c[onsrtp]{1,7}(?![\p{L}])\.?|(?:"
    + "|".join(a for a, _ in COUPLES)
    + r")(?:\s*[&/]\s*|\s+and\s+)(?:"
    + "|".join(b for _, b in COUPLES)
    + r")\p{L}*"
)
_UNIT = rf"(?:{_COUPLE}|(?!{_JOIN}(?:\s|$))(?:{_WORD}))"
_ATOM = rf"(?is)({_UNIT}(?:[ \x{{A0}}]+{_UNIT})*|{_JOIN}|\\.|\"\"|[ \x{{A0}}]+|[\t\r\n]+|.)"
_INITIALS = r"(?:\p{L}\p{M}*\.?[ -]?)+"

STRONG = set(";|/&+•·\n\tJ") | {"、", "；", "／"}
COMMAS = {",", "，"}
QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”", "„": "“", "‘": "’", "‹": "›"}


def atoms(text: Column) -> Column:
    """The text cut into atoms; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(_ATOM), 1)


def mask(atom: Column) -> Column:
    """The one-character class of an atom: A several words, a one word, i initials, g a word and
    initials, J joining word, q escaped quote, blank, tab or line end, else the mark itself."""
    return (
        F.when(atom.rlike(rf"(?i)^{_JOIN}$"), "J")
        .when(atom.rlike(r"^[ \x{A0}]+$"), " ")
        .when(atom.rlike(r"^[\t\r\n]+$"), "\n")
        .when((atom == '""') | atom.rlike(r"^\\"), "q")
        .when(atom.rlike(rf"^(?:\p{{L}}\p{{M}}*\.?|(?:\p{{L}}\p{{M}}*\.[ -]?)+\p{{L}}?\.?)$"), "i")
        .when(atom.rlike(rf"^[\p{{L}}\p{{M}}'’\-\p{{Cf}}]+\.? {_INITIALS}$") & ~atom.rlike(r"\p{L}\p{L}.* \p{L}\p{L}"), "g")
        .when(atom.rlike(r"^[\p{L}\p{M}\p{N}\p{Cf}\x{AD}'’.\-‐‑]{2,}$"), "a")
        .when(atom.rlike(r"^[\p{L}\p{N}(]"), "A")
        .otherwise(F.substring(atom, 1, 1))
    )


def spans(skeleton: str) -> list[tuple[int, int, bool]]:
    """The atom spans [from, to) of the values of a skeleton, and whether each stood in quotes.

    Marks of :data:`STRONG` and joining words always separate. A comma separates too, unless it is
    the only one between two of them and stands between one word and a word or initials, or before
    one last word: then it turns one name round ("Last, First", "Wind Band, Town"). Quoted values are whole; a quote amid a value belongs to it.
    """
    s, n = skeleton, len(skeleton)
    lo, hi = 0, n
    while lo < hi and s[lo] in " \n":
        lo += 1
    while hi > lo and s[hi - 1] in " \n":
        hi -= 1
    if hi - lo >= 2 and s[lo] == "[" and s[hi - 1] == "]":
        lo, hi = lo + 1, hi - 1
    segments: list[list[tuple[int, int, bool]]] = [[]]
    start, i = lo, lo

    def piece(a: int, b: int, quoted: bool = False) -> None:
        while a < b and s[a] in " \n":
            a += 1
        while b > a and s[b - 1] in " \n":
            b -= 1
        if b > a:
            segments[-1].append((a, b, quoted))

    while i < hi:
        ch = s[i]
        if ch in QUOTES and not s[start:i].strip(" \n"):
            end = _closing(s, i + 1, hi, QUOTES[ch])
            if end is not None:
                piece(i + 1, end, True)
                i = end + 1
                while i < hi and s[i] == " ":
                    i += 1
                start = i
                continue
        if ch in STRONG or ch in COMMAS:
            piece(start, i)
            if ch in STRONG:
                segments.append([])
            start = i + 1
        i += 1
    piece(start, hi)
    out: list[tuple[int, int, bool]] = []
    for seg in segments:
        if len(seg) == 2 and not seg[0][2] and not seg[1][2]:
            (a, b, _), (c, d, _) = seg
            if (s[a:b] == "a" and s[c:d] in ("a", "i", "g")) or (s[a:b] == "A" and s[c:d] == "a"):
                out.append((a, d, False))
                continue
        out += seg
    return [x for x in out if re.search(r"[Aaig]", s[x[0] : x[1]]) or not re.fullmatch(r"[\W_J]*", s[x[0] : x[1]])]


def _closing(s: str, i: int, hi: int, close: str) -> int | None:
    """Where the quote closes: at a closing mark before a delimiter or the end."""
    for j in range(i, hi):
        if s[j] == close:
            k = j + 1
            while k < hi and s[k] == " ":
                k += 1
            if k >= hi or s[k] in STRONG or s[k] in COMMAS or s[k] == "J":
                return j
    return None


_RULE = "array<struct<a:int,b:int,q:boolean>>"


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "rule": [[{"a": a, "b": b, "q": q} for a, b, q in spans(s)] for s in pdf["skeleton"]]})


def split_values(texts: DataFrame, column: str) -> DataFrame:
    """``(column, names)`` for each distinct text: the values of it in order, as typed.

    NULL texts are dropped; an empty text, or one of marks only, has an empty array. Repeated rows
    count once. Further columns of ``texts`` are not read. Values keep their letters; surrounding
    blanks and quoting are removed and escaped quotes undone. Longest texts are handled whole.
    """
    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("__t")).distinct()
    cutup = distinct.withColumn("__atoms", atoms(F.col("__t"))).withColumn("skeleton", F.array_join(F.transform("__atoms", mask), ""))
    rules = small(cut(cutup.select("skeleton").distinct().mapInPandas(_resolve, f"skeleton string, rule {_RULE}")))
    taken = F.transform(
        "rule",
        lambda r: F.struct(
            F.array_join(F.slice("__atoms", r.a + 1, r.b - r.a), "").alias("v"),
            r.q.alias("q"),
        ),
    )
    undone = F.transform(
        taken,
        lambda p: F.when(p.q, F.regexp_replace(F.replace(p.v, F.lit('""'), F.lit('"')), r"\\(.)", "$1")).otherwise(
            F.regexp_replace(p.v, r'\\"', '"')
        ),
    )
    names = F.filter(F.transform(undone, lambda x: F.regexp_replace(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), lambda x: x != "")
    return cutup.join(rules, "skeleton").select(F.col("__t").alias(column), names.alias("names"))


def exploded_values(rows: DataFrame, key: str, column: str, at_least: int = 1) -> DataFrame:
    """``(key, pos, name)``: one row for each value of each key's text that holds ``at_least`` or more.

    ``pos`` counts from 1; empty pieces are not counted. Keys with a NULL text have no row, and
    repeated rows of a key count once. Beside ``key`` and ``column`` no column is read.
    """
    once = rows.select(F.col(key).alias("__k"), F.col(column).alias("__c")).where(F.col("__k").isNotNull() & F.col("__c").isNotNull()).distinct()
    values = split_values(once.select(F.col("__c").alias("__v")), "__v").where(F.size("names") >= at_least)
    return (
        once.join(values, F.col("__c") == F.col("__v"))
        .select(F.col("__k").alias(key), F.posexplode("names").alias("pos", "name"))
        .select(key, (F.col("pos") + 1).cast("int").alias("pos"), "name")
    )
