"""Visually identical text with different characters: one form for all.

Pairs of look-alike strings (compatibility forms and composed letters by rule from the character
database, look-alike letters of three scripts from a list and of all others from the public table of
confusable characters that Spark's ICU library brings, characters that show nothing paired with the
empty string) are closed transitively by union-find. Of each class the string that the corpus
uses most stands for the class, one for each script that a text may be written in. Texts are then
rewritten greedily, leftmost and longest first, by one multi-pattern automaton per script.
"""

from __future__ import annotations

import unicodedata as U
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Greek and Cyrillic letters, and the Latin letters that they look like.
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ι": "ı", "ϲ": "c", "ϳ": "j", "α": "ɑ", "Ϲ": "C", "Ϳ": "J"}
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "Ѕ": "S", "ѕ": "s", "І": "I", "і": "i", "Ї": "Ï", "ї": "ï", "Ј": "J", "ј": "j", "Ԁ": "D", "ԁ": "d", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "Һ": "H", "һ": "h", "Ү": "Y", "ү": "y", "Ӏ": "I", "ӏ": "l"}
# Other marks that look like the ordinary one.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "﹣": "-", "−": "-", "⁄": "/", "∕": "/", "ʼ": "'", "ˈ": "'", "՚": "'", "ꞌ": "'", "∶": ":", "꞉": ":", "․": ".", "‚": ",", "ı": "i", "ɑ": "a", "ɡ": "g", "ǃ": "!", "̀": "̀", "́": "́", "̓": "̓"}
# Characters that show nothing though their category does not say so.
EMPTY = "͏ᅟᅠ឴឵ㅤﾠ"

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")
Pairs = tuple[tuple[str, str], ...]


@cache
def script(ch: str) -> str:
    """The script of a letter, by its name; "" of what is no letter."""
    if not ch.isalpha():
        return ""
    name = U.name(ch, "")
    for lead in ("FULLWIDTH ", "HALFWIDTH ", "MATHEMATICAL "):
        if name.startswith(lead):
            return script(U.normalize("NFKC", ch)[0]) if U.normalize("NFKC", ch) != ch else ""
    return name.split()[0] if name else ""


@cache
def invisible(ch: str) -> bool:
    """Whether the character shows nothing."""
    return ch in EMPTY or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or U.category(ch) == "Cf" and not (0x600 <= ord(ch) <= 0x8E2 or 0x110BD <= ord(ch) <= 0x110CD)


def confusable_letters(spark: SparkSession) -> Pairs:
    """The letters of scripts other than :data:`SCRIPTS` that the public table takes for an ASCII letter.

    The driver asks the table once for all letters together. Letters written from right to left do
    not pass for Latin ones amid a word and are left out.
    """
    letters = [ch for o in range(0xA0, 0x2FFFF) if U.category(ch := chr(o))[0] == "L" and U.bidirectional(ch) == "L" and U.normalize("NFKC", ch) == ch and script(ch) not in ("", *SCRIPTS)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    likes = checker.getSkeleton("\n".join(letters)).split("\n")
    return tuple((a, b) for a, b in zip(letters, likes, strict=True) if len(b) == 1 and b.isascii() and b.isalpha())


def _pairs() -> Iterator[tuple[str, str]]:
    for table in (GREEK, CYRILLIC, MARKS):
        yield from table.items()
    for o in [*range(0xA0, 0x2FFFF), *range(0xE0000, 0xE0200)]:
        ch = chr(o)
        kind = U.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if invisible(ch):
            yield ch, ""
        elif kind == "Zs":
            yield ch, " "
        elif d := U.decomposition(ch):
            to = U.normalize("NFKC", ch)
            tag = d.split()[0] if d[0] == "<" else ""
            if not tag:
                yield U.normalize("NFD", ch), ch
                if to != ch:
                    yield ch, to
            elif " " not in to and (tag in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>") or tag == "<compat>" and kind[0] in "LN" and to.isalpha()):
                yield ch, to


@cache
def classes(more: Pairs = ()) -> dict[str, tuple[str, ...]]:
    """Every string that has look-alikes, with its whole class, sorted; ``more`` are further pairs."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in (*_pairs(), *more):
        up[find(a)] = find(b)
    of: dict[str, list[str]] = defaultdict(list)
    for x in list(up):
        of[find(x)].append(x)
    return {x: tuple(sorted(xs)) for xs in of.values() if len(xs) > 1 for x in xs}


def _scripts(s: str) -> set[str]:
    return {k for ch in s if (k := script(ch))}


def _automaton(words: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, v in words.items():
        if k:
            a.add_word(k, (k, v))
    a.make_automaton()
    return a


@cache
def _counter(more: Pairs) -> ahocorasick.Automaton:
    return _automaton({x: x for x in classes(more)})


def representatives(counts: dict[str, int], more: Pairs = ()) -> dict[str, dict[str, str]]:
    """For each script a map from every string to the one that stands for its class.

    Of a class's strings that are in the script, or in none, the most frequent one stands for it;
    of equals a plain one in composed form, then the shortest and first. A class without such a
    string keeps its strings for that script.
    """
    out: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for members in set(classes(more).values()):
        for s in SCRIPTS:
            own = [m for m in members if _scripts(m) <= {s} and not (m and U.name(m[0], "").startswith(("FULLWIDTH", "HALFWIDTH")))]
            if not own:
                continue
            best = "" if "" in own else max(own, key=lambda m: (counts.get(m, 0), m.isascii(), U.is_normalized("NFC", m), -len(m), [-ord(c) for c in m]))
            for m in members:
                if m != best:
                    out[s][m] = best
    return out


class Rewriter:
    """Rewrites texts to one form, given the corpus counts of the look-alike strings and further pairs."""

    def __init__(self, counts: dict[str, int] | None = None, more: Pairs = ()):
        self.automata = {s: _automaton(m) for s, m in representatives(counts or {}, more).items()}
        self.classes = classes(more)
        self.likes = frozenset((*GREEK, *CYRILLIC, *(a for a, _ in more)))

    def own(self, text: str) -> str:
        """The script most of the text's letters are in; those that could be of another count less."""
        n: Counter[str] = Counter()
        for ch in text:
            if k := script(ch):
                n[k] += 1 if k == "LATIN" or ch in self.likes else 3
        best = max(n, key=lambda k: (n[k], k == "LATIN"), default="LATIN")
        return best

    def __call__(self, text: str) -> str:
        # what shows nothing may stand between a letter and its accent: again until nothing changes,
        # or a form comes back; of forms that follow each other in a ring the first by code point counts
        seen = [text]
        while not text.isascii():
            text = self._once(text)
            if text in seen:
                return min(seen[seen.index(text) :])
            seen.append(text)
        return text

    def _once(self, text: str) -> str:
        own = self.own(text)
        if own not in self.automata:
            return self._run(text, "LATIN", keep=True)
        if not any((k := script(ch)) and k != own for ch in text):
            return self._run(text, own)
        out, word = [], []
        for ch in text + "\0":
            if ch.isalpha() or U.category(ch) in ("Mn", "Cf"):
                word.append(ch)
                continue
            if word:
                out.append(self._word("".join(word), own))
                word = []
            out.append(self._run(ch, own))
        return "".join(out)[:-1]

    def _word(self, word: str, own: str) -> str:
        other = _scripts(word) - {own}
        whole = not any(script(ch) == own for ch in word)
        if whole and other and any(script(ch) in other and len({_s for m in self.classes.get(ch, ()) for _s in _scripts(m)} & {own}) == 0 for ch in word):
            k = max(other, key=lambda s: sum(script(ch) == s for ch in word))
            return self._run(word, k if k in self.automata else "LATIN", keep=k not in self.automata)
        return self._run(word, own)

    def _run(self, text: str, s: str, keep: bool = False) -> str:
        """keep: letters and marks stay, for a script without look-alikes here."""
        out, at = [], 0
        for end, (k, v) in self.automata[s].iter_long(text):
            start = end - len(k) + 1
            if keep and any(script(c) and not U.name(c, "").startswith(("FULLWIDTH", "HALFWIDTH")) for c in k):
                continue
            out += [text[at:start], v]
            at = end + 1
        return "".join(out) + text[at:] if at else text


def count_lookalikes(texts: DataFrame, column: str, more: Pairs = ()) -> dict[str, int]:
    """How often each string of a look-alike class occurs in the texts.

    Each partition counts by itself; the sums are at most one row for each string of the fixed
    classes, whatever the size of the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf[column]:
                n.update(t if t.isascii() else (k for _, (k, _v) in _counter(more).iter_long(t)))
        held = [k for k in n if k in classes(more)]
        yield pd.DataFrame({"s": pd.Series(held, dtype=object), "n": pd.Series([n[k] for k in held], dtype="int64")})

    rows = texts.where(F.col(column).isNotNull()).select(column).mapInPandas(count, "s string, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r.s: r.n for r in rows}


@cache
def _rewriter(counts: Pairs, more: Pairs) -> Rewriter:
    return Rewriter(dict(counts), more)


def rewritten(texts: DataFrame, column: str, counts: dict[str, int], more: Pairs = ()) -> DataFrame:
    """``(column, plain)`` for each distinct text; NULL is dropped, the empty text stays empty."""

    told = tuple(sorted(counts.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = _rewriter(told, more)  # made once for each worker
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "plain": [rewrite(t) for t in pdf[column]]})

    return texts.where(F.col(column).isNotNull()).select(column).distinct().mapInPandas(run, f"`{column}` string, plain string")


def disguised(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``(key, field, text, plain)`` of every text that its one form differs from.

    Repeated rows of a key count once; NULL and empty texts have no row. A text is handled once
    however many rows hold it. Columns other than these are not read.
    """
    long = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])))
    long = long.where(F.col("text").rlike(r"[^\x00-\x7F]")).distinct()
    more = confusable_letters(rows.sparkSession)
    counts = count_lookalikes(rows.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("text")), "text", more)
    plain = rewritten(long.select("text").distinct(), "text", counts, more).where("text <> plain")
    return long.join(plain, "text").select(F.col("key").alias(key), "field", "text", "plain")
