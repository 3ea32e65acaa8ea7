"""Sentence boundaries across languages and scripts.

The terminators of all scripts are the characters whose sentence-break property says so (STerm and
ATerm of the character database). Then comes what suppresses a break: abbreviations of the scripts' languages, decimals and names with dots, initials, ordinals, a
following small letter, and quotations and brackets that are part of a sentence. Thai, which has no
terminators, breaks at blanks that do not belong to a number. Positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that something of the same sentence always follows.
OPENING = frozenset(
    "mr mrs ms messrs dr prof st rev hon gen col capt lt sgt mt vs cf viz approx vol vols nos fol ff fig figs ed eds pp pl ch sec.no "
    "hr fr frl nr bd bde abt vgl bzw ca ggf inkl zzgl hrsg jg str evtl sog dgl geb gest bes anm aufl mme mlle mm env ex av réf num chap éd "
    "sr sra srta dra ud uds pág págs aprox ej núm tel av dpto cap "
    "стр им ок соч проф ул гр акад доц тов илл табл рис см ср напр "
    "σελ βλ περ δηλ κ κα αρ τομ κεφ πρβλ "
    "ص د م أ "
    "डॉ पृ श्री प्रो सं".split()
)
# Abbreviations before a number; without one they are ordinary last words.
BEFORE_NUMBER = frozenset("no p op art n nº kv bwv hob".split())
# Abbreviations that may also end a sentence.
EITHER = frozenset("etc usw uvm ltd co inc corp bros jr cie al sec min hrs std mio mill a.m p.m u.s u.k r.p.m г гг мин сек руб тыс κ.λπ κ.ά".split())
# Measures that a further number may follow ("3 min. 24 sec.").
MEASURES = frozenset("sec min hrs std мин сек руб".split())
# Dotted abbreviations that never end one.
NEVER = frozenset("i.e e.g d.h z.b u.a p.ex p.ej т.е т.к".split())
# Nouns that a single letter names ("side A").
LETTERED = frozenset("side seite face cara lato стороне сторона сторону πλευρά teil part".split())
# German months, and words before an ordinal.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())
ORDINAL_AFTER = frozenset("am vom zum dem den der des im beim".split())
# Thai words that go on with a clause, and words whose number closes a clause.
THAI_GOES_ON = ("ที่", "ของ", "และ", "หรือ", "แต่", "ซึ่ง", "โดย", "กับ", "ใน", "จาก", "ๆ")
THAI_YEAR = ("ปี", "พ.ศ.", "ค.ศ.")

_EVERY = "".join(chr(o) for o in range(0x20000) if not 0xD800 <= o < 0xE000)
#: Full-width stops, after which no blank is written.
HARD = "。！？｡．︒﹖﹗"
#: All that ends a sentence but the full stop itself: the property, dots of omission, the Tibetan shad.
TERMS = "".join(c for c in regex.findall(r"\p{SB=ST}", _EVERY) if c not in HARD) + "…།" + HARD
STOPS = ".․﹒"
#: Those after which a script may go on without a blank.
SPACELESS = frozenset(c for c in TERMS if c > "\u0500" and c not in "…‼‽⁇⁈⁉")
PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]", "《": "》", "〈": "〉", "【": "】"}
CLOSERS = "»”“」』›)）]》〉】\"'’"
_BLANK = " \t  　      \r\n\f\v"
_NUMERAL = re.compile(r"\s*[ivxlcdm]+\b", re.I)
_GAP = re.compile(r"\r?\n[^\S\n]*\n\s*")
_EVENT = re.compile(rf"[{re.escape(STOPS + TERMS)};;]+|[{re.escape(''.join(PAIRS))}\"]|[฀-๿0-9][  ]+(?=[฀-๿])")
_WORD = re.compile(r"[^\s\d_()\[\]«»“”„\"'‘’,;:!?/…。、！？「」『』—–\-\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_MARKS = re.compile(f"[{re.escape(''.join(PAIRS) + ''.join(PAIRS.values()))}]")
_OPENERS = {c: [a for a, cs in PAIRS.items() if c in cs and a != "„"] for cs in PAIRS.values() for c in cs}
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _quotes(p: str) -> dict[int, int]:
    """Where each opening quote or bracket of the paragraph closes, in one pass with a stack for each kind.

    A low quote may close with the mark that opens quotes elsewhere; marks within it are not read.
    """
    out: dict[int, int] = {}
    straight = [i for i, ch in enumerate(p) if ch == '"']
    for a, b in zip(straight[::2], straight[1::2], strict=False):
        out[a] = b
    low, closed = [], {}
    for m in _MARKS.finditer(p) if "„" in p else ():
        if m[0] == "„":
            low.append(m.start())
        elif m[0] in PAIRS["„"] and low:
            closed[low.pop()] = m.start()
    open_: dict[str, list[int]] = {ch: [] for ch in PAIRS}
    taken = -1
    for m in _MARKS.finditer(p):
        i, ch = m.start(), m[0]
        if i <= taken:
            continue
        if i in closed:
            out[i] = taken = closed[i]
            continue
        for opener in _OPENERS.get(ch, ()):
            if open_[opener]:
                out[open_[opener].pop()] = i
        if ch in open_:
            open_[ch].append(i)
    return out


@cache
def _in_word(ch: str) -> bool:
    return _WORD.match(ch) is not None


def _back(p: str, i: int, over: Callable[[str], bool]) -> int:
    """Where the run of such characters that ends before i begins."""
    while i and over(p[i - 1]):
        i -= 1
    return i


def _letter(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _next(p: str, i: int) -> str:
    """The first character from i on that is no blank, opening mark or dash of direct speech."""
    while i < len(p) and (p[i] in _BLANK or p[i] in PAIRS or p[i] in "\"'¿¡‘"):
        i += 1
    if p[i : i + 1].islower() and p[i + 1 : i + 2].isupper():
        return p[i + 1]  # a brand such as "iReel" opens a sentence too
    return p[i] if i < len(p) else ""


def _starts(ch: str) -> bool:
    """Whether a sentence may begin with it."""
    return not ch or ch.isdigit() or (ch.isalpha() and not ch.islower()) or ch in "•*#№§$£€"


def _period(p: str, i: int, end: int) -> bool:
    """Whether the full stop at i (the run of stops ends at end) closes a sentence."""
    nxt = _next(p, end)
    if not _starts(nxt):
        return False
    if end - i > 1:
        return True
    at = _back(p, i, _in_word)
    if not p[at:i].strip("."):
        if p[i - 1 : i].isdigit() and nxt.isupper():
            digits = _back(p, i, str.isdigit)
            gap = _back(p, digits, str.isspace)
            last = p[_back(p, gap, lambda c: not c.isspace()) : gap]
            follow = re.compile(r"\s*(\w+)").match(p, end)
            if i - digits <= 2 and gap < digits and follow and (follow[1] in MONTHS or (last in ORDINAL_AFTER and p[end : end + 1] == " " and follow[1][0].isupper())):
                return False
        return True
    word = p[at:i].lstrip(".")
    low = word.lower()
    if low in EITHER:
        return not (low in MEASURES and nxt.isdigit())
    if low in NEVER or low in OPENING:
        return False
    if low in BEFORE_NUMBER:
        return not (nxt.isdigit() or _NUMERAL.match(p, end))
    if len(word) == 1 and not _WIDE.match(word):
        stop = _back(p, at, lambda c: not _letter(c))
        last = p[_back(p, stop, _letter) : stop].lower()
        if low == "д" and last == "т":
            return True
        if word.isupper() and last in LETTERED:
            return True
        return not word.isalpha()
    if "." in word:
        return all(len(x) == 1 for x in word.split(".")) is False or not nxt.islower()
    return True


def _thai(p: str, i: int, end: int) -> bool:
    """Whether the blanks before ``end``, after the character at i, separate two Thai sentences."""
    if p.startswith(THAI_GOES_ON, end):
        return False
    if p[i].isdigit():
        digits = _back(p, i + 1, str.isdigit)
        return i + 1 - digits == 4 and p.endswith(THAI_YEAR, 0, _back(p, digits, str.isspace))
    return True


def boundaries(p: str) -> list[int]:
    """The ends of the sentences of one paragraph, but for its own end."""
    out: list[int] = []
    pairs = _quotes(p)
    hold = -1  # the mark that closes the quotation we are in
    n = len(p)
    pos = 0
    while m := _EVENT.search(p, pos):
        i, pos = m.start(), m.end()
        run = m[0]
        if run[0] in PAIRS or run[0] == '"':
            close = pairs.get(i)
            if close is None:
                continue
            pos = close + 1
            k = close - 1
            while k > i and p[k] in _BLANK:
                k -= 1
            if p[k] not in TERMS + ".;;" or (p[k] == ";" and not "Ͱ" <= p[k - 1] <= "Ͽ"):
                continue
            end = pos
            while end < n and p[end] in CLOSERS and end not in pairs:
                end += 1
            if p[end : end + 1] in (*TERMS, ".", ""):
                continue
            if p[end] in _BLANK and _starts(_next(p, end)) and not (p[k] == "." and not _period(p, k, k + 1) and _next(p, k + 1) == _next(p, end)):
                # a quotation that opens the sentence and is followed by a name goes on only if a
                # small letter, comma or dash follows; here something new begins
                out.append(end)
                pos = end
            continue
        if run[-1] in "  ":
            if _thai(p, i, pos):
                out.append(i + 1)
            continue
        if run[0] in ";;":
            if not (i and "Ͱ" <= p[i - 1] <= "Ͽ" or i and "ἀ" <= p[i - 1] <= "῿"):
                continue
        end = pos
        while end < n and p[end] in CLOSERS and end not in pairs:
            end += 1
        if end >= n:
            break
        hard = run[0] in HARD or (run[0] in "!?…" and _WIDE.match(p[end] or " "))
        if hard:
            if p[end] in "、，,と" and end > m.end():
                continue
            out.append(end)
        elif p[end] not in _BLANK:
            if not (run[0] in SPACELESS and p[end].isalpha()) and not (run[0] in ".!?" and _WIDE.match(p[i - 1] if i else " ") and _starts(p[end])):
                continue
            out.append(end)
        elif run[0] in STOPS and run.strip(STOPS) == "":
            if _period(p, i, m.end()):
                out.append(end)
        elif _starts(_next(p, end)):
            out.append(end)
        pos = max(pos, end)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """The sentences of a text as [start, end) in code points, without surrounding whitespace."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*_GAP.finditer(text), None]:
        stop = m.start() if m else len(text)
        p = text[at:stop]
        last = 0
        for e in [*boundaries(p), len(p)]:
            a, b = last, e
            while a < b and p[a].isspace():
                a += 1
            while b > a and p[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((at + a, at + b))
            last = e
        at = m.end() if m else stop
    return out


def split_sentences(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, start_pos, end_pos)``: one row per sentence of every document, whole texts.

    A NULL or empty text has no rows, nor has one of whitespace. Rows are taken as they are: a
    repeated row gives its sentences again. Only ``key`` and ``column`` are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                for a, b in sentences(t):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"k": pd.Series(keys, dtype=pdf["k"].dtype), "start_pos": pd.Series(starts, dtype="int32"), "end_pos": pd.Series(ends, dtype="int32")})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(key).alias("k"), F.col(column).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, start_pos int, end_pos int").withColumnRenamed("k", key)
