"""Names typed by people, brought to comparable parts; edit distance."""

from __future__ import annotations

import re
import unicodedata as U
from functools import cache

from quaverlake.llm.lookalikes import Rewriter

# Letters that no decomposition reduces to a base letter.
BASE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ħ": "h"})
# Cyrillic letters in Latin, letter for letter.
LATIN = str.maketrans(
    {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g"}
)
# Letters that transliteration does not keep apart.
SOUND = str.maketrans({"c": "k", "q": "k", "w": "v", "x": "ks"})
# Forms of address.
TITLES = frozenset("dr prof sir dame maestro maestra mr mrs ms miss herr frau mme mlle m professor doctor rev fr st".split()) - {"m"}
# Short forms of given names.
NICKNAMES = {
    "alek": ("aleksander",), "sasha": ("aleksander",), "toni": ("antonia",), "gus": ("augustin",), "bart": ("bartholomew",), "ben": ("benjamin",), "lotte": ("charlotte",), "des": ("desmond",), "dot": ("dorothea",), "dora": ("theodora", "dorothea"), "thea": ("theodora", "dorothea"), "betty": ("elisabeth",), "liesl": ("elisabeth",), "liz": ("elisabeth",), "manny": ("emanuel",), "flo": ("florian",), "freddy": ("frederik",), "fritz": ("frederik",), "gabe": ("gabriel",), "bella": ("isabella",), "hans": ("johannes",), "jo": ("johannes", "josephine"), "josie": ("josephine",), "kat": ("katarina",), "katya": ("katarina",), "kostya": ("konstantin",), "nora": ("leonora",), "luc": ("lucian",), "greta": ("margareta",), "max": ("maximilian",), "misha": ("mikhail",), "kolya": ("nikolai",), "nick": ("nikolai",), "pippa": ("philippa",), "roz": ("rosalind",), "basti": ("sebastian",), "toby": ("tobias",), "uli": ("ulrich",), "vova": ("vladimir",), "mina": ("wilhelmina",), "etta": ("henrietta",), "hetty": ("henrietta",), "bill": ("william",), "bob": ("robert",), "dick": ("richard",), "jack": ("john",), "kate": ("katarina", "katherine"), "peggy": ("margareta", "margaret"), "tom": ("thomas",), "willi": ("wilhelm",),
}
# Texts that name nobody.
PLACEHOLDERS = frozenset("unknown anonymous anon various traditional trad none na tba tbd nn untitled unbekannt anonyme anonimo divers verschiedene variousartists unknownartist unknowncomposer notknown unnamed diverse inconnu desconocido composerunknown".split())

_REWRITE: list[Rewriter] = []


def flat(text: str) -> str:
    """One plain form of a text: look-alikes resolved, Latin letters, lower case, no accents."""
    if not text.isascii():
        if not _REWRITE:
            _REWRITE.append(Rewriter())
        text = _REWRITE[0](text)
        text = "".join(c for c in U.normalize("NFKD", text.lower().translate(BASE)) if U.category(c) not in ("Mn", "Cf"))
        return text.translate(LATIN)
    return text.lower()


def sound(word: str) -> str:
    """The word with letters that transliteration confuses made one."""
    return word.translate(SOUND)


def placeholder(text: str) -> bool:
    """Whether the text names nobody."""
    bare = re.sub(r"[\W_]+", "", flat(text))
    return not bare or bare in PLACEHOLDERS


@cache
def _short() -> dict[str, tuple[str, ...]]:
    return {sound(k): tuple(map(sound, v)) for k, v in NICKNAMES.items()}


def full_names(nick: str) -> tuple[str, ...]:
    """The given names that a short form may stand for."""
    return _short().get(nick, ())


def person(text: str) -> tuple[str, list[str]]:
    """(surname, given parts) of a person's name, each by sound; given parts keep a final full stop.

    "Last, First", "First Last", "F. Last" and "Last" are told apart by comma and initials; of two
    whole words the last is taken as the surname (:func:`turned` gives the other reading). Dates and
    bracketed remarks, forms of address and quoted short names are left out.
    """
    s = flat(text)
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = re.sub(r"[\"“”„«»].*?[\"“”„«»]", " ", s)
    s = re.sub(r"\d+\s*[-–‑]\s*\d+|\d+", " ", s)
    head, _, tail = s.partition(",")
    take = lambda x: [w for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?", x) if w.rstrip(".") not in TITLES or len(w.rstrip(".")) == 1]
    first, last = take(tail), take(head)
    if first and last:
        words = first + last[:-1] if len(last) > 1 else first
        surname = last[-1]
    else:
        words = last or first
        if not words:
            return "", []
        at = len(words) - 1
        if len(words) > 1 and len(words[-1].rstrip(".")) == 1:
            at = max((i for i, w in enumerate(words) if len(w.rstrip(".")) > 1), default=at)
        surname = words[at]
        words = words[:at] + words[at + 1 :]
    return sound(surname.rstrip(".").replace("-", "").replace("'", "").replace("’", "")), [sound(w) for w in words]


def turned(surname: str, given: list[str]) -> tuple[str, list[str]] | None:
    """The reading with first and last word exchanged, for two or more whole words."""
    if given and len(given[0].rstrip(".")) > 1 and not given[0].endswith("."):
        return given[0], [*given[1:], surname]
    return None


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent exchanges, or most + 1 if it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(m + 1))
    for i in range(1, n + 1):
        ca = a[i - 1]
        row = [i] + [0] * m
        low = i
        for j in range(1, m + 1):
            cb = b[j - 1]
            x = prev[j - 1] if ca == cb else 1 + min(prev[j - 1], prev[j], row[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                x = min(x, before[j - 2] + 1)
            row[j] = x
            if x < low:
                low = x
        if low > most:
            return most + 1
        before, prev = prev, row
    return min(prev[m], most + 1)


def bound(word: str) -> int:
    """The edits that a word of this length may have suffered."""
    n = len(word)
    return 0 if n < 4 else 1 if n < 6 else 2


def given_fits(part: str, given: str) -> float:
    """How well a typed given part stands for a given name: 0 not at all, 1 the name itself."""
    bare = part.rstrip(".")
    if bare == given:
        return 1.0
    if len(bare) == 1:
        return 0.6 if given.startswith(bare) else 0.0
    if given in full_names(bare):
        return 0.9
    if len(bare) < len(given) and given.startswith(bare) and (part.endswith(".") or len(bare) >= 3):
        return 0.7
    d = osa(bare, given, max(bound(given), 1))
    if d <= max(bound(given), 1):
        return 0.95 - 0.1 * d
    if part.endswith(".") and 3 <= len(bare) <= 5 and osa(bare, given[: len(bare)], 1) <= 1:
        return 0.5
    return 0.0
