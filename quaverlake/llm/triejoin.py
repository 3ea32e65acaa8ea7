"""Trie join: all pairs of words within a bounded edit distance, without comparing all pairs.

Words are sharded by pieces that neighbours must share: one piece more than edits, so that one stays
whole; where an exchange of two letters may straddle a border of pieces, the piece is held in its
exchanged form too. Each shard is a trie of words of one length; the words that might be neighbours
are run down it by a Levenshtein automaton with adjacent exchanges. The automaton is universal: its
states are rows of distances near the diagonal, its letters say where the trie's letter stands in the
word nearby, so each state is worked out once for all words and a step is two look-ups. A word asks
for its own and smaller lengths only, for the pair is the same either way. Shards that are large, on
either side, are dealt out in a grid of bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.names import bound
from quaverlake.session import cut

#: Words of one trie and questions that it answers; more are dealt to further tries and copies.
HELD, QUESTIONS = 4_000, 4_000
#: Rows of work, of words held and questions asked, that make one task.
TASK_ROWS = 20_000


def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of a word of n letters: one more than edits."""
    k = most + 1
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def holds(word: str) -> set[str]:
    """The shards that hold the word: by its pieces, as they are and with letters exchanged over their borders."""
    n, most = len(word), bound(word)
    out = set()
    for i, (a, b) in enumerate(pieces(n, most)):
        forms = {word[a:b]}
        if a:
            forms |= {word[a - 1] + p[1:] for p in forms}
        if b < n:
            forms |= {p[:-1] + word[b] for p in forms}
        out |= {f"{n}/{i}/{p}" for p in forms}
    return out


def asks(word: str) -> set[str]:
    """The shards of words no longer than this one that may be its neighbours.

    A piece that stayed whole stands as far off its place as letters were added or lost before it;
    what is added before the first counts as its own error, what is added after a piece as that piece's.
    """
    size = len(word)
    out = set()
    for n in range(max(size - 2, 4), size + 1):
        most, more = bound("x" * n), size - n
        if more > most:
            continue
        parts = pieces(n, most)
        for i, (a, b) in enumerate(parts):
            off = [0] if i == 0 else [more] if i == len(parts) - 1 else [s for s in range(-most, most + 1) if abs(s) + abs(more - s) <= most]
            out |= {f"{n}/{i}/{word[a + s : b + s]}" for s in off if 0 <= a + s and b + s <= size}
    return out


class Automaton:
    """Universal Levenshtein automaton with adjacent exchanges, for ``most`` edits and words ``more`` letters longer.

    A state is the row of distances to the words' prefixes, ``most`` to either side of the diagonal,
    and the row that an exchange could still reach; distances that cannot come down to ``most`` by the
    end are left out. A step reads ``2 * most + 3`` bits: where around the diagonal the letter stands
    in the word. States are made when first met and kept; 0 is the dead one.
    """

    def __init__(self, most: int, more: int):
        self.most, self.more, self.width = most, more, 2 * most + 1
        self.bits = (1 << (2 * most + 3)) - 1
        self.far = most + 1
        self.rows: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((), ())]
        self.steps: list[dict[int, int]] = [{}]
        self.known: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        self.start = self._state(tuple(self._kept(k, k - most if k >= most else self.far) for k in range(self.width)), (self.far,) * self.width)

    def _kept(self, k: int, d: int) -> int:
        return d if d + abs(self.more - (k - self.most)) <= self.most else self.far

    def _state(self, row: tuple[int, ...], swap: tuple[int, ...]) -> int:
        if min(row) > self.most and min(swap) > self.most:
            return 0
        if (row, swap) not in self.known:
            self.known[row, swap] = len(self.rows)
            self.rows.append((row, swap))
            self.steps.append({})
        return self.known[row, swap]

    def step(self, state: int, seen: int) -> int:
        row, swap = self.rows[state]
        new: list[int] = []
        for k in range(self.width):
            d = row[k] + (0 if seen >> (k + 1) & 1 else 1)
            if k + 1 < self.width:
                d = min(d, row[k + 1] + 1)
            if k:
                d = min(d, new[-1] + 1)
            if seen >> k & 1:
                d = min(d, swap[k])
            new.append(self._kept(k, min(d, self.far)))
        later = tuple(self._kept(k, min(row[k] + 1, self.far)) if seen >> (k + 2) & 1 else self.far for k in range(self.width))
        self.steps[state][seen] = to = self._state(tuple(new), later)
        return to

    def edits(self, state: int) -> int:
        """The distance, at the end of a trie's word."""
        return self.rows[state][0][self.more + self.most]


@lru_cache(None)
def automaton(most: int, more: int) -> Automaton:
    return Automaton(most, more)


@lru_cache(50_000)
def _places(word: str, shift: int) -> dict[str, int]:
    """For each letter the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, ch in enumerate(word):
        out[ch] = out.get(ch, 0) | 1 << (i + shift)
    return out


class Trie:
    """Words of one length by their letters; a branch with one word is that word."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, word: str) -> None:
        self.size = len(word)
        node = self.root
        for d, ch in enumerate(word):
            sub = node.get(ch)
            if sub is None:
                node[ch] = word
                return
            if isinstance(sub, str):
                if sub == word:
                    return
                node[ch] = sub = {sub[d + 1]: sub}
            node = sub

    def near(self, word: str) -> list[tuple[str, int]]:
        """The trie's words within the edits that one of their length may have, with their edits; those
        of the word's own length only if they come before it."""
        n = self.size
        most, more = bound("x" * n), len(word) - n
        a = automaton(most, more)
        steps, step, bits = a.steps, a.step, a.bits
        at = _places(word, most + 1)
        out = []
        stack = [(self.root, a.start, 0)]
        while stack:
            node, state, d = stack.pop()
            row = steps[state]
            for ch, sub in node.items():
                seen = at.get(ch, 0) >> d & bits
                to = row.get(seen)
                if to is None:
                    to = step(state, seen)
                if not to:
                    continue
                if not isinstance(sub, str):
                    stack.append((sub, to, d + 1))
                    continue
                for e in range(d + 1, n):
                    seen = at.get(sub[e], 0) >> e & bits
                    now = to
                    to = steps[now].get(seen)
                    if to is None:
                        to = step(now, seen)
                    if not to:
                        break
                if to and (x := a.edits(to)) <= most and (more or sub < word):
                    out.append((sub, x))
        return out


def near_words(words: DataFrame, column: str) -> DataFrame:
    """``(word, near, edits)``: each distinct word with every other within its edit bound.

    The bound is that of the shorter of the two (none below four letters, 1 below six, else 2). NULL
    and empty words have no row; repeated words count once; an empty table gives an empty result.
    """
    distinct = words.where(F.col(column).isNotNull() & (F.length(column) > 3)).select(F.col(column).alias("word")).distinct()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                rows += [(k, 0, w) for k in holds(w)]
                rows += [(k, 1, w) for k in asks(w)]
            if rows:
                yield pd.DataFrame(rows, columns=["shard", "asks", "word"])

    spreaded = cut(distinct.mapInPandas(spread, "shard string, asks int, word string"))
    # a shard whose one word nobody else asks for has nothing to say
    count = spreaded.groupBy("shard").agg(F.count_if(F.col("asks") == 0).alias("held"), F.count_if(F.col("asks") == 1).alias("asked")).where("held > 0 and asked > 0 and held + asked > 2")
    load = cut(count.select("shard", F.ceil(F.col("held") / HELD).cast("int").alias("tries"), F.ceil(F.col("asked") / QUESTIONS).cast("int").alias("copies"), (F.col("held") + F.col("asked")).alias("rows")))
    total = load.agg(F.sum(F.col("rows") * F.greatest("tries", "copies"))).first()[0] or 0
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = F.col("asks") == 1
    dealt = (
        spreaded.join(load, "shard")
        .withColumn("trie", F.explode(F.when(asking, every("tries")).otherwise(F.array(own("tries")))))
        .withColumn("copy", F.explode(F.when(asking, F.array(own("copies"))).otherwise(every("copies"))))
        .select("shard", "trie", "copy", "asks", "word")
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trie = None, Trie()
        for pdf in batches:
            out = []
            for shard, t, c, asked, w in pdf.itertuples(index=False, name=None):
                if (shard, t, c) != at:
                    at, trie = (shard, t, c), Trie()
                if asked:
                    if trie.size:
                        for x, d in trie.near(w):
                            out += [(w, x, d), (x, w, d)]
                else:
                    trie.add(w)
            if out:
                yield pd.DataFrame(out, columns=["word", "near", "edits"])

    # by the work there is: by bytes all would be one task
    tasks = max(min(-(-total // TASK_ROWS), 20_000), 1)
    return dealt.repartition(tasks, "shard", "trie", "copy").sortWithinPartitions("shard", "trie", "copy", "asks").mapInPandas(answer, "word string, near string, edits int").distinct()
