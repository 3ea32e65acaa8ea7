"""Evaluation texts leaking into training text.

The test items form a BM25 inverted index whose postings lie in blocks with their largest score.
Every training text is cut into overlapping passages, each a query: block-max WAND finds all items
that score above the threshold, and a run of shared words then proves the leak. The threshold is
the least score that any run of an item can have, so retrieval loses no leak.
"""

from __future__ import annotations

import math
import re
import unicodedata as U
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
RUN = 10
#: Words of a passage; passages overlap by RUN - 1, so each run lies whole in one.
PASSAGE = 64
#: Items of one index, and characters of their texts; more make further indexes, each asked by every passage.
ITEMS, CHARS = 20_000, 20_000_000
BLOCK, K1, B = 16, 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")
#: Accents and characters that show nothing.
_UNSEEN = dict.fromkeys(o for o in range(0xA0, 0xE0200) if U.category(chr(o)) in ("Mn", "Cf"))


def words(text: str) -> list[str]:
    """Words without regard to letter case, accents, punctuation, spacing and unseen characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(U.normalize("NFKD", text.casefold()).translate(_UNSEEN))


class Index:
    """BM25 postings in blocks, searched by WAND with block maxima."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words(t)) for i, t in items]
        df = Counter(w for _, ws in self.items for w in set(ws))
        n = len(self.items)
        mean = sum(len(ws) for _, ws in self.items) / max(n, 1)
        self.runs: list[set[tuple[str, ...]]] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.least: list[float] = []
        for k, (_, ws) in enumerate(self.items):
            weight = {}
            for w, f in Counter(ws).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weight[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
                postings[w].append((k, weight[w]))
            grams = {tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1)}
            self.runs.append(grams)
            self.least.append(min((sum(weight[w] for w in set(g)) for g in grams), default=math.inf))
        self.threshold = min(self.least, default=math.inf) * (1 - 1e-9)
        self.blocks = {
            w: [(b[0][0], b[-1][0], max(s for _, s in b), dict(b)) for i in range(0, len(ps), BLOCK) if (b := ps[i : i + BLOCK])] for w, ps in postings.items()
        }
        self.top = {w: max(b[2] for b in bs) for w, bs in self.blocks.items()}

    def search(self, query: set[str]) -> list[int]:
        """All items whose score is at least the threshold, by place in ``items``."""
        found = []
        lists = [[self.blocks[w], self.top[w], 0, self.blocks[w][0][0]] for w in query]  # blocks, bound, block, item
        while lists:
            lists.sort(key=lambda x: x[3])
            total, pivot = 0.0, -1
            for j, x in enumerate(lists):
                total += x[1]
                if total >= self.threshold:
                    pivot = j
                    break
            if pivot < 0:
                break
            at = lists[pivot][3]
            while pivot + 1 < len(lists) and lists[pivot + 1][3] == at:
                pivot += 1
            bound, ahead = 0.0, math.inf
            for x in lists[: pivot + 1]:
                b = x[2]
                while b < len(x[0]) and x[0][b][1] < at:
                    b += 1
                if b < len(x[0]):
                    if x[0][b][0] <= at:
                        bound += x[0][b][2]
                        ahead = min(ahead, x[0][b][1] + 1)
                    else:
                        ahead = min(ahead, x[0][b][0])
            if bound >= self.threshold:
                score = 0.0
                for x in lists[: pivot + 1]:
                    self._seek(x, at)
                    if x[3] == at:
                        score += x[0][x[2]][3][at]
                        self._seek(x, at + 1)
                if score >= self.threshold and score >= self.least[at] * (1 - 1e-9):
                    found.append(at)
            else:
                if pivot + 1 < len(lists):
                    ahead = min(ahead, lists[pivot + 1][3])
                to = max(at + 1, ahead)
                for x in lists[: pivot + 1]:
                    self._seek(x, to)
            lists = [x for x in lists if x[3] >= 0]
        return found

    @staticmethod
    def _seek(x: list, item: float) -> None:
        """Moves a posting list on to its first item from ``item`` on; -1 at its end."""
        blocks, b = x[0], x[2]
        while b < len(blocks) and blocks[b][1] < item:
            b += 1
        x[2] = b
        x[3] = next((k for k in blocks[b][3] if k >= item), -1) if b < len(blocks) else -1

    def leaks(self, text: str) -> set[int]:
        """The ids of the items of which the text has a run."""
        ws = words(text)
        bounds = list(map(self.top.get, ws))
        out: set[int] = set()
        # a run has only words of the index, and no more than the sum of their bounds: elsewhere
        # a passage need not be asked for
        n, i, whole = len(ws), 0, []
        while i < n:
            if bounds[i] is None:
                i += 1
                continue
            j = i
            while j < n and bounds[j] is not None:
                j += 1
            if j - i >= RUN:
                whole.append((i, j))
            i = j
        for i, j in whole:
            for a in range(i, max(i + 1, j - RUN + 1), PASSAGE - RUN + 1):
                b = min(j, a + PASSAGE)
                sums = list(accumulate(bounds[a:b], initial=0.0))
                if max(map(sub, sums[RUN:], sums)) < self.threshold:
                    continue
                passage = ws[a:b]
                for k in self.search(set(passage)):
                    if self.items[k][0] not in out:
                        runs = self.runs[k]
                        if any(tuple(passage[x : x + RUN]) in runs for x in range(len(passage) - RUN + 1)):
                            out.add(self.items[k][0])
        return out


_held: dict[str, Index] = {}


def _index(name: str, sent: Broadcast) -> Index:
    """The index of a chunk of items, built once for each worker; it holds one at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = Index(sent.value)
    return _held[name]


def leaked(docs: DataFrame, key: str, column: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``(key, item_key)``: each document and test item with RUN or more consecutive words in common.

    Whole texts of all documents are searched. Items are indexed ITEMS or CHARS at a time, so neither
    the driver nor an index ever holds more; the documents are read once for each such chunk. NULL and empty texts match nothing, nor do items shorter than RUN words;
    repeated documents or items give each pair once. Only the named columns are read.
    """
    kind, ikind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    rows = docs.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(key).alias("k"), F.col(column).alias("t"))
    held = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).distinct()
    sc = docs.sparkSession.sparkContext
    out = None
    chunk: list[tuple[int, str]] = []
    size = 0

    def found(chunk: list[tuple[int, str]]) -> DataFrame:
        sent, name = sc.broadcast(chunk), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(name, sent)
            for pdf in batches:
                hits = [(k, i) for k, t in zip(pdf["k"], pdf["t"], strict=True) for i in sorted(index.leaks(t))]
                if hits:
                    yield pd.DataFrame(hits, columns=["k", "i"])

        return rows.mapInPandas(run, f"k {kind}, i {ikind}")

    for r in held.orderBy("i", "t").toLocalIterator():
        chunk.append((r.i, r.t))
        size += len(r.t)
        if len(chunk) == ITEMS or size >= CHARS:
            out, chunk, size = (out.unionByName(found(chunk)) if out is not None else found(chunk)), [], 0
    if chunk or out is None:
        out = out.unionByName(found(chunk)) if out is not None else found(chunk)
    return out.distinct().select(F.col("k").alias(key), F.col("i").alias(item_key))
