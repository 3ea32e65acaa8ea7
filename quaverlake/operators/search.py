"""Full-text search: an inverted index of distinct keywords, prefix terms, BM25."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.session import cut

K1, B, FLOOR = 1.2, 0.75, 1e-6


class Built(NamedTuple):
    """An index written down: postings sorted by term, the number of documents and their mean length."""

    postings: DataFrame
    n_docs: int
    mean: float


def index(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """``(key, term, dl)``: one posting for each distinct keyword, with the document's length.

    The length rides on each posting, so scoring needs no join.
    """
    w = docs.select(key, words.alias("w")).withColumn("dl", F.size("w"))
    return w.select(key, F.explode("w").alias("term"), "dl")


def built(postings: DataFrame, key: str) -> Built:
    """Writes an index sorted by term, so that a search reads only the row groups of its prefixes, and
    takes its two statistics once."""
    p = cut(postings.repartitionByRange("term").sortWithinPartitions("term"))
    # each document counts once: every posting of it stands for one part in dl
    n, mean = p.agg(F.countDistinct(key), F.count("*")).first()
    return Built(p, n or 0, (mean or 0) / n if n else 0.0)


def search(postings: DataFrame | Built, key: str, prefixes: list[str], limit: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """``(key, score)`` of the documents that have every prefix, best first.

    Document count and mean length are of the whole index, ``live`` then narrows the hits. The prefixes
    are pushed to the scan of the postings; a plain table of postings is written down first.
    """
    prefixes = list(dict.fromkeys(prefixes))
    ix = postings if isinstance(postings, Built) else built(postings, key)
    begins = [F.col("term").startswith(p) for p in prefixes]
    hit = F.filter(F.array(*[F.when(b, F.lit(i)) for i, b in enumerate(begins)]), lambda x: x.isNotNull())
    hits = ix.postings.where(reduce(or_, begins)).select(key, "dl", F.explode(hit).alias("q")).groupBy(key, "q").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))
    df = F.broadcast(hits.groupBy("q").agg(F.count("*").alias("df")))  # a row for each term of the query
    raw = F.log((F.lit(float(ix.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, FLOOR).otherwise(raw)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(ix.mean or 1.0)))
    scored = hits.join(df, "q").groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("terms")).where(F.col("terms") == len(prefixes))
    out = scored.select(key, "score")
    if live is not None:
        out = out.join(live.select(key), key, "left_semi")
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)
