"""Mixing sources to target weights, with soft membership.

A classifier learnt from the labelled rows gives each unlabelled document a posterior over the
domains; a labelled one belongs to its own. Document rates between 0 and the domain's cap are then
fitted by projected gradient steps, so that the expected tokens of every domain come as near, in
least squares, to its share of the budget as the caps allow. Documents of one known domain and cap
have one rate, so they enter the fit as one row of summed tokens; the others keep their own rates in
a table that is written again every few steps. The driver sees one sum per domain and step.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.session import cut, release

#: The vocabulary file of a public byte-level tokenizer; a parameter, the file stays where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FEATURES = 1 << 14
#: Length of a step, and the part of all tokens that no domain may move by in the last one.
STEP, ENOUGH = 0.9, 1e-5
#: Steps after which the rates of uncertain documents are written down.
EVERY = 8


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``tokens``: the number of tokens of the whole text; 0 for NULL and empty.

    The vocabulary file is the driver's and sent to the executors with the job.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(name))  # read once for each worker
        for pdf in batches:
            yield pdf.assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]])

    return docs.mapInPandas(run, schema)


def posteriors(labelled: DataFrame, others: DataFrame, text: str, label: str) -> DataFrame:
    """``others`` with ``p``: the posterior over the labels 0, 1, ... by their words and scripts.

    Multinomial Bayes over hashed words, its counts summed over all labelled rows; the model has
    FEATURES numbers for each label whatever the corpus.
    """
    words = RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"[^\p{L}\p{Nd}]+|(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])", minTokenLength=1)
    tf = HashingTF(inputCol="__w", outputCol="__f", numFeatures=FEATURES)
    prepare = lambda d: tf.transform(words.transform(d.withColumn("__t", F.coalesce(F.col(text), F.lit("")))))
    model = NaiveBayes(featuresCol="__f", labelCol=label, probabilityCol="__p", smoothing=0.1).fit(prepare(labelled))
    out = model.transform(prepare(others))
    return out.select(*[F.col(c) for c in others.columns], vector_to_array("__p").alias("p"))


def rates(p: Column, cap: Column, gradients: list[list[float]], start: Column) -> Column:
    """A document's rate after the projected steps along the gradients, from ``start``."""
    clip = lambda r: F.greatest(F.lit(0.0), F.least(r, cap))
    if not gradients:
        return clip(start)
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients])
    return F.aggregate(steps, clip(start), lambda r, g: clip(r - dot(g)))


def fit_rates(sure: dict[tuple[int, int], int], soft: DataFrame, target: list[float]) -> tuple[dict[tuple[int, int], float], DataFrame]:
    """The rates that bring the domains' expected tokens nearest to ``target``.

    ``sure`` is {(domain, cap): tokens}; its rates come back under the same keys. ``soft`` is
    ``(k, tokens, p, cap)`` and comes back with ``rate``. Steps are scaled by each domain's tokens, so
    that one step settles a domain of certain members and none makes the fit worse; they go on until
    no domain moves by more than ENOUGH of the whole.
    """
    n = len(target)
    sums = lambda c: [F.sum(F.col("tokens") * c * F.col("p")[i]) for i in range(n)]
    add = lambda rows, by: [float(x or 0.0) + sum(t * by(key) for key, t in sure.items() if key[0] == i) for i, x in enumerate(rows)]
    held = add(soft.agg(*sums(F.lit(1.0))).first(), lambda key: 1.0)
    whole = max(sum(target), 1.0)
    fixed = {key: float(min(1, max(key[1], 0))) for key in sure}
    state, own, gradients, last = soft.withColumn("rate", F.lit(1.0)), None, [], None
    while True:
        rate = rates(F.col("p"), F.col("cap").cast("double"), gradients, F.col("rate"))
        got = add(state.agg(*sums(rate)).first(), fixed.__getitem__)
        if last is not None and max(abs(a - b) for a, b in zip(got, last, strict=True)) <= ENOUGH * whole:
            return fixed, state.withColumn("rate", rate)
        step = [STEP * (got[i] - target[i]) / held[i] if held[i] > 0 else 0.0 for i in range(n)]
        fixed = {(i, cap): max(0.0, min(r - step[i], float(cap))) for (i, cap), r in fixed.items()}
        gradients.append(step)
        if len(gradients) == EVERY:
            written = cut(state.withColumn("rate", rates(F.col("p"), F.col("cap").cast("double"), gradients, F.col("rate"))))
            if own is not None:
                release(own)
            state = own = written
            gradients = []
        last = got


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, source, domain, tokens, rate, copies)``: how often each document occurs in the mix.

    The budget is all tokens of the documents; each domain is to hold ``target_share`` of it, and no
    document occurs more than ``max_repeats`` times. What a capped domain lacks is not handed to the
    others: that would bring every share further from its target. ``copies`` is the rate rounded up
    or down by a hash of the key, right on average. Documents without a listed source have the
    domain of the largest posterior. Rows are taken as they are; NULL and empty texts have no tokens
    and one copy at most; without any labelled row unlabelled ones share all domains alike; empty
    ``docs`` give an empty result. The targets are a list of domains and held by the driver.
    """
    listed = [(r[0], float(r[1]), int(r[2])) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").collect()]
    k = len(listed)
    place = F.create_map(*[F.lit(x) for i, (s, _, _) in enumerate(listed) for x in (s, i)]) if k else F.lit(None).cast("map<string,int>")
    cols = [F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")]
    d = cut(token_counts(docs.select(*cols), "k", "t", vocabulary).withColumn("y", place[F.col("s")]))
    labelled, others = d.where("y is not null"), d.where("y is null")
    seen = [r.y for r in labelled.select("y").distinct().collect()]
    if len(seen) > 1:
        order = sorted(seen)
        dense = F.create_map(*[F.lit(x) for j, y in enumerate(order) for x in (y, float(j))])
        guess = posteriors(labelled.select("t", dense[F.col("y")].alias("label")), others.select("k", "t", "s", "tokens"), "t", "label")
        spread = F.array(*[F.col("p")[order.index(i)] if i in order else F.lit(0.0) for i in range(k)])
    else:
        guess = others
        spread = F.array(*[F.lit(1.0 if i in seen else 0.0 if seen else 1.0 / max(k, 1)) for i in range(k)])
    soft = guess.select("k", "s", "tokens", spread.alias("p"))
    soft = soft.withColumn("y", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    caps = F.array(*[F.lit(m) for _, _, m in listed]) if k else F.array(F.lit(1))
    cap = F.when(F.col("tokens") > 0, F.get(caps, F.col("y"))).otherwise(F.lit(1)).alias("cap")
    sure = labelled.select("k", "s", "tokens", "y", cap)
    soft = cut(soft.select("k", "s", "tokens", "p", "y", cap))
    # a row for each domain and cap
    of = {(r.y, r.cap): r.tokens for r in sure.groupBy("y", "cap").agg(F.sum("tokens").alias("tokens")).collect()}
    whole = sum(of.values()) + (soft.agg(F.sum("tokens")).first()[0] or 0)
    fixed, soft = fit_rates(of, soft, [t * whole for _, t, _ in listed]) if k else ({}, soft.withColumn("rate", F.lit(1.0)))
    rate_of = F.create_map(*[F.lit(x) for (y, c), r in sorted(fixed.items()) for x in (f"{y}/{c}", r)]) if fixed else F.lit(None).cast("map<string,double>")
    sure = sure.withColumn("rate", rate_of[F.concat_ws("/", "y", "cap")])
    every = sure.unionByName(soft.drop("p")).withColumn("rate", F.round("rate", 9))
    chance = F.pmod(F.xxhash64(F.col("k"), F.lit("mix")), F.lit(1_000_000)) / 1_000_000.0
    names = F.array(*[F.lit(s) for s, _, _ in listed]) if k else F.array(F.lit(None).cast("string"))
    return every.select(
        F.col("k").alias(key), F.col("s").alias("source"), F.get(names, F.col("y")).alias("domain"), "tokens", "rate",
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"),
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, tokens, mixed_tokens, share_of_all, actual_share, largest_copies)``.

    One row per domain; ``share_of_all`` is its mixed tokens in all tokens of the documents, the
    share that was fitted, ``actual_share`` in all mixed tokens. A domain without documents has 0.
    """
    got = mixed.groupBy(F.col("domain").alias("source")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("largest_copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("whole"), F.sum("tokens").alias("every"))
    return (
        targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left").crossJoin(F.broadcast(whole))
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("every")), F.lit(0.0)).alias("share_of_all"), F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("whole")), F.lit(0.0)).alias("actual_share"), F.coalesce("largest_copies", F.lit(0)).alias("largest_copies"))
    )
