"""Enrichment by a language model behind a plain callable: prompts, answers, and their application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions.text import blank_to_null, first_json_object, work_id

ANSWER = "composer_canonical string, work_title string, catalog string, movement_index int, movement_title string, composer_corrected boolean, composer_correction_reason string, confidence double"
#: Answers below this confidence, or below the second if they correct the composer, are asked again.
DOUBTFUL, DOUBTFUL_CORRECTION = 0.55, 0.75


def prompt() -> Column:
    """The lines that describe a track; title and source always, what else is missing has no line."""
    some = lambda label, c: F.when(blank_to_null(F.col(c)).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c), F.lit("\n")))
    always = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\n"))
    return F.concat_ws("", always("Title", "title"), some("Source-provided composer (may be wrong)", "composer"), some("Performer", "performer"), some("Album", "album"), some("Source item", "source_item"), always("Source", "source"))


def parse_answer(c: Column) -> Column:
    """The struct of the outermost JSON object in an answer; NULL fields if it has none."""
    return F.from_json(first_json_object(c), ANSWER)


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str]], forgiving: bool = False) -> DataFrame:
    """``(id, answer)`` of ``(id, prompt)``, a batch per call of the model.

    With ``forgiving`` a batch whose call raises has no answers instead of failing the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = model(list(pdf["prompt"]))
            except Exception:
                if not forgiving:
                    raise
                continue
            yield pd.DataFrame({"id": pdf["id"], "answer": answers})

    return prompts.select("id", "prompt").mapInPandas(run, "id string, answer string")


def doubtful(a: Column) -> Column:
    """Whether an answer is to be asked again of a better model."""
    sure = F.coalesce(a["confidence"], F.lit(0.0))
    return (sure < DOUBTFUL) | (F.coalesce(a["composer_corrected"], F.lit(False)) & (sure < DOUBTFUL_CORRECTION))


def enrich(tracks: DataFrame, bulk: Callable[[list[str]], list[str]], better: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``(id, answer struct)``; doubtful answers are replaced by the better model's if it gives one.

    Where the better model fails the first answer stays."""
    asked = tracks.select("id", prompt().alias("prompt"))
    first = ask(asked, bulk).select("id", parse_answer(F.col("answer")).alias("a"))
    if better is None:
        return first
    again = ask(asked.join(first.where(doubtful(F.col("a"))).select("id"), "id", "left_semi"), better, forgiving=True).select("id", parse_answer(F.col("answer")).alias("b"))
    return first.join(again, "id", "left").select("id", F.when(F.col("b.confidence").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("a"))


def apply(tracks: DataFrame, answers: DataFrame) -> DataFrame:
    """Tracks with their answers' fields; the composer is overwritten only by a correction."""
    fields = [f.split()[0] for f in ANSWER.split(", ")]
    a = answers.select("id", F.col("a").alias("__a"))
    new = tracks.join(a, "id", "left")
    given = F.col("__a").isNotNull()
    out = {c: F.when(given, F.col(f"__a.{c}")).otherwise(F.col(c)) for c in fields if c in tracks.columns}
    out["composer"] = F.when(F.coalesce(F.col("__a.composer_corrected"), F.lit(False)) & blank_to_null(F.col("__a.composer_canonical")).isNotNull(), F.col("__a.composer_canonical")).otherwise(F.col("composer"))
    return new.select(*[out.get(c, F.col(c)).alias(c) for c in tracks.columns])


def relink(tracks: DataFrame) -> DataFrame:
    """``(id, work_id)``: the work each enriched track belongs to, NULL for all others."""
    w = work_id(F.col("composer_canonical"), F.col("work_title"), F.col("catalog"))
    return tracks.select("id", F.when(F.col("enriched_at").isNotNull(), w).alias("work_id"))
