"""Enrichment with stub models."""

from pyspark.sql import functions as F

from quaverlake.operators import enrich as E

COLS = "id string, title string, work string, movement string, composer string, performer string, album string, source string, composer_canonical string, work_title string, catalog string, movement_index int, movement_title string, composer_corrected boolean, enriched_at bigint"


def tracks(spark):
    rows = [("1", "Sonata", None, "", "Bel", None, None, "s"), ("2", "March", None, None, "Dorn", None, None, "s"), ("3", None, None, None, None, None, None, "s")]
    return spark.createDataFrame([r + (None,) * 7 for r in rows], COLS)


def test_prompt_and_answers(spark):
    def bulk(prompts):
        return ['Sure: ```json {"composer_canonical":"Ann Bell","work_title":"Sonata No. 1","composer_corrected":true,"confidence":0.7}```' if "Sonata" in p else '{"composer_canonical":"Cy Dorn","composer_corrected":false,"confidence":0.9}' if "March" in p else "no idea" for p in prompts]

    def better(prompts):
        return ['{"composer_canonical":"Anna Bell","work_title":"Sonata No. 1","composer_corrected":true,"confidence":0.95}' if "Sonata" in p else "broken" for p in prompts]

    t = tracks(spark).withColumn("source_item", F.lit(None).cast("string"))
    lead = "Source-provided composer (may be wrong): "
    assert {r.p for r in t.withColumn("source_item", F.when(F.col("id") == "1", "x")).select(E.prompt().alias("p")).collect()} == {f"Title: Sonata\n{lead}Bel\nSource item: x\nSource: s\n", f"Title: March\n{lead}Dorn\nSource: s\n", "Title: \nSource: s\n"}
    one = {r.id: r.a for r in E.enrich(t, bulk).collect()}
    assert one["1"].composer_canonical == "Ann Bell" and one["3"] is None or one["3"].confidence is None
    two = E.enrich(t, bulk, better)
    got = {r.id: r for r in E.apply(t, two).collect()}
    assert (got["1"].composer, got["1"].work_title) == ("Anna Bell", "Sonata No. 1")
    assert (got["2"].composer, got["2"].composer_canonical) == ("Dorn", "Cy Dorn")
    assert got["3"].composer is None
    assert E.apply(t, two.limit(0)).exceptAll(t).count() == 0


def test_first_answer_stays_where_the_better_model_fails(spark):
    def bulk(prompts):
        return ['{"composer_canonical":"Ann Bell","composer_corrected":false,"confidence":0.3}' for _ in prompts]

    def better(prompts):
        raise RuntimeError("no answer")

    t = tracks(spark).withColumn("source_item", F.lit(""))
    assert [r.a.confidence for r in E.enrich(t, bulk, better).collect()] == [0.3] * 3


def test_relink(spark):
    t = tracks(spark).withColumn("composer_canonical", F.lit("Ann Bell")).withColumn("work_title", F.lit("Sonata")).withColumn("enriched_at", F.when(F.col("id") == "1", 5).cast("bigint"))
    got = {r.id: r.work_id for r in E.relink(t).collect()}
    assert got["1"] is not None and got["2"] is None
