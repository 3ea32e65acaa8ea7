"""Every operator that runs Python over batches, on tables with empty partitions and none without."""

import pytest
from pyspark.sql import functions as F

from quaverlake.llm.canon import match_composers, match_works
from quaverlake.llm.leaks import leaked
from quaverlake.llm.lookalikes import count_lookalikes, disguised, rewritten
from quaverlake.llm.sentences import split_sentences
from quaverlake.llm.triejoin import near_words
from quaverlake.llm.variants import name_entities


@pytest.fixture(params=[0, 1])
def few(request, spark):
    """A table of no or one row over six partitions, most of them empty."""

    def make(row, schema):
        return spark.createDataFrame([row] * request.param, schema).repartition(6)

    make.rows = request.param
    return make


def test_lookalikes(few):
    t = few(("a", "Ηello wоrld"), "id string, title string")
    assert disguised(t, "id", ("title",)).count() == few.rows
    counts = count_lookalikes(t, "title")
    assert bool(counts) == bool(few.rows)
    assert rewritten(t, "title", counts).count() == few.rows


@pytest.mark.parametrize("key", ["q1", 1])
def test_leaks(few, spark, key):
    kind = "string" if key == "q1" else "bigint"
    items = spark.createDataFrame([(key, "one two three four five six seven eight nine ten eleven")], f"i {kind}, t string")
    docs = few((7, "say one two three four five six seven eight nine ten now"), "d bigint, t string")
    assert leaked(docs, "d", "t", items, "i", "t").count() == few.rows
    assert leaked(docs.withColumn("t", F.lit("no such words")), "d", "t", items, "i", "t").count() == 0


def test_names(few):
    assert name_entities(few(("performer", "Mara Quell", 1), "field string, name string, w long")).count() == few.rows
    assert near_words(few(("marble",), "w string"), "w").count() == 0


def test_lists(few, spark):
    refs = spark.createDataFrame([("c1", "Quell, Mara")], "ref_id string, name string")
    assert match_composers(few(("M. Quell", 1), "text string, n long"), refs).count() == few.rows
    works = spark.createDataFrame([("w1", "c1", "Sonata No. 3", "Op. 4")], "ref_id string, owner string, title string, catalog string")
    assert match_works(few(("c1", "Sonata 3"), "owner string, text string"), works).count() == few.rows


def test_sentences(few):
    assert split_sentences(few((1, "One. Two."), "d bigint, t string"), "d", "t").count() == 2 * few.rows
