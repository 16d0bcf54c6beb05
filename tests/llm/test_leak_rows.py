"""Leaks are taken out by row, not by id."""

from meterlens.llm.templates import drop_leaks
from tests.llm.helpers import documents

ITEM = "A farmer called Anna has 12 apples and gives 5 of them to Ben before the long walk home to the village. How many are left?"
CLEAN = ["Nothing of the kind is written here, only a few plain words.", "Another plain text, which is not part of any benchmark."]


def kept(spark, rows):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = documents(spark, rows)
    out = drop_leaks(docs, items)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_texts_without_an_id_stay_unless_they_leak(spark):
    rows = [(None, ITEM), (None, CLEAN[0]), (None, CLEAN[1]), (1, CLEAN[0])]
    assert kept(spark, rows) == sorted(rows[1:], key=repr)


def test_other_texts_of_an_id_stay(spark):
    rows = [(7, f"{CLEAN[0]} {ITEM}"), (7, CLEAN[1]), (7, CLEAN[1]), (7, None), (8, ""), (9, ITEM)]
    assert kept(spark, rows) == sorted(rows[1:5], key=repr)
