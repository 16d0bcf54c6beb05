"""The pipeline against its stages in plain Python, and its registration."""

import importlib.util

import pytest

import __spark_entry__ as entry
from meterlens.llm import toxicity
from meterlens.llm.common import table
from meterlens.session import settle
from tests.llm import test_duplicates as plain
from tests.llm.helpers import odd_documents

FOLDER = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") is None else __import__("corpus_pipeline")


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and {"op3_chat_snapshots", "op6_license_scan"} <= set(entry.oracle_sql())


def test_run_equals_plain_stages(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    found = pipeline.run(spark, FOLDER).collect()
    # Which texts are toxic is the operator's own judgement; what becomes of the rest is computed here.
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    groups = plain.plain_components({i: plain.plain_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    seen, cut = set(), {}
    for i in sorted(rows):
        data = rows[i].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        cut[i] = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    want = {i: t for i, t in cut.items() if not any(x in t for x in items)}
    got = {r["doc_id"]: r["text"] for r in found}
    assert got == want and all(r["restored"] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert 0 < len(got) < docs.count()


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in pipeline.STAGES:
        after = settle(stage(spark, docs, FOLDER))
        if name != "pieces":
            assert after.columns == docs.columns
        docs = after
    assert docs.count() > 0 and docs.where("NOT restored").count() == 0
