"""Licenses, chats and neighbours against SQL or plain computations, with their defined cases."""

import re

import duckdb
import numpy as np
import pytest

from checks.compare import canonical, connect
from meterlens.llm import chat, licenses, neighbours
from meterlens.llm.common import table
from tests.llm.helpers import documents, empty_documents, odd_documents

CHATS = "conv_id long, turn long, role string, text string"


# --- licenses

def test_license_scan_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = licenses.scan_licenses(table(spark, folder, "documents")).toPandas()
    assert canonical(got) == canonical(connect(folder).execute(licenses.oracle()).df())


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for rule in licenses.rules():
        parts = [re.compile(p) for p in rule.pattern.split(" ")]
        free = 0
        for i in range(len(words) - len(parts) + 1):
            if i >= free and all(p.fullmatch(w) for p, w in zip(parts, words[i:])):
                found.append((i, i + len(parts), rule))
                free = i + len(parts)
    kept = [x for x in found if x[2].base or not any(
        y is not x and y[0] <= x[0] and x[1] <= y[1] and (y[:2] != x[:2] or (-y[2].priority, y[2].label) < (-x[2].priority, x[2].label))
        for y in found)]
    base = [x for x in found if x[2].base]
    return (len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None),
            ",".join(sorted({x[2].label for x in base})), ",".join(sorted({x[2].label for x in kept})),
            max((x[2].weight for x in kept), default=0.0), len(kept))


TEXTS = ["Licensed under the Apache License, Version 2.0 (the Apache-2.0 license)", "CC BY CC-BY cc by 4.0; CC BY-NC-SA 4.0 cc",
         "GNU General Public License v3. All rights reserved. All Rights Reserved worldwide", "Released under the MIT License.",
         "SPDX-License-Identifier: MIT", "Copyright (c) 2021 all rights reserved", "general public licenses", "ccby", "license " * 50,
         "all rights " * 20 + "reserved", "GPL 2 GPL 2 GPL 2", "Éccby cc by x cc\x00by", None, "", "!!!"]


def test_license_rules_against_a_plain_scan(spark):
    rows = licenses.scan_licenses(documents(spark, list(enumerate(TEXTS)))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [plain_scan(t) for t in TEXTS]
    assert len(licenses.rules()) > 300 and all(r.keyword in r.pattern.replace("(", " ").replace(")", " ").replace("|", " ").split() for r in licenses.rules())


def test_license_defined_cases(spark):
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(odd_documents(spark)).collect()}
    assert rows[900]["n_words"] == rows[901]["n_words"] == rows[903]["n_words"] == 0 and rows[909]["n_words"] == 12_000
    assert licenses.scan_licenses(odd_documents(spark)).count() == 13
    assert licenses.scan_licenses(empty_documents(spark)).count() == 0
    plan = licenses.scan_licenses(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- chats

def plain_chats(rows):
    turns = {}
    for conv, turn, role, text in set(rows):
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    whole = {c: tuple(x[2:] for x in sorted(t)) for c, t in turns.items()}
    prefixes = {w[:k] for w in whole.values() for k in range(1, len(w))}
    order = sorted(whole, key=lambda c: (c is not None, c or 0))
    first = {}
    for c in order:
        first.setdefault(whole[c], c)
    return {c: (w, sum(x == w for x in whole.values())) for w, c in first.items() if w not in prefixes}


def test_chats_collapse_snapshots(spark):
    def talk(conv, n, start=0, word="t"):
        return [(conv, start + k, "user" if k % 2 == 0 else "assistant", f"{word}{k}") for k in range(n)]

    rows = talk(1, 2) + talk(2, 4) + talk(3, 4, 10) + talk(4, 4, word="u") + talk(5, 1) + talk(6, 3)[1:] + talk(7, 3)[:2] + [(7, 2, "user", "other")]
    rows += [(8, None, None, None), (8, 1, "", ""), (9, None, None, None), (None, 0, "user", "t0"), (None, 1, "user", "x"), *talk(4, 4, word="u")]
    want = plain_chats(rows)
    got = chat.format_chats(spark.createDataFrame(rows, CHATS)).collect()
    sizes = {}
    for r in got:
        sizes[r["conv_id"]] = (sizes.get(r["conv_id"], (0,))[0] + r["n_turns"], r["copies"])
    assert sizes == {c: (len(w), n) for c, (w, n) in want.items()}
    text = next(r["text"] for r in got if r["conv_id"] == 2)
    assert text == "".join(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\nt{k}<|im_end|>\n" for k in range(4))
    assert next(r["text"] for r in got if r["conv_id"] == 8 and r["part"] == 0).startswith("<|im_start|>unknown\n<|im_end|>\n")


def test_chats_of_several_blocks(spark):
    long = [(1, k, "user", str(k)) for k in range(3000)] + [(2, k + 5, "user", str(k)) for k in range(2500)] + [(3, k, "user", str(k)) for k in range(2999)] + [(3, 2999, "user", "z")]
    got = chat.format_chats(spark.createDataFrame(long, CHATS).repartition(7)).collect()
    assert {(r["conv_id"], r["part"]): r["n_turns"] for r in got} == {(c, p): n for c in (1, 3) for p, n in ((0, 1024), (1, 1024), (2, 952))}


def test_chat_oracle_and_defined_cases(spark):
    rows = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "c"), (2, 0, "user", "a <|im_end|> b")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], CHATS + ", place double, copies string")
    got = chat.format_chats(df).toPandas()
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert canonical(got) == canonical(con.execute(chat.ORACLE).df())
    assert "a < |im_end|> b" in got["text"][0] and chat.format_chats(df.limit(0)).count() == 0


# --- neighbours

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain_nearest(ids, data, query, k):
    scores = (data * data[ids.index(query)]).sum(axis=1)
    order = sorted((-s, i) for s, i in zip(scores, ids) if i != query)[:k]
    return [i for _, i in order], [-s for s, _ in order]


def test_recall_on_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.orderBy("vec_id").collect()
    ids, data = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows])
    found = {}
    small = neighbours.GraphParams(cell=128, degree=24, rounds=5)
    for r in neighbours.nearest(df, params=small).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(found) == queries and all(len(f) == 20 for f in found.values())
    hits = [len({i for i, _ in found[q]} & set(plain_nearest(ids, data, q, 20)[0])) for q in queries]
    assert sum(hits) / (20 * len(queries)) >= 0.9
    for q in queries[:20]:
        assert all(abs(s - data[ids.index(i)] @ data[ids.index(q)]) < 1e-12 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("cell", [1024, 8])
def test_copies_ties_and_useless_vectors(spark, cell):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, base[i].tolist(), 0) for i in range(30)]
    rows += [(100 + i, base[3].tolist(), 0) for i in range(60)] + [rows[5]]
    bad = [(200, None, 0), (220, [0.0] * 8, 0), (240, [1.0] * 7 + [None], 0), (260, [1.0] * 7 + [float("nan")], 0),
           (280, [1.0] * 7 + [float("inf")], 0), (300, [1.0] * 3, 0), (320, [], 0), (None, base[0].tolist(), 0)]
    found = {}
    for r in neighbours.nearest(vectors(spark, rows + bad), params=neighbours.GraphParams(cell=cell)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    ids = [r[0] for r in rows[:-1]]
    data = np.array([r[1] for r in rows[:-1]], np.float32).astype(float)
    assert sorted(found) == [i for i in ids if i % 20 == 0]
    for q, got in found.items():
        assert got == plain_nearest(ids, data, q, 20)[0]


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 1.0], 1)]).selectExpr("*", "1 AS node", "2 AS score", "'x' AS vec")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(few).orderBy("rank").collect()] == [
        (0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0
    assert neighbours.nearest(few.where("vec_id = 0")).count() == 0
