"""One id, or one conversation without turn numbers, that holds a third of all rows."""

from meterlens.llm import chat, language
from tests.llm.helpers import documents
from tests.llm.test_scans import CHATS, plain_chats


def test_conversations_without_numbers_are_cut_like_others(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rows = [(1, None, "user", f"said {k:04}") for k in range(300)] + [(2, 5, "user", f"said {k:04}") for k in range(100)]
    rows += [(3, k, "user", f"said {k:04}") for k in range(300)] + [(None, None, "a", f"x{k}") for k in range(40)]
    df = spark.createDataFrame(rows, CHATS).repartition(5)
    placed = chat.placed_turns(df)
    sizes = {r["count"] for r in placed.groupBy("conv_id", "block").count().collect()}
    assert max(sizes) == 16
    got = chat.format_chats(df).collect()
    turns = {}
    for r in got:
        n, copies = turns.get(r["conv_id"], (0, 0))
        turns[r["conv_id"]] = n + r["n_turns"], max(copies, r["copies"])
    assert turns == {c: (len(w), n) for c, (w, n) in plain_chats(rows).items()}
    parts = sorted((r["part"], r["text"]) for r in got if r["conv_id"] == 1)
    whole = "".join(t for _, t in parts)
    assert [p for p, _ in parts] == list(range(19)) and whole.count("<|im_start|>") == 300
    assert whole.index("said 0000") < whole.index("said 0150") < whole.index("said 0299")


def test_language_takes_one_text_of_an_id(spark):
    rows = [(7, f"copy number {k} of many under one id") for k in range(300)] + [(k, f"a plain text of its own {k}") for k in range(100, 160)]
    docs = documents(spark, rows, extra=False)
    windows, labels, names = language.training_windows(docs, language.LanguageParams())
    ids = {r[0] for r in rows if r[0] == 7 or r[0] >= 100}
    assert names == ["en"] and len(windows) == len(labels) <= language.LanguageParams().excerpts * len(ids)
