"""Pieces: the model's own segmentation without dropout, exact round trips with it."""

from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlens.llm import pieces
from meterlens.llm.common import table
from tests.llm.helpers import empty_documents, odd_documents

SERIALIZED = Path(pieces.PieceParams().model).read_bytes()
PLAIN = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=0.0))
DROPPED = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=0.3))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=SERIALIZED)
TEXT = st.text(st.sampled_from("abe  tnr\n\té中😀.!<>0xA"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_no_dropout_is_the_models_own_segmentation(text):
    assert PLAIN.encode(text, 1).tolist() == LIBRARY.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(0, 2**64 - 1))
def test_round_trip(text, document):
    text = text.encode("utf-8", "ignore").decode()
    assert DROPPED.decode(DROPPED.encode(text, document)) == text
    assert DROPPED.encode(text, document).tolist() == DROPPED.encode(text, document).tolist()


def test_merging_many_equals_merging_one(spark):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()]
    DROPPED.encode_many(texts, list(range(40)))
    for variant, kept in enumerate(DROPPED.tables):
        for unit in list(kept)[:400]:
            assert kept[unit] == DROPPED.segment(unit, variant)


@pytest.mark.parametrize("dropout", [0.1, 0.3])
def test_every_occurrence_equals_its_own_agenda(spark, dropout):
    """Whole texts, with outcomes kept and used again, against the agenda of every unit with its draw."""
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r["text"]]
    texts += ["the same line again and again " * 300, "a" * 200 + " " + "éé中 " * 50]
    model = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=dropout))
    found = model.encode_many(texts, list(range(len(texts))))
    assert len(model.outcomes) > 100
    again = model.encode_many(texts, list(range(len(texts))))
    for d, (text, ids, same) in enumerate(zip(texts, found, again)):
        draws = [pieces.mixed(k ^ pieces.mixed(d ^ model.params.seed)) for k in range(len(text))]
        want = b"".join(model.segment(u, draws[k]) for k, u in enumerate(pieces.UNITS.findall(" " + text)))
        assert ids.astype("<i4").tobytes() == want and np.array_equal(ids, same) and model.decode(ids) == text


def test_dropout_varies_by_place_and_seed():
    text = "the other thing " * 50
    plain, dropped = PLAIN.encode(text, 1), DROPPED.encode(text, 1)
    assert len(dropped) > len(plain) and not np.array_equal(dropped, DROPPED.encode(text, 2))
    other = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=0.3, seed=18))
    assert not np.array_equal(dropped, other.encode(text, 1))


def test_all_skipped_leaves_characters():
    model = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=1.0))
    assert [LIBRARY.id_to_piece(i) for i in model.encode("the a", 1).tolist()] == list("▁the▁a")


def test_table_and_defined_cases(spark):
    docs = odd_documents(spark)
    rows = pieces.encode_texts(docs)
    assert set(rows.columns) == set(docs.columns) | {"ids", "n_tokens", "restored"}
    found = rows.collect()
    assert len(found) == 13 and all(r["restored"] for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[900]["ids"] is None and by_id[900]["n_tokens"] == 0 and by_id[901]["ids"] == []
    assert all(len(r["ids"] or []) == r["n_tokens"] for r in found)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(rows).collect()}
    assert back == {r["doc_id"]: r["text"] for r in found}
    assert pieces.encode_texts(empty_documents(spark)).count() == 0


def test_a_model_without_byte_pieces_is_refused():
    class Bare:
        def __init__(self, model_proto):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a"

        def get_score(self, i):
            return 0.0

        def is_byte(self, i):
            return False

        is_control = is_unknown = is_byte

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sentencepiece, "SentencePieceProcessor", Bare)
        with pytest.raises(ValueError):
            pieces.PieceModel(b"", pieces.PieceParams())


def test_every_occurrence_decides_for_itself():
    # A frequent unit of several merges has far more than a few segmentations, each that of its own draw.
    model = pieces.PieceModel(SERIALIZED, pieces.PieceParams())
    found = [model.encode("information", d).tobytes() for d in range(4000)]
    draws = [pieces.mixed(pieces.mixed(d ^ model.params.seed)) for d in range(4000)]
    assert len(set(found)) > 8
    assert found == [model.segment(" information", d) for d in draws]
    merges = model.places[" information"]
    skipped = np.array([[pieces.mixed(d ^ int(m)) < model.limit for m in merges] for d in draws])
    assert abs(skipped.mean() - 0.1) < 0.01 and abs(skipped.any(axis=1).mean() - (1 - 0.9 ** len(merges))) < 0.03
    units = [" information"] * 200 + [" é中information"] * 200
    assert model.segment_many(units, np.array(draws[:400], np.uint64))[0] == [model.segment(u, d) for u, d in zip(units, draws)]


def test_units_are_learnt_by_the_library(monkeypatch):
    # Ids and places of merges as by the agenda, without this module merging a unit itself.
    model = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=0.0))
    monkeypatch.setattr(model, "_merge", None)
    text = f"the information  in\n\nbetween: éé中😀 \x00 {pieces.BLANK}a{pieces.BLANK} internationalisation's   \n end{'a' * 90}"
    assert model.decode(model.encode(text, 1)) == text
    for unit in dict.fromkeys(pieces.UNITS.findall(" " + text)):
        places = []
        assert model.tables[0][unit] == model.segment(unit, 0, places)
        assert sorted(model.places[unit].tolist()) == sorted(places)


def test_restored_says_whether_ids_decode_to_their_text():
    ids = [PLAIN.encode(t, 1) for t in ("the é中", "", "a b")]
    assert PLAIN.restores([*ids, ids[1]], ["the é中", "", "a c", None]) == [True, True, False, True]


def test_units_of_several_batches_are_learnt_once_and_in_short_texts(monkeypatch):
    # The library's agenda is slower for long texts; what is rare makes room, not the words of every batch.
    model, sent = pieces.PieceModel(SERIALIZED, pieces.PieceParams(dropout=0.3, kept=700)), []

    class Recorded:
        @staticmethod
        def encode(text):
            sent.append(text)
            return LIBRARY.encode(text)

    monkeypatch.setattr(model, "library", Recorded)
    often = "".join(f" word{i}" for i in range(300))
    for d in range(8):
        text = "".join(f" rare{d}of{i}" for i in range(300)) + often
        draws = [pieces.mixed(k ^ pieces.mixed(d ^ model.params.seed)) for k in range(601)]
        want = b"".join(model.segment(u, draws[k]) for k, u in enumerate(pieces.UNITS.findall(" " + text)))
        assert model.encode(text, d).astype("<i4").tobytes() == want
        assert len(model.names) == len(model.number) == len(model.ids) <= 1300
    learnt = [unit for text in sent for unit in text.split("\n")]
    assert learnt.count(" word7") == 1 and learnt.count(" rare3of7") == 1
    assert max(text.count("\n") for text in sent) <= pieces.LINES
    model.encode(often + "".join(f" new{i}" for i in range(900)), 1)
    model.encode("a", 1)
    assert len(model.names) <= 351 and " word7" in model.number


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeinrst é中"), min_size=1, max_size=45), min_size=1, max_size=30), st.integers(1, 2**64 - 1))
def test_units_of_all_lengths_are_merged_together_as_one_by_one(units, seed):
    units = [u.lstrip(" ").replace(" ", "") or " " for u in units]
    draws = [pieces.mixed(seed ^ k) or 1 for k in range(len(units))]
    assert DROPPED.segment_many(units, np.array(draws, np.uint64))[0] == [DROPPED.segment(u, d) for u, d in zip(units, draws)]
    places: list[list[int]] = [[] for _ in units]
    assert DROPPED.segment_many(units, None)[0] == [DROPPED.segment(u, 0, p) for u, p in zip(units, places)]
    assert [p.tolist() for p in DROPPED.segment_many(units, None)[1]] == places
    # Every second merge of its own skipped.
    skips = np.full((len(units), max(map(len, places)) + 1), pieces.MASK, np.uint64)
    for row, own in zip(skips, places):
        row[:len(own[::2])] = own[::2]
    besides: list[list[int]] = [[] for _ in units]
    ids, merged = DROPPED.segment_many(units, None, skips)
    assert ids == [DROPPED.segment(u, 0, p, set(own[::2])) for u, p, own in zip(units, besides, places)]
    assert [p.tolist() for p in merged] == besides
