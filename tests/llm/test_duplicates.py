"""Near-duplicates, repeated passages and benchmark leaks against plain computations."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from meterlens.llm import graph, simhash, suffixes, templates
from meterlens.llm.common import table
from tests.llm.helpers import documents, empty_documents, odd_documents


# --- SimHash

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{id: smallest id reachable}; ids are distinct."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = simhash.near_duplicates(docs).collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    want = plain_components(prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == [
        (i, f"{prints[i]:016x}", want[i]) for i in sorted(prints)]


@pytest.mark.parametrize("meet", [simhash.MEET, 4])
def test_links_of_chains_and_crowds(spark, monkeypatch, meet):
    """Chains of small steps, a crowd around one print and random prints; also with every place cut to pieces."""
    monkeypatch.setattr(simhash, "MEET", meet)
    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for start in prints[:6]:
        at = start
        for _ in range(8):
            for bit in draw.sample(range(64), 3):
                at ^= 1 << bit
            prints.append(at)
    prints += [prints[7] ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(60)]
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    refs = simhash.references()
    rows = []
    for i, p in prints.items():
        distances = [(p ^ (r & (2**64 - 1))).bit_count() for r in refs]
        tables = [int.from_bytes(bytes(d), "little") for d in (distances[:8], distances[8:])]
        rows.append((i, p - (1 << 64) if p >> 63 else p, *tables))
    classes = spark.createDataFrame(rows, "node long, print long, t0 long, t1 long")
    found = {r["node"]: r["component"] for r in graph.components(simhash.links(classes, 3)).collect()}
    assert {i: found.get(i, i) for i in prints} == plain_components(prints)


def test_simhash_defined_cases(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert {by_id[i]["component_id"] for i in (900, 901, 902)} == {900}
    assert by_id[900]["fingerprint"] == "0" * 16 and by_id[907]["component_id"] == 906
    assert by_id[None]["component_id"] is None
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    kept = simhash.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is not None, i)) == [
        None, 900, 903, 904, 905, 906, 908, 909]
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd_documents(spark), distance=4)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 400: 400, 500: 400}
    assert graph.components(edges.limit(0)).count() == 0


# --- repeated passages

def plain_cut(rows, size=100):
    """Digest rows by going through all strings in order; ids are distinct."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            string = data[p:p + size]
            if string in seen:
                gone[p:p + size] = b"\1" * size
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for q, g in enumerate(gone) if g and (q == 0 or not gone[q - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0]))


def awkward(draw):
    parts = ["".join(draw.choice("ab") for _ in range(300)) for _ in range(5)]
    rows = [(i, "".join(draw.choice(parts)[draw.randrange(100):draw.randrange(120, 300)] for _ in range(draw.randrange(5)))) for i in range(40)]
    return rows + [(100, "a" * 5000), (101, "a" * 300), (102, "xyz" * 900), (103, None), (104, ""), (105, "é" * 400),
                   (106, "ab" * 130), (107, "b" * 99), (108, "b" * 100), (109, "b" * 100), (None, "a" * 150)]


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 2])
def test_cuts_of_repetitive_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rows = awkward(random.Random(5))
    assert by_id(suffixes.digest(suffixes.cut_repeats(documents(spark, rows))).collect()) == plain_cut(rows)


def test_cuts_in_small_slices(spark, monkeypatch):
    """Slices, lots and runs of the smallest kind give the same, in the tasks' own code."""
    rows = awkward(random.Random(6))
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    owner = np.repeat(np.arange(len(rows)), [len((t or "").encode()) for _, t in rows])
    whole = suffixes.runs_of(data[:9000], owner[:9000], 100)
    monkeypatch.setattr(suffixes, "LONGEST_RUN", 7)
    cut = suffixes.runs_of(data[:9000], owner[:9000], 100)
    keys = [dict(zip(np.concatenate([np.arange(b, b + n) for b, n in zip(r[0], r[1])]).tolist(), np.repeat(r[2], r[1]).tolist())) for r in (whole, cut)]
    assert keys[0] == keys[1] and cut[1].max() == 7


def test_cuts_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert by_id(suffixes.digest(suffixes.cut_repeats(docs)).collect()) == plain_cut(rows)


def test_longest_previous_factors():
    draw = np.random.default_rng(1)
    data = draw.integers(97, 99, 400).astype(np.uint8)
    position = np.full(400, -1)
    position[:388] = draw.permutation(388)
    got = suffixes.previous_factors(data, position, 12)
    strings = {p: data[p:p + 12].tobytes() for p in range(388)}
    assert got.tolist() == [p < 388 and any(strings[q] == strings[p] and position[q] < position[p] for q in strings) for p in range(400)]


def test_cut_defined_cases(spark):
    docs = odd_documents(spark)
    cut = suffixes.cut_repeats(docs)
    assert cut.count() == 13
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert rows[904]["n_removed"] == 0 and rows[908]["n_removed"] == 29_999 and rows[900]["n_bytes"] == 0
    assert cut.columns[:5] == docs.columns[:5] and rows[908]["score"] == 7.5
    assert suffixes.cut_repeats(empty_documents(spark)).count() == 0
    # Rows of one id: equal texts are one document, other texts follow in a fixed order.
    passage, tail = "".join(random.Random(9).choices("abcdefgh", k=200)), "z" * 50
    same = documents(spark, [(1, passage), (1, passage), (1, passage + tail), (2, passage)])
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.cut_repeats(same).collect())
    assert found in ([(1, 200, 0), (1, 200, 0), (1, 250, 200), (2, 200, 200)], [(1, 200, 200), (1, 200, 200), (1, 250, 0), (2, 200, 200)])
    # The last byte of the first character is shared, so the character goes as a whole.
    texts = suffixes.with_cut_texts(documents(spark, [(1, "©" + passage), (2, "xé" + passage + "y"), (3, None)]))
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in texts.orderBy("doc_id").collect()] == [
        (1, "©" + passage, 201), (2, "xy", 2), (3, None, None)]
    with pytest.raises(ValueError):
        suffixes.cut_repeats(docs, 20)


# --- benchmark leaks

def test_leaks_of_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in templates.find_leaks(docs, items).collect()}
    texts, asked = docs.collect(), items.collect()
    want = {(d["doc_id"], i["item_id"]) for d in texts for i in asked if i["text"] in d["text"]}
    words = {i["item_id"]: i["text"].lower().split() for i in asked}
    for d, i in found - want:
        held = next(r["text"] for r in texts if r["doc_id"] == d).lower()
        assert any(" ".join(words[i][k:k + 12]) in held for k in range(len(words[i]) - 11))
    assert want and want <= found


QUESTION = "If Anna buys 3 boxes of 12 kg each and Anna gives 3 boxes away, how many kg does she still hold at home"


@pytest.mark.parametrize("text, share", [
    (QUESTION, 0.9),
    ("Intro words first. " + QUESTION + " and more words follow here", 0.9),
    (QUESTION.replace("Anna", "Peter").replace("3", "7").replace("12 kg", "12 miles").replace("12", "40"), 0.6),
    # One name and one number became two.
    (QUESTION.replace("Anna buys 3", "Peter buys 7").replace("Anna gives 3", "Paul gives 8").replace("12 kg", "40 miles"), None),
    (QUESTION.replace("buys", "sells").replace("still", "now").replace("away", "back"), None),
    ("If Anna buys 3 boxes of 12 kg", None),
])
def test_reparameterised_questions(spark, text, share):
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    found = templates.find_leaks(documents(spark, [(5, text), (6, "quite another text " * 20)]), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == ([(5, 1)] if share else [])
    assert not share or found[0]["share"] >= share


def test_short_items_match_as_a_whole(spark):
    items = spark.createDataFrame([(1, "what is the capital city"), (2, "name four words")], "item_id long, text string")
    docs = documents(spark, [(1, "So: what is the capital city of it"), (2, "what is the capital"), (3, "name four words")])
    assert [(r["doc_id"], r["item_id"]) for r in templates.find_leaks(docs, items).collect()] == [(1, 1)]


def test_leak_defined_cases(spark):
    items = spark.createDataFrame([(1, "long word list " * 10), (1, "long word list " * 10)], "item_id long, text string")
    docs = odd_documents(spark)
    found = templates.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(909, 1)} and len(found) == 1
    assert templates.find_leaks(docs, items.limit(0)).count() == 0
    assert templates.find_leaks(empty_documents(spark), items).count() == 0
    kept = templates.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == 12


FILL = "and so it went on for a good while before anybody noticed anything at all"


def held_items(spark, items, texts):
    found = templates.find_leaks(documents(spark, list(enumerate(texts)), extra=False), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_leaks_of_number_heavy_and_tiny_items(spark):
    items = [(1, "What is 345 plus 128 minus 27?"), (2, "Solve 3 x + 4 y = 10 and 2 x - 5 y = 7"),
             (3, "Compute 12 + 7 * 3 - 44 / 11 + 96 - 5 * 8 + 13"), (4, "Factor 391")]
    assert held_items(spark, items, [f"{FILL}. {t} {FILL}." for _, t in items]) == {(k, k + 1) for k in range(4)}
    # With other numbers: where enough words are left it is a re-parameterised question.
    others = ["What is 17 plus 99 minus 4?", "Solve 8 x + 9 y = 11 and 6 x - 3 y = 1", "Compute 1 + 2 * 4 - 5 / 6 + 7 - 9 * 10 + 14", "Factor 392"]
    assert held_items(spark, items, [f"{FILL}. {t} {FILL}." for t in others]) == {(0, 1), (1, 2)}


def test_leaks_with_names_changed_at_sentence_starts(spark):
    items = [(1, "Anna has 3 apples. Ben has 5 apples. Carl has 12 apples. How many apples in total?")]
    texts = ["Dora has 3 apples. Emil has 5 apples. Fritz has 12 apples. How many apples in total?",
             "Mary Ann has 3 apples. Ben has 5 apples. Carl Otto has 12 apples. How many apples in total?",
             "Anna has 7 apples. Ben has 5 apples. Carl has 7 apples. How many apples in total?",
             "Anna has 3 pears. Ben sold 5 boats. Carl ate 12 plums. How many days are there?"]
    assert held_items(spark, items, [f"{FILL}. {t} {FILL}." for t in texts]) == {(0, 1), (1, 1), (2, 1)}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    # Id 5 has a text in two groups, and rows without id hold two texts; each group keeps one row.
    docs = documents(spark, [(1, b), (5, a), (5, a), (5, b), (7, a), (None, c), (None, d), (9, d)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", b), ("5", a), ("None", c), ("None", d)])
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {t: f"{plain_fingerprint(t):016x}" for t in (a, b, c, d)}
    assert found == {(1, prints[b], 1), (5, prints[b], 1), (5, prints[a], 5), (7, prints[a], 5),
                     (None, prints[c], None), (None, prints[d], None), (9, prints[d], None)}
