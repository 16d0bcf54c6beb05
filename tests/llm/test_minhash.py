"""MinHash near-duplicates against SQL and all pairs, with their defined cases."""

import numpy as np

from checks.compare import canonical, connect
from meterlens.llm import minhash
from meterlens.llm.common import table
from tests.llm.helpers import documents, empty_documents, odd_documents

SMALL = "/root/testdata/sf0.001"


def plain_sets(rows, words=4):
    out = []
    for _, text in rows:
        found = text.encode().lower().split() if text else []
        out.append({tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    return out


def plain_components(rows, percent=80):
    """(id, set size, smallest id reached) of each row, by all pairs."""
    sets, low = plain_sets(rows), [(i is not None, i or 0) for i, _ in rows]
    linked = [[j for j in range(len(rows)) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    changed = True
    while changed:
        new = [min([low[i], *(low[j] for j in linked[i])]) for i in range(len(rows))]
        changed, low = new != low, new
    return sorted(((i, len(s), (x[1] if x[0] else None)) for (i, _), s, x in zip(rows, sets, low)), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def near_copies(n, changes, seed=5, length=60):
    """Texts that differ from one text in a few words each."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(length, rng.integers(0, changes + 1), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


def test_equals_its_sql(spark):
    got = minhash.near_duplicates(table(spark, SMALL, "documents")).toPandas()
    want = connect(SMALL).execute(minhash.ORACLE).df()
    assert canonical(got) == canonical(want) and (~want["kept"]).sum() > 5


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    texts = [t for k in range(12) for t in near_copies(12, 6, seed=k, length=int(rng.integers(5, 70)))]
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts))
    rows += [(1000, texts[0].upper()), (1001, "A  b\tc"), (1002, "a b c"), (1003, "a b"), (1004, "a b c"), (1004, "other text of an id"), (None, texts[5])]
    want = plain_components(rows)
    assert found(minhash.near_duplicates(documents(spark, rows))) == want
    assert len({x[2] for x in want}) < len(want) - 20


def test_bands_in_pieces_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEET", 5)
    rows = list(enumerate(near_copies(60, 7, length=64)))
    assert found(minhash.near_duplicates(documents(spark, rows))) == plain_components(rows)


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(k, "one text that many rows hold in full") for k in range(300, 0, -1)] + [(k + 500, f"text number {k} of its own kind {k}") for k in range(500)]
    got = found(minhash.near_duplicates(documents(spark, rows)))
    assert {x[2] for x in got if x[0] <= 300} == {1} and all(x[2] == x[0] for x in got if x[0] > 300)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    left, right = minhash.signature(pool[:800]), minhash.signature(pool[200:])
    assert abs((left == right).mean() - 0.6) < 0.15 and (minhash.signature(pool[::-1]) == minhash.signature(pool)).all()


def test_defined_cases(spark):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_documents(spark)).collect()]
    assert len(rows) == 13
    by_id = {r[0]: r for r in rows}
    assert all(by_id[i][1:] == (0, i, True) for i in (900, 901, 902))
    assert by_id[907][2:] == (906, False) and by_id[906][2:] == (906, True) and by_id[None][1:] == (1, None, True)
    assert by_id[909][1] == 3 and by_id[908][1] == 1
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
