import random

import numpy as np
import pytest

from tessera.llm import decontam as M
from tessera.llm.decontam import Seeds, contaminated, contamination, drop_contaminated, tiling, tokens, window_hashes

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong potions"


def _tiling(item, doc, m):
    """Greedy string tiling by definition: mark the longest common unmarked run until none is left."""
    used_i, used_d, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n]
                       and p + n not in used_i and d + n not in used_d):
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < m:
            return found
        used_i |= set(range(p, p + n))
        used_d |= set(range(d, d + n))
        found.append((p, d, n))


def test_tiling_is_the_definition():
    rng = random.Random(4)
    for _ in range(400):
        letters = rng.choice(["a", "ab", "abc", "abcdef"])
        item = [rng.choice(letters) for _ in range(rng.randint(1, 18))]
        doc = [rng.choice(letters + "z") for _ in range(rng.randint(0, 40))]
        if doc and rng.random() < .6:
            at = rng.randrange(len(doc))
            doc[at:at] = item[len(item) // 2:] + item[:len(item) // 2]
        m = rng.choice([1, 2, 3])
        number = {c: i + 1 for i, c in enumerate(letters)}
        got = tiling(np.array([number[c] for c in item], np.int64), np.array([number.get(c, 0) for c in doc], np.int64), m)
        assert got == _tiling(item, doc, m), (item, doc, m)


def test_coverage_is_that_of_the_definition():
    rng = random.Random(5)
    for _ in range(200):
        item = [rng.choice("abc") for _ in range(rng.randint(1, 18))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 40))] + item[len(item) // 2:] + item[:len(item) // 2]
        m = min(3, len(item))
        found = {i: (t, c) for i, t, c, _ in contamination(" ".join(doc), Seeds.of([(1, " ".join(item))], 3), 0.01)}
        want = _tiling(item, doc, m)
        assert found.get(0, (0, 0)) == (len(want), sum(n for _, _, n in want)), (item, doc)


def test_repetitive_texts_stay_small():
    import resource
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    seeds = Seeds.of([(1, "word " * 2000), (2, "word other " * 400)], 5)
    found = {i: (t, c) for i, t, c, _ in contamination("word " * 1_000_000, seeds, 0.6)}
    assert found == {0: (1, 2000)}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_short_items_are_matched_whole():
    seeds = Seeds.of([(1, "Who wrote it"), (2, "yes"), (3, ""), (4, "a b c d e f")], 5)
    hits = lambda text: sorted(i for i, *_ in contamination(text, seeds, 0.6))
    assert hits("so who wrote it then") == [0] and hits("wrote it who") == [] and hits("Yes, who wrote") == [1]
    assert hits("") == [] and hits("a b c d e") == [3]


def test_hash_rolls():
    ids = np.array([1, 2, 3, 1, 2, 3, 4], np.int64)
    h = window_hashes(ids, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(window_hashes(ids[:2], 3)) == 0


@pytest.mark.parametrize("text,hit", [
    (f"noise before {ITEM.upper()}. and after", True),
    (" ".join(["x"] * 50 + ITEM.split()[8:] + ["y"] * 30 + ITEM.split()[:8]), True),          # reordered
    (" ".join(ITEM.split()[:5] + ["z"] * 9), False),                                          # a short overlap
    (" ".join(w for w in reversed(ITEM.split())), False), ("", False)])
def test_cases(spark, text, hit):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, item_id long")
    rows = contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == ([(1, 7)] if hit else [])
    assert drop_contaminated(docs, bench).count() == (0 if hit else 1)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, contaminated(docs, bench).collect()))
    monkeypatch.setattr(M, "BLOCK_CHARS", 3000)
    assert one and one == sorted(map(tuple, contaminated(docs, bench).collect()))
    # brute force: an item counts where its words stand in a row
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect()
             if f" {' '.join(tokens(b.text))} " in f" {' '.join(tokens(d.text))} "}
    assert whole <= {r[:2] for r in one}


def test_edges(edge_docs, edge_rows, no_docs, spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(edge_docs, bench).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (None, 1)], key=repr)
    left = drop_contaminated(edge_docs, bench)
    assert left.columns == edge_docs.columns and left.count() == len(edge_rows) - 3
    assert contaminated(no_docs, bench).count() == 0 and contaminated(edge_docs, bench.where("false")).count() == 0
    assert drop_contaminated(edge_docs, bench.where("false")).count() == len(edge_rows)
