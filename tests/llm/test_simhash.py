import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as M
from tessera.llm.components import connected_components
from tessera.llm.simhash import covering_masks, forest, keep_representatives, near_dedup, near_links, simhash


def _naive(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_fingerprint(monkeypatch, block, edge_rows):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    for text in [t or "" for _, t in edge_rows if len(t or "") < 1000] + ["A b\tc\x0bd E", "x " * 50, "É é a\xa0b c d e"]:
        assert simhash(text) == _naive(text)


def test_every_pair_within_the_radius_meets():
    for radius in (1, 2, 4):
        masks = covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(1)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & diff for m in masks)
    open_bits = [i for i in range(64) if i % 2]
    for four in itertools.islice(itertools.combinations(open_bits, 4), 5000):
        assert any(not m & sum(1 << b for b in four) for m in covering_masks(4, open_bits))


def _components(fps, radius):
    fps = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(fps)))
    for i, j in forest(fps, radius):
        root[i] = j
    return {int(f): int(fps[r]) for f, r in zip(fps, root)}


def test_forest_against_all_pairs():
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(6)]
    got = _components(fps, 3)
    label = {f: f for f in set(fps)}
    for _ in range(len(fps)):
        for a, b in itertools.combinations(label, 2):
            if (a ^ b).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups(got) == groups(label)


@pytest.mark.parametrize("max_bucket,rows", [(3, 5), (40, 1000), (20_000, 1000)])
def test_links_with_split_buckets(spark, monkeypatch, max_bucket, rows):
    """Dense neighbourhoods whose buckets overflow give the components of brute force."""
    monkeypatch.setattr("tessera.llm.common.ARROW_ROWS", rows)
    rng = random.Random(max_bucket)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(60):
            fps.add(f)
            if rng.random() < 0.5:
                f ^= sum(1 << b for b in rng.sample(range(20), rng.randint(1, 5)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in connected_components(near_links(nodes, 4, max_bucket)).collect()}
    want = _components(fps, 4)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups({signed(f): got.get(signed(f), signed(f)) for f in fps}) == groups({signed(a): b for a, b in want.items()})


def test_edges(edge_docs, edge_rows):
    got = sorted(((r.doc_id, r.fingerprint) for r in near_dedup(edge_docs).collect()), key=repr)
    assert got == sorted(((i, f"{simhash(t or ''):016x}") for i, t in edge_rows), key=repr)
    label = _components([simhash(t or "") for _, t in edge_rows], 4)
    first = {}
    for i, t in edge_rows:
        c = label[simhash(t or "")]
        first[c] = min(x for x in (first.get(c), i) if x is not None) if i is not None or c in first else None
    want = sorted(((i, first[label[simhash(t or "")]]) for i, t in edge_rows), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in near_dedup(edge_docs).collect()), key=repr) == want
    assert (2, 1) in want and (4, 3) in want and (5, 3) in want and (None, 1) in want and (None, 3) in want


def test_representatives_keep_one_row_of_each_component(edge_docs, edge_rows, spark):
    kept = keep_representatives(edge_docs).collect()
    groups = near_dedup(edge_docs).select("component_id").distinct().count()
    ids = [r.doc_id for r in kept]
    assert len(kept) == groups and None not in ids
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and ids.count(9) == 1
    assert all(r.component == 5 for r in kept)
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "x1 x2 x3 x4 x5"), (7, "X1 x2 x3 x4 x5"), (7, "x1 x2 x3 x4 x5")]
    for part in (rows, rows[:2], rows[2:]):
        got = keep_representatives(spark.createDataFrame(part, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len({(t or "").lower() for _, t in part})


def test_hot_keys_go_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARES", 3)
    docs = spark.range(90).selectExpr("id AS doc_id", "if(id % 3 = 0, 'one two three four five six', concat('w', id, ' x', id, ' y z', id)) AS text")
    got = {r.doc_id: r.component_id for r in near_dedup(docs).collect()}
    monkeypatch.setattr(M, "SHARES", 10**6)
    assert len(got) == 90 and got == {r.doc_id: r.component_id for r in near_dedup(docs).collect()}
    assert got[87] == 0


def test_empty_table(no_docs):
    assert near_dedup(no_docs).count() == 0 and keep_representatives(no_docs).count() == 0


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(chain.where("false")).count() == 0
