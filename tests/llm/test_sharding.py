import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import sharding
from tessera.llm.sharding import minimax_shards


def _greedy(sizes, cap, shards):
    ends, at, total = [], 0, 0
    for _ in range(shards):
        total = 0
        while at < len(sizes) and total + sizes[at] <= cap:
            total += sizes[at]
            at += 1
        ends.append(at)
    return ends


def _brute(rows, shards, overhead=8):
    """Groups by text digest; oversize groups alone; minimax by trying capacities in order."""
    size = defaultdict(int)
    for _, t in rows:
        size[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + overhead
    own, total = [], sum(size.values())
    for key, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        left = shards - len(own)
        if left > 1 and s * left > total:
            own.append(key)
            total -= s
        else:
            break
    keys = sorted(k for k in size if k not in own)
    sizes, left = [size[k] for k in keys], shards - len(own)
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(sizes, mid, left)[-1] == len(sizes) else (mid + 1, high)
    shard, at = {}, 0
    for k, end in enumerate(_greedy(sizes, low, left)):
        shard.update((keys[i], k) for i in range(at, end))
        at = end
    shard.update((key, left + i) for i, key in enumerate(own))
    return shard


def _check(docs, rows, shards):
    got = minimax_shards(docs, shards).collect()
    want = _brute(rows, shards)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == sorted(
        (repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()),
         want[hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(edge_docs, edge_rows):
    _check(edge_docs, edge_rows, 24)
    _check(edge_docs, edge_rows, 3)


@pytest.mark.parametrize("first,more", [(3, 2), (1, 1)])
def test_random_groups(spark, monkeypatch, first, more):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", first)
    monkeypatch.setattr(sharding, "MORE_DIGITS", more)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, "w" * rng.choice([1, 5, 90]) + str(rng.randrange(900))) for i in range(1500)]
    rows += [(2000 + i, "hot text") for i in range(700)]
    _check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, 24)


def test_empty_table(no_docs):
    assert minimax_shards(no_docs).count() == 0
