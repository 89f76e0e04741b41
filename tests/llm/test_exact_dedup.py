import hashlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import exact_dedup, keep_unique


def _brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = pick(named) if named else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("bits", [1, 4])
def test_edges_against_brute_force(edge_docs, edge_rows, keep, pick, bits):
    got = exact_dedup(edge_docs, keep=keep, bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _brute(edge_rows, pick)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert keep_unique(no_docs).columns == no_docs.columns and keep_unique(no_docs).count() == 0


def test_hot_text_over_many_runs(spark):
    docs = spark.range(0, 3000, 1, 37).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) AS text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup(docs, keep="largest", bits=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _brute(rows, max)


def test_keep_unique_keeps_whole_rows(edge_docs, edge_rows):
    got = keep_unique(edge_docs).collect()
    assert len(got) == len({t or "" for _, t in edge_rows})
    assert {r.text or "" for r in got} == {t or "" for _, t in edge_rows}
    assert all(r.best is None and r.component == 5 for r in got)
