import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as M
from tessera.llm.packing import Words, fill_bins, harmonic_pack, piece_lengths, stem_and_marks

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)
WORDS = Words(PATH)


def _ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 50_000))
def test_pieces_cover_the_document(n):
    got = piece_lengths(n)
    assert sum(got) == n and max(got) <= 2048 and min(got) > 0 and len(got) <= n // 2048 + 3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAéÉİıΣς'.,!?-<|1²½é̇"), st.characters(exclude_categories=("Cs",))),
               min_size=1, max_size=8).filter(lambda w: " " not in w and "\n" not in w))
def test_stem_and_marks(word):
    stem, marks = stem_and_marks(word)
    assert _ids(word) == _ids(stem) + _ids(marks)
    assert np.frombuffer(WORDS.ids(word), "<u4").tolist() == _ids(word)


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_bins(n):
    rng = random.Random(n)
    length = np.array([rng.choice([1, 3, 2048, 1024, rng.randint(1, 2048)]) for _ in range(n)], np.int64)
    bins, offset = fill_bins(length)
    held = defaultdict(list)
    for b, o, m in zip(bins.tolist(), offset.tolist(), length.tolist()):
        held[b].append((o, m))
    for pieces in held.values():
        at = 0
        for o, m in sorted(pieces):
            assert o == at
            at += m
        assert at <= 2048
    if n == 3000:       # full bins of a class hold exactly k pieces
        assert sum(len({2048 // m for _, m in p}) == 1 and len(p) == 2048 // p[0][1] for p in held.values()) > 0.5 * len(held)


@pytest.mark.parametrize("held,worker", [(5, 16_384), (600_000, 3)])
def test_ids_survive(monkeypatch, edge_docs, edge_rows, no_docs, held, worker):
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "WORKER_PIECES", worker)
    got = harmonic_pack(edge_docs, PATH).collect()
    want = []
    for i, t in edge_rows:
        ids, at = _ids(t) + [1], 0
        for n in piece_lengths(len(ids)):
            crc = zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())
            want.append((i, at, n, crc, len(ids)))
            at += n
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_length))
    for s in sequences.values():
        at = 0
        for o, n, _ in sorted(s):
            assert o == at
            at += n
        assert at <= 2048 and {p for _, _, p in s} == {at if at & (at - 1) == 0 else 2048}
    assert harmonic_pack(no_docs, PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = harmonic_pack(docs, PATH).toPandas()
    held = got.groupby("sequence_id").agg(n=("length", "sum"), p=("padded_length", "first"))
    assert 1 - held.n.sum() / held.p.sum() < 0.02
    assert got.groupby("doc_id").length.sum().equals(got.groupby("doc_id").doc_tokens.first().rename("length"))


def test_repeated_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(M, "WORKER_PIECES", 500)
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same few words' AS text").repartition(4)
    got = M.harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    sizes = [r["count"] for r in got.selectExpr("sequence_id >> 32 AS worker").groupBy("worker").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * 500
