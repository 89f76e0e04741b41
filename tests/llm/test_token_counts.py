import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_counts as M
from tessera.llm.token_counts import frequent_pre_tokens, lengths, load_model, pre_tokens, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = load_model(PATH)


def _by_parts(text):
    return text.count("\n") + sum(sum(lengths(MODEL, p)) for p in pre_tokens(text)) if text else 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t\ra.1é<s>"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_parts_add_up(text):
    assert _by_parts(text) == len(MODEL.encode(text))


def test_parts_add_up_across_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 5)
    for text in ["  a  b " * 20, "a\n\n  b▁▁ c " * 9, "x" * 100, " " * 50]:
        assert _by_parts(text) == len(MODEL.encode(text))


@pytest.mark.parametrize("held", [3, 200_000])
def test_query_over_edges(monkeypatch, edge_docs, edge_rows, no_docs, held):
    monkeypatch.setattr(M, "HELD", held)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(edge_docs, PATH).collect()), key=repr)
    want = []
    for i, t in edge_rows:
        n = len(MODEL.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr) and any(r[3] for r in got)
    assert token_counts(no_docs, PATH).count() == 0


def test_table_is_bounded_and_frequent(spark):
    docs = spark.createDataFrame([("a a a b b c " + "z" * 500,)] * 3, "text string")
    assert frequent_pre_tokens(docs, 2) == [" a", " b"]


def test_special_strings_are_text(spark):
    text = "x<s>y</s> <unk> <0x0A>"
    (row,) = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).collect()
    assert row.n_tokens == len(MODEL.encode(text))
