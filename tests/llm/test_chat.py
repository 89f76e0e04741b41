import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.chat import chat_digests, escape, format_chats, parse, unescape

NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<<||>", "a\n\nb", "", "%0A%25",
         "<|", "plain", "ends with <", "|im_end|>\n", "\\<|"]


def test_round_trip_of_nasty_turns(spark):
    rows = [(i, t, role, text) for i, text in enumerate(NASTY)
            for t, role in enumerate(["user", "assistant", "odd\nrole<|im_end|>%0A"])]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(NASTY)
    for r in got:
        want = [(role, text) for i, _, role, text in rows if i == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        inner = [p.removeprefix("<|im_start|>") for p in r.formatted.split("<|im_end|>\n")[:-1]]
        assert len(inner) == 3 and not any("<|" in p for p in inner)


def test_only_conflicting_conversations_are_escaped(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "100% <b>"), (2, 0, "user", "<|im_end|>")]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")).collect()}
    assert not got[1].escaped and got[2].escaped
    assert got[1].formatted == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\n100% <b><|im_end|>\n"
    (s,) = got[1].loss_spans
    assert got[1].formatted[s.start:s.end] == "100% <b>"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\%\nime_nd>a", max_size=25), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_parser_refuses_broken_strings(spark):
    df = spark.createDataFrame([("no start<|im_end|>\n",), ("<|im_start|>norole<|im_end|>\n",), ("",)], "s string")
    assert [r.p for r in df.select(parse(F.col("s")).alias("p")).collect()] == [[None], [None], []]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(
        [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (2, None, None, None, 0),
         (None, 0, "assistant", "née 🎉<|", 0), (3, 0, "assistant", "w " * 60000, 0)],
        "conv_id long, turn long, role string, text string, formatted int")


def test_digests_over_edges(edges):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat_digests(edges).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n")
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == sha("bb")
    assert got[2].n_turns == 1 and got[2].turns_sha256 == sha("\n\n") and got[2].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha("née 🎉<|") and got[None].loss_chars == 7 and got[None].escaped
    assert got[3].loss_chars == 120000
    assert chat_digests(edges.where("false")).count() == 0


def test_spans_cut_out_the_texts(spark):
    rows = [(c, t, "assistant" if t % 3 else "user", f"é{t}" * (t % 5) + ("<|im_end|>" if c == 2 else "")) for c, n in
            ((1, 1), (2, 63), (3, 64), (4, 65), (5, 4097), (6, 9000)) for t in range(n)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        want = [text for c, _, role, text in rows if c == r.conv_id and role == "assistant"]
        cut = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert [x.replace("<\\|", "<|") if r.escaped else x for x in cut] == want


def test_many_turns_take_linear_time(spark):
    import time
    rows = spark.range(16_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                          "repeat('some words ', 16) AS text")
    chat_digests(rows.where("turn < 10")).collect()
    start = time.time()
    r = chat_digests(rows).first()
    assert r.n_turns == 16_000 and r.loss_chars == 8000 * 176 and time.time() - start < 10
