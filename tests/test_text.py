"""Text functions on literal rows."""
from pyspark.sql import functions as F

from tessera.config import CleanConfig
from tessera.functions import text as T
from tessera.operators.clean import clean_reports


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_tokenizer_words_and_punctuation(spark):
    assert _one(spark, T.tokenize, "Hello, wörld!! a_b 12.03.2019 (x)") == \
        ["Hello", ",", "wörld", "!!", "a_b", "12", ".", "03", ".", "2019", "(", "x", ")"]


def test_drop_punctuation_keeps_dates(spark):
    toks = T.tokenize(F.lit("12.03.2019 12_05 a_b 2019_03_12 -- (x) mai_12 jan_x"))
    out = spark.range(1).select(T.drop_punctuation(toks).alias("o")).first()["o"]
    assert out == ["12", "03", "2019", "12_05", "2019_03_12", "x", "mai_12", "jan_x"]


def test_after_last_marker(spark):
    cases = {("a", "that", "b", "that", "c"): ["c"], ("a", "b"): ["a", "b"], ("a", "that"): [], (): []}
    for toks, want in cases.items():
        arr = F.array(*[F.lit(t) for t in toks]) if toks else F.array().cast("array<string>")
        got = spark.range(1).select(T.after_last_marker(arr, ["that"]).alias("o")).first()["o"]
        assert got == want, toks


def test_ngrams_guard_short_lists(spark):
    for toks, want in {("a",): ["a"], (): [], ("a", "b", "c"): ["a", "b", "c", "a b", "b c", "a b c"]}.items():
        arr = F.array(*[F.lit(t) for t in toks]) if toks else F.array().cast("array<string>")
        got = spark.range(1).select(T.ngrams(arr, 3).alias("o")).first()["o"]
        assert got == want, toks


def test_round_half_up(spark):
    vals = [(2.5,), (-2.5,), (1.245,), (0.125,)]
    df = spark.createDataFrame(vals, "v double").select(T.round_half_up("v", 0).alias("r0"),
                                                        T.round_half_up("v", 2).alias("r2"))
    got = [(r.r0, r.r2) for r in df.collect()]
    assert got[0] == (3.0, 2.5) and got[1] == (-2.0, -2.5) and got[3][1] == 0.13


def test_clean_pipeline_stop_words_and_sections(spark):
    df = spark.createDataFrame([(1, "Indication: la tumeur de Paris. Description stable et pas de changement.")],
                               "report_id long, content string")
    cfg = CleanConfig(remove_proper_nouns=False, from_description_onward=True)
    out = clean_reports(df, cfg).first()
    assert out["tokens"] == ["stable", "pas", "changement"]
    assert out["has_indication"] and out["has_description"]


def test_proper_noun_lexicon_drops_names_keeps_digits_and_keep_list(spark):
    """One plan for any lexicon; null and empty token lists and shared ids have the same results."""
    from tessera.operators.clean import drop_proper_nouns
    rows = [(1, ["Paris", "est", "MPRAGE", "Paris2", "paris"]), (2, None), (3, []), (4, ["rien"]), (4, ["PARIS", "ici"]),
            (None, ["ici"])]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    lexicon = spark.createDataFrame([("paris",), ("mprage",), ("absent",)], "form string")
    got = drop_proper_nouns(df, "id", "toks", lexicon, ("MPRAGE",)).collect()
    assert sorted(((r.id, r.toks) for r in got), key=repr) == sorted(
        [(1, ["est", "MPRAGE", "Paris2"]), (2, None), (3, []), (4, ["rien"]), (4, ["ici"]), (None, ["ici"])], key=repr)


def test_ngrams_up_to_five_carry_their_length(spark):
    words = ["a", "b", "a", "c", "d", "e"]
    want = [(" ".join(words[i:i + n]), n) for n in range(1, 6) for i in range(len(words) - n + 1)]
    arr = F.array(*[F.lit(w) for w in words])
    row = spark.range(1).select(T.ngrams(arr, 5).alias("o"), T.ngrams_with_n(arr, 5).alias("t")).first()
    assert row["o"] == [t for t, _ in want] and [tuple(x) for x in row["t"]] == want
    for n in range(4):
        short = F.array(*[F.lit(w) for w in words[:n]]).cast("array<string>")
        got = spark.range(1).select(T.ngrams_with_n(short, 5).alias("t")).first()["t"]
        assert [tuple(x) for x in got] == [(" ".join(words[i:i + m]), m) for m in range(1, n + 1) for i in range(n - m + 1)]


def test_vocabulary_estimate_and_binary_classes(spark):
    from tessera.operators import stats as S
    rows = [(i, [f"w{j}" for j in range(i, i + 40)], ["x"], i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, orig_tokens array<string>, tokens array<string>, label int")
    exact = {r.series: r.vocabulary_size for r in S.vocabulary_size(df).collect()}
    near = {r.series: r.vocabulary_size for r in S.vocabulary_size(df, approx=True).collect()}
    assert exact == {"original": 139, "preprocessed": 1}
    assert abs(near["original"] - 139) <= 0.1 * 139 and near["preprocessed"] == 1
    got = {(r.label, r.class_name, r.n) for r in S.class_distribution(df, binary=True).collect()}
    assert got == {(0, "stable", 50), (1, "unstable", 50)}
