"""What moves between tasks: texts and narrow rows, not what is made from them."""
import re

from pyspark.sql import functions as F

from tessera.operators import features as FE

DOCS = [(1, "red blue red blue red"), (2, "blue"), (2, "blue green"), (3, ""), (4, None), (5, "a b"), (None, "red green")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return spark.createDataFrame(DOCS, "report_id long, text string").repartition(3)


def test_terms_are_counted_in_their_report(spark):
    got = {(r.report_id, r.term, r.n, r.tf) for r in FE.doc_terms(_docs(spark), "text", 2).collect()}
    assert got == {(1, "red", 1, 3), (1, "blue", 1, 2), (1, "red blue", 2, 2), (1, "blue red", 2, 2),
                   (2, "blue", 1, 2), (2, "green", 1, 1), (2, "blue green", 2, 1),
                   (None, "red", 1, 1), (None, "green", 1, 1), (None, "red green", 2, 1)}


def test_terms_meet_their_members_where_they_are(spark):
    terms = FE.doc_terms(_docs(spark), "text", 2)
    members = _docs(spark).select(F.lit(0).alias("split_id"), "report_id")
    stats, _ = FE.term_stats(terms, members)
    # above the rows of the terms stands one exchange: the statistics by term
    above = _plan(stats).split("Generate")[0]
    assert len(re.findall(r"Exchange hashpartitioning", above)) == 1


def test_a_term_moves_once_to_its_weight(spark):
    terms = FE.doc_terms(_docs(spark), "text", 2)
    members = _docs(spark).select(F.lit(0).alias("split_id"), "report_id")
    vocab = FE.vocabulary(terms, members, min_df=1, max_df=1.0)
    w = FE.raw_weights(terms, members, vocab)
    assert {(r.report_id, r.term) for r in w.collect()} >= {(1, "red blue"), (2, "blue green")}
    to_join = [line for line in _plan(w).splitlines() if "_key" in line and "Project" in line]
    assert to_join and not any(re.search(r"\[.*\bterm#\d+, .*AS _key", line) for line in to_join)


def test_texts_are_cut_into_tokens_after_they_moved(spark):
    from tessera.operators.clean import clean_reports
    docs = spark.createDataFrame([(1, "We saw Anna. She saw Anna, anna2 and Bob"), (1, "the Anna"), (2, None), (None, "x Bob")],
                                 "report_id long, content string")
    cleaned = clean_reports(docs)
    plan = _plan(cleaned)
    assert plan.index("AS orig_tokens") < plan.index("Join")
    assert cleaned.columns == ["report_id", "content", "orig_tokens", "tokens", "has_indication", "has_description",
                               "clean_text", "n_orig_tokens", "n_tokens"]
    assert cleaned.count() == 4
