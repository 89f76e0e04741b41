"""Queries for text functions (T*) and corpus statistics (C*)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as T
from ..operators import clean as C
from ..operators import stats as S
from . import fixtures as FX
from . import sql_text as ST
from .catalog import register

# Section markers that do occur in the invented documents (FIXTURES.md).
TEST_MARKERS = CleanConfig(indication_markers=("that",), description_markers=("la",),
                           from_description_onward=True)


def _digest(tokens) -> list:
    return [F.size(tokens).cast("long").alias("n_tokens"),
            F.md5(F.array_join(tokens, " ")).alias("tokens_md5")]


def _sql_digest(expr: str) -> str:
    return f"len({expr}) AS n_tokens, md5(array_to_string({expr}, ' ')) AS tokens_md5"


def cleaned(spark: SparkSession, sf_dir: str, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    return C.clean_reports(FX.reports(spark, sf_dir), cfg)


W = FX.with_ctes


@register("t1_tokenize", W(FX.SQL_REPORTS) +
          f"SELECT report_id, {_sql_digest(ST.tokenize('content'))} FROM reports")
def t1_tokenize(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return r.select("report_id", *_digest(T.tokenize("content")))


_LEX_CFG = CleanConfig()


@register("t2_proper_noun_lexicon", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_LEX_CFG)[:3]) +
          "SELECT unnest(forms) AS form FROM c_lex")
def t2_proper_noun_lexicon(spark, sf_dir):
    return C.proper_noun_lexicon(FX.reports(spark, sf_dir), "content", _LEX_CFG)


_T2_ONLY = CleanConfig(lowercase=False, remove_punctuation=False, remove_stopwords=False,
                       remove_custom_words=False, from_indication_onward=False)


@register("t2_drop_proper_nouns", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T2_ONLY)) +
          f"SELECT report_id, {_sql_digest('tokens')} FROM cleaned")
def t2_drop_proper_nouns(spark, sf_dir):
    return cleaned(spark, sf_dir, _T2_ONLY).select("report_id", *_digest(F.col("tokens")))


@register("t3_lowercase", W(FX.SQL_REPORTS) +
          "SELECT report_id, md5(lower(content)) AS text_md5, length(lower(content)) AS n_chars FROM reports")
def t3_lowercase(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return r.select("report_id", F.md5(F.lower("content")).alias("text_md5"),
                    F.length(F.lower("content")).cast("long").alias("n_chars"))


_T4 = CleanConfig(remove_proper_nouns=False, remove_stopwords=False, remove_custom_words=False,
                  from_indication_onward=False)


@register("t4_drop_punctuation", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T4)) +
          f"SELECT report_id, {_sql_digest('tokens')} FROM cleaned")
def t4_drop_punctuation(spark, sf_dir):
    return cleaned(spark, sf_dir, _T4).select("report_id", *_digest(F.col("tokens")))


_T5 = replace(_T4, remove_stopwords=True)


@register("t5_drop_stop_words", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T5)) +
          f"SELECT report_id, {_sql_digest('tokens')} FROM cleaned")
def t5_drop_stop_words(spark, sf_dir):
    return cleaned(spark, sf_dir, _T5).select("report_id", *_digest(F.col("tokens")))


# A second word list as custom words: English function words of the documents.
_T6 = replace(_T5, remove_custom_words=True, custom_words=("the", "of", "and", "is", "it"))


@register("t6_drop_custom_words", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T6)) +
          f"SELECT report_id, {_sql_digest('tokens')} FROM cleaned")
def t6_drop_custom_words(spark, sf_dir):
    return cleaned(spark, sf_dir, _T6).select("report_id", *_digest(F.col("tokens")))


_T78 = replace(TEST_MARKERS, remove_proper_nouns=False, remove_punctuation=False,
               remove_stopwords=False, remove_custom_words=False)


@register("t7_t8_sections", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T78)) +
          f"SELECT report_id, has_indication, has_description, {_sql_digest('tokens')} FROM cleaned")
def t7_t8_sections(spark, sf_dir):
    c = cleaned(spark, sf_dir, _T78)
    return c.select("report_id", "has_indication", "has_description", *_digest(F.col("tokens")))


@register("t9_join_tokens", W(FX.SQL_REPORTS) +
          f"SELECT report_id, md5(array_to_string({ST.tokenize('lower(content)')}, ' ')) AS text_md5 FROM reports")
def t9_join_tokens(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    return r.select("report_id", F.md5(T.join_tokens(T.tokenize(F.lower("content")))).alias("text_md5"))


@register("t10_clean_reports", W(FX.SQL_REPORTS, *ST.clean_ctes()) +
          f"SELECT report_id, label, {_sql_digest('tokens')}, md5(array_to_string(tokens, ' ')) AS text_md5 "
          "FROM cleaned")
def t10_clean_reports(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.select("report_id", "label", *_digest(F.col("tokens")),
                    F.md5("clean_text").alias("text_md5"))


@register("t11_missing_sections", W(FX.SQL_REPORTS, *ST.clean_ctes(cfg=_T78)) +
          "SELECT count(*) AS n_reports, "
          "CAST(sum(CASE WHEN NOT has_indication THEN 1 ELSE 0 END) AS BIGINT) AS n_without_indication, "
          "CAST(sum(CASE WHEN NOT has_description THEN 1 ELSE 0 END) AS BIGINT) AS n_without_description "
          "FROM cleaned")
def t11_missing_sections(spark, sf_dir):
    return C.missing_sections(cleaned(spark, sf_dir, _T78))


@register("t12_round_half_up",
          "SELECT doc_id, floor(n_chars / 7 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS x2, "
          "floor(-n_chars / 7 + 0.5::DOUBLE) AS x0 FROM documents")
def t12_round_half_up(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.round_half_up(F.col("n_chars") / F.lit(7), 2).alias("x2"),
                    T.round_half_up(-F.col("n_chars") / F.lit(7), 0).alias("x0"))


@register("c1_token_counts", W(FX.SQL_REPORTS, *ST.clean_ctes()) +
          "SELECT report_id, len(ot) AS n_orig_tokens, len(tokens) AS n_tokens FROM cleaned")
def c1_token_counts(spark, sf_dir):
    return S.token_counts(cleaned(spark, sf_dir))


@register("c2_length_box", W(
    FX.SQL_REPORTS, *ST.clean_ctes(),
    "long AS (SELECT 'original' AS series, len(ot) AS len FROM cleaned "
    "UNION ALL SELECT 'preprocessed', len(tokens) FROM cleaned)",
    "q AS (SELECT series, count(*) AS n, quantile_cont(len, 0.0) AS min_len, quantile_cont(len, 0.25) AS q1, "
    "quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3, "
    "quantile_cont(len, 1.0) AS max_len FROM long GROUP BY series)") + """
SELECT q.series, q.n, q.min_len, q.q1, q.median, q.q3, q.max_len,
       CAST(min(CASE WHEN l.len >= q.q1 - 1.5 * (q.q3 - q.q1) THEN l.len END) AS DOUBLE) AS whisker_low,
       CAST(max(CASE WHEN l.len <= q.q3 + 1.5 * (q.q3 - q.q1) THEN l.len END) AS DOUBLE) AS whisker_high
FROM q JOIN long l ON q.series = l.series GROUP BY ALL""")
def c2_length_box(spark, sf_dir):
    return S.length_box(cleaned(spark, sf_dir))


@register("c3_vocabulary_size", W(FX.SQL_REPORTS, *ST.clean_ctes()) +
          "SELECT 'original' AS series, count(DISTINCT t) AS vocabulary_size FROM (SELECT unnest(ot) AS t FROM cleaned) "
          "UNION ALL SELECT 'preprocessed', count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM cleaned)")
def c3_vocabulary_size(spark, sf_dir):
    return S.vocabulary_size(cleaned(spark, sf_dir))


@register("c4_top_tokens", W(FX.SQL_REPORTS, *ST.clean_ctes()) +
          "SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM cleaned) "
          "GROUP BY token ORDER BY n DESC, token LIMIT 10")
def c4_top_tokens(spark, sf_dir):
    return S.top_tokens(cleaned(spark, sf_dir), 10)


@register("c5_class_distribution", W(FX.SQL_REPORTS) +
          "SELECT label, (['stable','response','progression','unknown'])[label + 1] AS class_name, "
          "count(*) AS n FROM reports GROUP BY label")
def c5_class_distribution(spark, sf_dir):
    return S.class_distribution(FX.reports(spark, sf_dir))


@register("c6_most_frequent_language", W(FX.SQL_REPORTS) + """
SELECT label, lang, n FROM (
  SELECT label, lang, count(*) AS n, min(report_id) AS fs,
         row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(report_id)) AS rn
  FROM reports GROUP BY label, lang) WHERE rn = 1""")
def c6_most_frequent_language(spark, sf_dir):
    """Most frequent language per class; ties to the language seen first."""
    return S.most_frequent(FX.reports(spark, sf_dir), ["label"], "lang", "report_id")
