"""Queries for sources, sinks and label / validation operators (S*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RF_MAX_FEATURES, TFIDF_NGRAMS, TFIDF_PVS
from ..operators import labels as L
from ..sources import readers as R
from ..sources import sinks as K
from ..session import scratch_path
from . import fixtures as FX
from .catalog import register

W = FX.with_ctes


def _read_fixture_reports(spark, sf_dir):
    return R.read_reports(spark, FX.write_reports_json(spark, sf_dir))


@register("s1_read_reports", W(FX.SQL_REPORTS) +
          "SELECT report_id, md5(content) AS content_md5 FROM reports")
def s1_read_reports(spark, sf_dir):
    df = _read_fixture_reports(spark, sf_dir)
    return df.select("report_id", F.md5("content").alias("content_md5"))


@register("s2_read_sessions", W(FX.SQL_REPORTS) +
          "SELECT md5(content) AS report_md5, CAST(ipp AS VARCHAR) AS ipp FROM reports")
def s2_read_sessions(spark, sf_dir):
    s = R.read_sessions(spark, FX.write_sessions_csv(spark, sf_dir))
    return s.select(F.md5("report").alias("report_md5"), "ipp")


@register("s4_s5_run_results_round_trip", W(FX.SQL_PRED) +
          "SELECT realization, report_id, y_true, votes FROM pred WHERE embedding = 'tf_idf'")
def s4_s5_run_results_round_trip(spark, sf_dir):
    root = scratch_path(spark, "run-results")
    K.write_run_results(FX.pred(spark, sf_dir).withColumn("run_date", F.lit("Jun_19_2021")), root)
    back = R.read_curves(spark, root, "tf_idf", "Jun_19_2021")
    return back.select("realization", "report_id", "y_true", "votes")


@register("p1_null_counts",
          "SELECT CAST(count_if(doc_id IS NULL) AS BIGINT) AS n_null_doc_id, CAST(count_if(text IS NULL) AS BIGINT) AS n_null_text, "
          "CAST(count_if(lang IS NULL) AS BIGINT) AS n_null_lang, CAST(count_if(source IS NULL) AS BIGINT) AS n_null_source FROM documents")
def p1_null_counts(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return L.null_counts(d, ["doc_id", "text", "lang", "source"])


@register("p2_project_reports", W(FX.SQL_REPORTS) +
          "SELECT report_id, md5(content) AS content_md5 FROM reports")
def p2_project_reports(spark, sf_dir):
    df = L.require_no_nulls(_read_fixture_reports(spark, sf_dir))
    return df.select("report_id", F.md5("content").alias("content_md5"))


@register("p3_classification_entry", W(FX.SQL_REPORTS) +
          "SELECT report_id, md5(' Lesion_stable|' || ([' Global_stable', ' Global_response', "
          "' Global_progression', ' Global_unknown'])[label + 1]) AS classes_md5 FROM reports")
def p3_classification_entry(spark, sf_dir):
    df = _read_fixture_reports(spark, sf_dir)
    e = L.classification_entry(df)
    return df.select("report_id", F.md5(F.array_join(e["classes"], "|")).alias("classes_md5"))


@register("p4_global_label", W(FX.SQL_REPORTS) + "SELECT report_id, label FROM reports")
def p4_global_label(spark, sf_dir):
    return L.extract_labels(_read_fixture_reports(spark, sf_dir)).select("report_id", "label")


@register("p5_drop_unknown", W(FX.SQL_REPORTS) + "SELECT report_id, label FROM reports WHERE label <> 3")
def p5_drop_unknown(spark, sf_dir):
    return L.known_labels(L.extract_labels(_read_fixture_reports(spark, sf_dir))).select("report_id", "label")


@register("p6_binary_label", W(FX.SQL_REPORTS) +
          "SELECT report_id, CAST(CASE WHEN label = 2 THEN 1 ELSE label END AS INT) AS y "
          "FROM reports WHERE label <> 3")
def p6_binary_label(spark, sf_dir):
    df = L.known_labels(L.extract_labels(_read_fixture_reports(spark, sf_dir)))
    return df.select("report_id", L.binary_label(F.col("label")).alias("y"))


_KEY_SQL = ("'ngram' || CAST(n_gram AS VARCHAR) || '_pvs' || coalesce(CAST(pvs AS VARCHAR), 'None') "
            "|| '_mf' || CAST(mf AS VARCHAR)")


@register("p8_combo_key", W(FX.SQL_VAL_SCORES) +
          f"SELECT realization, outer_fold, inner_fold, seq, {_KEY_SQL} AS combo_key FROM val_scores")
def p8_combo_key(spark, sf_dir):
    v = FX.val_scores(spark, sf_dir)
    return v.select("realization", "outer_fold", "inner_fold", "seq",
                    L.tfidf_combo_key(F.col("n_gram"), F.col("pvs"), F.col("mf")).alias("combo_key"))


@register("p9_parse_combo_key", W(FX.SQL_VAL_SCORES) +
          "SELECT realization, outer_fold, inner_fold, seq, n_gram, pvs, mf FROM val_scores")
def p9_parse_combo_key(spark, sf_dir):
    k = p8_combo_key(spark, sf_dir)
    return k.select("realization", "outer_fold", "inner_fold", "seq", *L.parse_tfidf_key(F.col("combo_key")))


_D2V_KEY_SQL = ("'type' || CAST(seq % 2 AS VARCHAR) || '_vs' || CAST(n_gram * 10 AS VARCHAR) "
                "|| '_mf' || CAST(mf AS VARCHAR)")


def _d2v_keys(spark, sf_dir):
    v = FX.val_scores(spark, sf_dir)
    return v.select("realization", "outer_fold", "inner_fold", "seq", L.d2v_combo_key(
        F.col("seq") % 2, F.col("n_gram") * 10, F.col("mf")).alias("combo_key"))


@register("p8_vector_combo_key", W(FX.SQL_VAL_SCORES) +
          f"SELECT realization, outer_fold, inner_fold, seq, {_D2V_KEY_SQL} AS combo_key FROM val_scores")
def p8_vector_combo_key(spark, sf_dir):
    return _d2v_keys(spark, sf_dir)


@register("p9_parse_vector_combo_key", W(FX.SQL_VAL_SCORES) +
          "SELECT realization, outer_fold, inner_fold, seq, CAST(seq % 2 AS INT) AS d2v_type, "
          "CAST(n_gram * 10 AS INT) AS size, mf FROM val_scores")
def p9_parse_vector_combo_key(spark, sf_dir):
    k = _d2v_keys(spark, sf_dir)
    return k.select("realization", "outer_fold", "inner_fold", "seq", *L.parse_d2v_key(F.col("combo_key")))


def tfidf_grid(spark):
    rows = [(n, p, m) for n in TFIDF_NGRAMS for p in TFIDF_PVS for m in RF_MAX_FEATURES]
    return spark.createDataFrame(rows, "n_gram int, pvs double, mf double")


@register("p10_off_grid_keys", W(FX.SQL_VAL_SCORES) +
          "SELECT realization, outer_fold, inner_fold, seq, n_gram + 1 AS n_gram, pvs, mf FROM val_scores "
          "WHERE (realization + outer_fold + inner_fold + seq) % 3 = 0 AND n_gram + 1 NOT IN (3, 4, 5)")
def p10_off_grid_keys(spark, sf_dir):
    """Keys read back, a third of them with an n-gram length one too large: those that left the grid."""
    parsed = p9_parse_combo_key(spark, sf_dir)
    moved = (F.col("realization") + F.col("outer_fold") + F.col("inner_fold") + F.col("seq")) % 3 == 0
    parsed = parsed.withColumn("n_gram", F.col("n_gram") + F.when(moved, 1).otherwise(0))
    return L.off_grid(parsed, tfidf_grid(spark), ["n_gram", "pvs", "mf"])


@register("p11_no_skill_equal", W(FX.SQL_PRED) + """
SELECT count(DISTINCT round(ns, 12)) AS n_distinct FROM (
  SELECT embedding, avg(p) AS ns FROM (
    SELECT embedding, realization, avg(y_true) AS p FROM pred
    WHERE embedding = 'tf_idf' OR report_id % 3 <> 0 GROUP BY ALL) GROUP BY embedding)""")
def p11_no_skill_equal(spark, sf_dir):
    """The no-skill levels of two runs over different reports: as many values as there are levels."""
    from ..operators.curves import no_skill
    p = FX.pred(spark, sf_dir).where((F.col("embedding") == "tf_idf") | (F.col("report_id") % 3 != 0))
    return L.distinct_no_skill(no_skill(p))


@register("s3_vectors_tsv", W(FX.SQL_REPORTS, "x AS (SELECT r.report_id, r.label, md5('0-' || CAST(r.report_id AS VARCHAR)) AS h FROM reports r)",
                              "cnt AS (SELECT label, count(*) AS n FROM x GROUP BY ALL)",
                              "off AS (SELECT label, sum(n) OVER (ORDER BY label) - n AS o FROM cnt)",
                              "fo AS (SELECT x.*, CAST((off.o + row_number() OVER (PARTITION BY x.label ORDER BY x.h, x.report_id) - 1) % 5 AS INT) "
                              "AS outer_fold FROM x JOIN off USING (label))",
                              "v AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(regexp_extract_all(lower(d.text), "
                              "'[\\p{L}\\p{N}_]{2,}')) AS w, d.doc_id FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id))",
                              "df AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT unnest(regexp_extract_all(lower(d.text), "
                              "'[\\p{L}\\p{N}_]{2,}')) AS w, d.doc_id FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id) GROUP BY w)",
                              "nd AS (SELECT count(*) AS n_docs FROM fo WHERE label <> 3)",
                              "sz AS (SELECT least(count(*), (SELECT CAST(floor(n * 0.9 + 0.5) AS BIGINT) FROM v)) AS n "
                              "FROM df, nd WHERE df.df >= 2 AND df.df <= 0.9 * n_docs)") +
          "SELECT outer_fold, count(*) AS n_lines, CAST(count(*) * (SELECT n FROM sz) AS BIGINT) AS n_values "
          "FROM fo WHERE label <> 3 GROUP BY outer_fold")
def s3_vectors_tsv(spark, sf_dir):
    """Vectors of the labelled reports (single words) as tab-separated lines, one
    folder per test fold, read back: (outer_fold, n_lines, n_values)."""
    from ..operators import features as FE
    from ..operators import splits as SP
    from ..session import cut_lineage
    from .q_features import PVS, labelled_docs
    docs = labelled_docs(spark, sf_dir)
    members = docs.select(F.lit(0).alias("split_id"), "report_id")
    terms = cut_lineage(FE.doc_terms(docs, "text", 1))
    v = cut_lineage(FE.numbered_vocabulary(FE.vocabulary(terms, members, pvs=PVS)))
    size = v.count()
    vec = FE.sparse_vectors(FE.indexed_weights(terms, members, v, n_terms=size), members, size)
    rep = SP.with_realizations(FX.reports(spark, sf_dir).select("report_id", "label"), 1)
    folds = SP.stratified_fold(rep, 5, [F.col("realization")], group_cols=["realization"], out_col="outer_fold")
    x = vec.join(cut_lineage(folds.select("report_id", "label", "outer_fold")), "report_id")
    out = scratch_path(spark, "vectors-tsv")
    K.write_vectors_tsv(x, out)
    back = spark.read.text(f"{out}/vectors")
    # a line has one number more than tabs; cut into pieces it would be an array as long as the vocabulary
    tabs = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\t")))
    return back.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(tabs + 1).cast("long").alias("n_values"))


def _s3_folds() -> tuple:
    return (FX.SQL_REPORTS, "x AS (SELECT r.report_id, r.label, md5('0-' || CAST(r.report_id AS VARCHAR)) AS h FROM reports r)",
            "cnt AS (SELECT label, count(*) AS n FROM x GROUP BY ALL)",
            "off AS (SELECT label, sum(n) OVER (ORDER BY label) - n AS o FROM cnt)",
            "fo AS (SELECT x.*, CAST((off.o + row_number() OVER (PARTITION BY x.label ORDER BY x.h, x.report_id) - 1) % 5 AS INT) "
            "AS outer_fold FROM x JOIN off USING (label))")


@register("s3_vectors_sparse", W(*_s3_folds(),
                                 "w AS (SELECT d.doc_id AS report_id, unnest(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_]{2,}')) AS term "
                                 "FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id)",
                                 "tf AS (SELECT report_id, term, count(*) AS tf FROM w GROUP BY ALL)",
                                 "nd AS (SELECT count(*) AS n_docs FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id)",
                                 "vo AS (SELECT term, df, n_docs, row_number() OVER (ORDER BY term) - 1 AS idx FROM "
                                 "(SELECT term, count(*) AS df FROM tf GROUP BY term), nd WHERE df >= 2 AND df <= 0.9 * n_docs)",
                                 "wt AS (SELECT report_id, idx, tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS x FROM tf JOIN vo USING (term))",
                                 "nw AS (SELECT report_id, idx, x / sqrt(sum(x * x) OVER (PARTITION BY report_id)) AS x FROM wt)") +
          "SELECT outer_fold, CAST(idx AS INT) AS idx, count(*) AS n, round(sum(nw.x), 6) AS total FROM nw JOIN fo USING (report_id) GROUP BY ALL")
def s3_vectors_sparse(spark, sf_dir):
    """Vectors of the labelled reports (single words, no cap) as index:value lines, read back and added
    up by fold and index."""
    from ..operators import features as FE
    from ..operators import splits as SP
    from ..session import cut_lineage
    from .q_features import labelled_docs
    docs = labelled_docs(spark, sf_dir)
    members = docs.select(F.lit(0).alias("split_id"), "report_id")
    terms = cut_lineage(FE.doc_terms(docs, "text", 1))
    v = cut_lineage(FE.numbered_vocabulary(FE.vocabulary(terms, members, pvs=None)))
    vec = FE.sparse_vectors(FE.indexed_weights(terms, members, v), members, v.count())
    rep = SP.with_realizations(FX.reports(spark, sf_dir).select("report_id", "label"), 1)
    folds = SP.stratified_fold(rep, 5, [F.col("realization")], group_cols=["realization"], out_col="outer_fold")
    out = scratch_path(spark, "vectors-sparse")
    K.write_vectors_tsv(vec.join(folds.select("report_id", "label", "outer_fold"), "report_id"), out, layout="sparse")
    entries = F.transform(F.filter(F.split("value", "\t"), lambda e: e != ""), lambda e: F.split(e, ":"))
    back = spark.read.text(f"{out}/vectors").select("outer_fold", F.explode(entries).alias("e"))
    return back.groupBy("outer_fold", F.col("e")[0].cast("int").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("e")[1].cast("double")), 6).alias("total"))


@register("s6_explanations_sink", FX.with_ctes(FX.SQL_PRED, FX.SQL_EXPLANATIONS) + """
SELECT CASE WHEN p.y_true = 1 AND p.votes * 2 > 51 THEN 'TP' WHEN p.y_true = 0 AND p.votes * 2 > 51 THEN 'FP'
            WHEN p.y_true = 0 THEN 'TN' ELSE 'FN' END AS outcome, 'tf_idf' AS embedding,
       e.report_id, e.word, e.weight, CAST(e.rank AS INT) AS rank
FROM explanations e JOIN pred p ON p.report_id = e.report_id AND p.embedding = 'tf_idf' AND p.realization = 0""")
def s6_explanations_sink(spark, sf_dir):
    """Explanations written in folders by outcome and embedding, read back."""
    from ..operators.explain import outcome
    p = FX.pred(spark, sf_dir).where((F.col("embedding") == "tf_idf") & (F.col("realization") == 0))
    o = p.select("report_id", outcome(F.col("y_true"), F.when(F.col("votes") * 2 > 51, 1).otherwise(0)).alias("outcome"))
    e = FX.explanations(spark, sf_dir).join(o, "report_id").withColumn("embedding", F.lit("tf_idf"))
    root = scratch_path(spark, "explanations")
    K.write_explanations(e, root)
    back = spark.read.parquet(root)
    return back.select("outcome", "embedding", "report_id", "word", "weight", F.col("rank").cast("int"))
