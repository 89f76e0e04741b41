"""Queries for evaluation (G*) and tuning selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RF_MAX_FEATURES, TFIDF_NGRAMS, TFIDF_PVS
from ..operators import curves as CV
from ..operators import metrics as MT
from ..operators import tuning as TU
from . import fixtures as FX
from .catalog import register

W = FX.with_ctes
K = ["embedding", "realization"]


def scored(spark, sf_dir):
    """Pooled predictions: score = votes (monotone in votes/51), y_pred = votes/51 > 0.5."""
    p = FX.pred(spark, sf_dir)
    return p.select("embedding", "realization", "report_id", "y_true",
                    F.col("votes").alias("score"),
                    F.when(F.col("votes") * 2 > 51, 1).otherwise(0).alias("y_pred"))


SQL_SCORED = W(FX.SQL_PRED, "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
               "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)")

SQL_COUNTS = ("s AS (SELECT embedding, realization, score, CAST(sum(y_true) AS BIGINT) AS p, "
              "CAST(sum(1 - y_true) AS BIGINT) AS n FROM scored GROUP BY ALL)",
              "c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER g AS np, "
              "sum(n) OVER g AS nn, row_number() OVER o AS k FROM s "
              "WINDOW w AS (PARTITION BY embedding, realization ORDER BY score DESC ROWS UNBOUNDED PRECEDING), "
              "g AS (PARTITION BY embedding, realization), "
              "o AS (PARTITION BY embedding, realization ORDER BY score DESC))")

SQL_ROC_PTS = SQL_COUNTS + (
    "d AS (SELECT *, lead(fp) OVER o - 2 * fp + lag(fp) OVER o AS dfp, lead(tp) OVER o - 2 * tp + lag(tp) OVER o AS dtp, "
    "(lag(tp) OVER o IS NULL OR lead(tp) OVER o IS NULL) AS fl FROM c "
    "WINDOW o AS (PARTITION BY embedding, realization ORDER BY score DESC))",
    "pts AS (SELECT embedding, realization, k, fp, tp, np, nn FROM d WHERE fl OR dfp <> 0 OR dtp <> 0 "
    "UNION ALL SELECT embedding, realization, 0, 0, 0, max(np), max(nn) FROM c GROUP BY embedding, realization)",
    "roc AS (SELECT embedding, realization, CAST(row_number() OVER (PARTITION BY embedding, realization ORDER BY k) - 1 AS INT) AS seq, "
    "fp / nn AS fpr, tp / np AS tpr FROM pts)")

SQL_PR_PTS = SQL_COUNTS + (
    "pr AS (SELECT embedding, realization, CAST(k AS INT) AS seq, tp / np AS recall, "
    "coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision FROM c "
    "UNION ALL SELECT DISTINCT embedding, realization, 0, 0.0, 1.0 FROM c)",)

SQL_AUC = SQL_COUNTS + (
    "auc AS (SELECT embedding, realization, sum((fp - fp0) * (tp + tp0)) / (2.0 * max(np) * max(nn)) AS auc "
    "FROM (SELECT *, coalesce(lag(tp) OVER o, 0) AS tp0, coalesce(lag(fp) OVER o, 0) AS fp0 FROM c "
    "WINDOW o AS (PARTITION BY embedding, realization ORDER BY score DESC)) GROUP BY ALL)",
    "aupr AS (SELECT embedding, realization, sum((tp - tp0) * (prec + prec0)) / (2.0 * max(np)) AS aupr "
    "FROM (SELECT *, coalesce(lag(tp) OVER o, 0) AS tp0, coalesce(lag(prec) OVER o, 1.0) AS prec0 "
    "FROM (SELECT *, tp / (tp + fp) AS prec FROM c) WINDOW o AS (PARTITION BY embedding, realization ORDER BY score DESC)) "
    "GROUP BY ALL)")

SQL_BIN = ("bc AS (SELECT embedding, realization, CAST(count_if(y_true = 1 AND y_pred = 1) AS BIGINT) AS tp, "
           "CAST(count_if(y_true = 0 AND y_pred = 1) AS BIGINT) AS fp, CAST(count_if(y_true = 0 AND y_pred = 0) AS BIGINT) AS tn, "
           "CAST(count_if(y_true = 1 AND y_pred = 0) AS BIGINT) AS fn FROM scored GROUP BY ALL)",
           "bm AS (SELECT embedding, realization, tp, fp, tn, fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, "
           "coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, tn / nullif(tn + fp, 0) AS specificity, "
           "coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, tn / nullif(tn + fn, 0) AS npv, "
           "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM bc)")


def _interp_sql(src: str, x: str, y: str, first: str, last_mean: str | None) -> tuple[str, ...]:
    """DuckDB text of the band: segments by lead, range join with a 100-row grid."""
    mean = "avg(gy)" if last_mean is None else f"CASE WHEN i = 99 THEN {last_mean} ELSE avg(gy) END"
    return (
        f"seg AS (SELECT embedding, realization, {x} AS x0, {y} AS y0, "
        f"lead({x}) OVER o AS x1, lead({y}) OVER o AS y1, row_number() OVER o = 1 AS is_first FROM {src} "
        "WINDOW o AS (PARTITION BY embedding, realization ORDER BY seq))",
        "grid AS (SELECT range AS i, CASE WHEN range = 99 THEN 1.0 ELSE range * (1.0 / 99) END AS gx FROM range(100))",
        "it AS (SELECT s.embedding, s.realization, g.i, g.gx, "
        f"CASE WHEN g.i = 0 THEN {first} WHEN s.x1 IS NULL OR g.gx < s.x0 THEN s.y0 "
        "ELSE s.y0 + (s.y1 - s.y0) * (g.gx - s.x0) / (s.x1 - s.x0) END AS gy "
        "FROM seg s JOIN grid g ON (s.x1 IS NULL AND g.gx >= s.x0) OR (s.x1 > s.x0 AND g.gx >= s.x0 AND g.gx < s.x1) "
        "OR (s.is_first AND g.gx < s.x0))",
        f"bd AS (SELECT embedding, CAST(i AS INT) AS i, first(gx) AS x, {mean} AS mean, stddev_pop(gy) AS std "
        "FROM it GROUP BY embedding, i)")


BAND_SELECT = ("SELECT embedding, i, x, mean, std, least(mean + std, 1.0) AS upper, "
               "greatest(mean - std, 0.0) AS lower FROM bd")


@register("g1_confusion_matrix", SQL_SCORED + """,
cells AS (SELECT k.embedding, k.realization, t.t AS true_label, p.p AS pred_label
          FROM (SELECT DISTINCT embedding, realization FROM scored) k
          CROSS JOIN (VALUES (0), (1)) t(t) CROSS JOIN (VALUES (0), (1)) p(p))
SELECT c.embedding, c.realization, c.true_label, c.pred_label, count(s.report_id) AS n
FROM cells c LEFT JOIN scored s ON s.embedding = c.embedding AND s.realization = c.realization
     AND s.y_true = c.true_label AND s.y_pred = c.pred_label GROUP BY ALL""")
def g1_confusion_matrix(spark, sf_dir):
    return MT.confusion_matrix(scored(spark, sf_dir), K)


@register("g2_binary_metrics", SQL_SCORED + ",\n" + ",\n".join(SQL_BIN) + "\nSELECT * FROM bm")
def g2_binary_metrics(spark, sf_dir):
    return MT.binary_metrics(scored(spark, sf_dir), K)


def _multi(spark, sf_dir):
    r = FX.reports(spark, sf_dir)
    h = FX._h(F.lit("m"), F.col("report_id"))
    return r.select("report_id", F.col("label").alias("y_true"),
                    ((F.col("label") + F.when(h % 5 == 0, 1).when(h % 7 == 0, 2).otherwise(0)) % 4)
                    .cast("int").alias("y_pred"))


@register("g3_weighted_metrics", W(FX.SQL_REPORTS, f"""m AS (SELECT report_id, label AS y_true,
  CAST((label + CASE WHEN {FX.H(FX._key("'m'", 'report_id'))} % 5 = 0 THEN 1
                     WHEN {FX.H(FX._key("'m'", 'report_id'))} % 7 = 0 THEN 2 ELSE 0 END) % 4 AS INT) AS y_pred FROM reports)""",
    "t AS (SELECT y_true AS cls, count(*) AS support, CAST(count_if(y_true = y_pred) AS BIGINT) AS tp FROM m GROUP BY 1)",
    "p AS (SELECT y_pred AS cls, count(*) AS predicted FROM m GROUP BY 1)",
    "j AS (SELECT t.*, coalesce(p.predicted, 0) AS predicted FROM t LEFT JOIN p USING (cls))") + """
SELECT sum(tp) / sum(support) AS accuracy, sum(tp) / sum(support) AS recall, NULL::DOUBLE AS specificity,
       sum(support * coalesce(tp / nullif(predicted, 0), 0.0)) / sum(support) AS precision, NULL::DOUBLE AS npv,
       sum(support * coalesce(2 * tp / nullif(support + predicted, 0), 0.0)) / sum(support) AS f1 FROM j""")
def g3_weighted_metrics(spark, sf_dir):
    return MT.weighted_metrics(_multi(spark, sf_dir), [])


@register("g4_roc_points", SQL_SCORED + ",\n" + ",\n".join(SQL_ROC_PTS) + "\nSELECT * FROM roc")
def g4_roc_points(spark, sf_dir):
    return CV.roc_points(scored(spark, sf_dir), K)


@register("g5_roc_auc", SQL_SCORED + ",\n" + ",\n".join(SQL_AUC) + "\nSELECT * FROM auc")
def g5_roc_auc(spark, sf_dir):
    return CV.roc_auc(scored(spark, sf_dir), K)


@register("g6_pr_points", SQL_SCORED + ",\n" + ",\n".join(SQL_PR_PTS) + "\nSELECT * FROM pr")
def g6_pr_points(spark, sf_dir):
    return CV.pr_points(scored(spark, sf_dir), K)


@register("g7_pr_auc", SQL_SCORED + ",\n" + ",\n".join(SQL_AUC) + "\nSELECT * FROM aupr")
def g7_pr_auc(spark, sf_dir):
    return CV.pr_auc(scored(spark, sf_dir), K)


def per_realization(spark, sf_dir):
    s = scored(spark, sf_dir)
    return (MT.binary_metrics(s, K).join(CV.roc_auc(s, K), K).join(CV.pr_auc(s, K), K))


def _g8_sql(select: str) -> str:
    ctes = [FX.SQL_PRED, "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
            "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)"]
    ctes += list(SQL_COUNTS) + list(SQL_AUC[2:]) + list(SQL_BIN)
    ctes.append("pm AS (SELECT * FROM bm JOIN auc USING (embedding, realization) JOIN aupr USING (embedding, realization))")
    ctes.append("summary AS (SELECT embedding, " + ", ".join(
        f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in MT.METRICS) + " FROM pm GROUP BY embedding)")
    return W(*ctes) + select


@register("g8_metric_summary", _g8_sql("SELECT * FROM summary"))
def g8_metric_summary(spark, sf_dir):
    return MT.summarize(per_realization(spark, sf_dir))


@register("g9_roc_band", W(FX.SQL_PRED,
                           "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
                           "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)",
                           *SQL_ROC_PTS, *_interp_sql("roc", "fpr", "tpr", "0.0", "1.0")) + BAND_SELECT)
def g9_roc_band(spark, sf_dir):
    return CV.roc_band_of(scored(spark, sf_dir))


@register("g10_pr_band", W(FX.SQL_PRED,
                           "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
                           "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)",
                           *SQL_PR_PTS, *_interp_sql("pr", "recall", "precision", "1.0", None)) + BAND_SELECT)
def g10_pr_band(spark, sf_dir):
    return CV.pr_band_of(scored(spark, sf_dir))


@register("g11_area_summary", _g8_sql("SELECT embedding, auc_mean, auc_std, aupr_mean, aupr_std FROM summary"))
def g11_area_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    return MT.summarize(CV.roc_auc(s, K).join(CV.pr_auc(s, K), K), metrics=("auc", "aupr"))


@register("g12_no_skill", W(FX.SQL_PRED) +
          "SELECT embedding, avg(p) AS no_skill FROM (SELECT embedding, realization, avg(y_true) AS p "
          "FROM pred GROUP BY ALL) GROUP BY embedding")
def g12_no_skill(spark, sf_dir):
    return CV.no_skill(FX.pred(spark, sf_dir))


@register("g13_compare_embeddings", W(FX.SQL_PRED,
                                      "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
                                      "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)",
                                      *SQL_ROC_PTS, *_interp_sql("roc", "fpr", "tpr", "0.0", "1.0")) +
          "SELECT i, max(CASE WHEN embedding = 'tf_idf' THEN mean END) AS tf_idf, "
          "max(CASE WHEN embedding = 'd2v' THEN mean END) AS d2v FROM bd GROUP BY i")
def g13_compare_embeddings(spark, sf_dir):
    return CV.compare_embeddings(g9_roc_band(spark, sf_dir))


@register("g14_report_lines", _g8_sql(
    "SELECT embedding, metric, text FROM (" + " UNION ALL ".join(
        f"SELECT embedding, '{m}' AS metric, printf('%.2f', round({m}_mean, 9)) || ' ± ' || printf('%.2f', round({m}_std, 9)) AS text "
        "FROM summary" for m in MT.METRICS) + ")"))
def g14_report_lines(spark, sf_dir):
    return MT.report_lines(g8_metric_summary(spark, sf_dir))


# --------------------------------------------------------------- tuning (M*)
@register("m4_grid_work_list", W(FX.SQL_VAL_SCORES) + "SELECT g.seq, g.n_gram, g.pvs, g.mf, count(*) AS n_fits "
          "FROM (SELECT DISTINCT realization, outer_fold, inner_fold FROM val_scores) f CROSS JOIN "
          + FX._grid_values() + " GROUP BY ALL")
def m4_grid_work_list(spark, sf_dir):
    """M4: the grid (nested-loop order) over every inner fold: the fits M5 runs."""
    folds = FX.val_scores(spark, sf_dir).select("realization", "outer_fold", "inner_fold").distinct()
    g = TU.grid(spark, n_gram=TFIDF_NGRAMS, pvs=TFIDF_PVS, mf=RF_MAX_FEATURES)
    arr = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in g.columns]) for r in g.collect()])
    work = folds.select(F.explode(arr).alias("g")).select("g.*")
    return work.groupBy("seq", "n_gram", F.col("pvs").cast("double").alias("pvs"),
                        F.col("mf").cast("double").alias("mf")).agg(F.count(F.lit(1)).alias("n_fits"))


_PARAMS = ["n_gram", "pvs", "mf"]
_INNER = ["realization", "outer_fold", "inner_fold"]

SQL_M6 = ("m6 AS (SELECT realization, outer_fold, inner_fold, seq, n_gram, pvs, mf, f1 FROM ("
          "SELECT *, row_number() OVER (PARTITION BY realization, outer_fold, inner_fold ORDER BY f1 DESC, seq) AS rn "
          "FROM val_scores) WHERE rn = 1)")
SQL_M7 = ("m7 AS (SELECT realization, outer_fold, seq, n_gram, pvs, mf, n, best_f1 FROM ("
          "SELECT *, row_number() OVER (PARTITION BY realization, outer_fold ORDER BY n DESC, best_f1 DESC, first_fold) AS rn FROM ("
          "SELECT realization, outer_fold, seq, n_gram, pvs, mf, count(*) AS n, max(f1) AS best_f1, "
          "min(CASE WHEN f1 = hf THEN inner_fold END) AS first_fold FROM ("
          "SELECT *, max(f1) OVER (PARTITION BY realization, outer_fold, seq) AS hf FROM m6) "
          "GROUP BY realization, outer_fold, seq, n_gram, pvs, mf)) WHERE rn = 1)")


def _mode_sql(src: str, keys: str, order: str) -> str:
    """Most frequent value per (keys, param), first seen on ties."""
    long = " UNION ALL ".join(
        f"SELECT {keys}{', ' if keys else ''}{order}, '{p}' AS param, coalesce(CAST({p} AS VARCHAR), 'None') AS value FROM {src}"
        for p in _PARAMS)
    part = f"{keys}, param" if keys else "param"
    return (f"SELECT {part}, value, n FROM (SELECT {part}, value, count(*) AS n, "
            f"row_number() OVER (PARTITION BY {part} ORDER BY count(*) DESC, min({order})) AS rn "
            f"FROM ({long}) GROUP BY {part}, value) WHERE rn = 1")


@register("m6_best_per_inner_fold", W(FX.SQL_VAL_SCORES, SQL_M6) + "SELECT * FROM m6")
def m6_best_per_inner_fold(spark, sf_dir):
    return TU.best_per_inner_fold(FX.val_scores(spark, sf_dir), _INNER, _PARAMS)


@register("m7_best_per_outer_fold", W(FX.SQL_VAL_SCORES, SQL_M6, SQL_M7) + "SELECT * FROM m7")
def m7_best_per_outer_fold(spark, sf_dir):
    return TU.best_per_outer_fold(m6_best_per_inner_fold(spark, sf_dir), ["realization", "outer_fold"],
                                  "inner_fold", _PARAMS)


@register("m8_mode_over_outer_folds", W(FX.SQL_VAL_SCORES, SQL_M6, SQL_M7) +
          _mode_sql("m7", "realization", "outer_fold"))
def m8_mode_over_outer_folds(spark, sf_dir):
    return TU.most_frequent_params(m7_best_per_outer_fold(spark, sf_dir), ["realization"], "outer_fold", _PARAMS)


@register("m9_mode_over_realizations", W(
    FX.SQL_VAL_SCORES, SQL_M6, SQL_M7,
    "m8 AS (SELECT realization, max(CASE WHEN param = 'n_gram' THEN value END) AS n_gram, "
    "max(CASE WHEN param = 'pvs' THEN value END) AS pvs, max(CASE WHEN param = 'mf' THEN value END) AS mf FROM ("
    + _mode_sql("m7", "realization", "outer_fold") + ") GROUP BY realization)") +
    _mode_sql("m8", "", "realization"))
def m9_mode_over_realizations(spark, sf_dir):
    m8 = m8_mode_over_outer_folds(spark, sf_dir)
    wide = m8.groupBy("realization").pivot("param", _PARAMS).agg(F.first("value"))
    return TU.most_frequent_params(wide, [], "realization", _PARAMS)


@register("m11_pooled_predictions", SQL_SCORED + " SELECT embedding, realization, count(*) AS n_pooled, "
          "CAST(sum(y_true) AS BIGINT) AS n_pos FROM scored GROUP BY ALL")
def m11_pooled_predictions(spark, sf_dir):
    """Predictions written fold by fold (S4) and pooled per realization when read back."""
    from ..session import scratch_path
    from ..sources import sinks as SK
    root = scratch_path(spark, "pooled")
    s = scored(spark, sf_dir).withColumn("outer_fold", (F.col("report_id") % 5).cast("int"))
    SK.write_run_results(s, root, ("embedding", "realization", "outer_fold"))
    return spark.read.parquet(root).groupBy(K).agg(
        F.count(F.lit(1)).alias("n_pooled"), F.sum("y_true").cast("long").alias("n_pos"))


@register("g13_curve_run", W(FX.SQL_PRED,
                             "scored AS (SELECT embedding, realization, report_id, y_true, votes AS score, "
                             "CASE WHEN votes * 2 > 51 THEN 1 ELSE 0 END AS y_pred FROM pred)",
                             *SQL_ROC_PTS, *_interp_sql("roc", "fpr", "tpr", "0.0", "1.0")) +
          "SELECT i, max(CASE WHEN embedding = 'tf_idf' THEN mean END) AS tf_idf, "
          "max(CASE WHEN embedding = 'd2v' THEN mean END) AS d2v FROM bd GROUP BY i")
def g13_curve_run(spark, sf_dir):
    """The curve run: predictions of both embeddings stored under their run dates, beside a run of another
    date that must not be read; bands and comparison."""
    from ..session import scratch_path
    from ..sources import sinks as SK
    from .runs import curve_run
    root = scratch_path(spark, "curve-run")
    s = scored(spark, sf_dir)
    date = F.when(F.col("embedding") == "tf_idf", "Jun_19_2021").otherwise("Jun_21_2021")
    SK.write_run_results(s.withColumn("run_date", date), root)
    SK.write_run_results(s.withColumn("score", -F.col("score")).withColumn("run_date", F.lit("Jan_01_2020")), root)
    return curve_run(spark, root, {"tf_idf": "Jun_19_2021", "d2v": "Jun_21_2021"})["compare"]
