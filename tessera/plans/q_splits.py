"""Queries for fold assignment (F*) and row gathering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as SP
from . import fixtures as FX
from .catalog import register

W = FX.with_ctes
R, K, KI = 2, 5, 3          # realizations, outer folds, inner folds (FIXTURES.md)


def fold_ctes(r: int = R, k: int = K, ki: int = KI) -> list[str]:
    """DuckDB text of F1/F2/F6 (fp) and F3 + inner repair (fip)."""
    return [
        FX.SQL_REPORTS,
        f"x AS (SELECT r.report_id, r.label, r.ipp, CAST(z.range AS INT) AS realization, "
        f"md5(CAST(z.range AS VARCHAR) || '-' || CAST(r.report_id AS VARCHAR)) AS h FROM reports r CROSS JOIN range({r}) z)",
        "cnt AS (SELECT realization, label, count(*) AS n FROM x GROUP BY ALL)",
        "off AS (SELECT realization, label, sum(n) OVER (PARTITION BY realization ORDER BY label) - n AS o FROM cnt)",
        f"fo AS (SELECT x.*, CAST((off.o + row_number() OVER (PARTITION BY x.realization, x.label "
        f"ORDER BY x.h, x.report_id) - 1) % {k} AS INT) AS test_fold FROM x JOIN off USING (realization, label))",
        "fp AS (SELECT fo.*, ipp IS NULL OR min(test_fold) OVER (PARTITION BY realization, ipp) = "
        "max(test_fold) OVER (PARTITION BY realization, ipp) AS pure FROM fo)",
        f"ro AS (SELECT fp.*, CAST(o.range AS INT) AS outer_fold, CASE WHEN fp.test_fold = o.range AND fp.pure "
        f"THEN 'test' ELSE 'train' END AS role FROM fp CROSS JOIN range({k}) o)",
        "tr AS (SELECT realization, outer_fold, report_id, label, ipp, md5(CAST(realization AS VARCHAR) || '-' || "
        "CAST(outer_fold AS VARCHAR) || '-' || CAST(report_id AS VARCHAR)) AS h FROM ro WHERE role = 'train')",
        "cnt2 AS (SELECT realization, outer_fold, label, count(*) AS n FROM tr GROUP BY ALL)",
        "off2 AS (SELECT realization, outer_fold, label, sum(n) OVER (PARTITION BY realization, outer_fold "
        "ORDER BY label) - n AS o FROM cnt2)",
        f"fi AS (SELECT tr.*, CAST((off2.o + row_number() OVER (PARTITION BY tr.realization, tr.outer_fold, tr.label "
        f"ORDER BY tr.h, tr.report_id) - 1) % {ki} AS INT) AS inner_fold FROM tr JOIN off2 USING (realization, outer_fold, label))",
        "fip AS (SELECT fi.*, ipp IS NULL OR min(inner_fold) OVER (PARTITION BY realization, outer_fold, ipp) = "
        "max(inner_fold) OVER (PARTITION BY realization, outer_fold, ipp) AS inner_pure FROM fi)",
    ]


def outer(spark, sf_dir, r=R):
    return SP.outer_folds(FX.reports(spark, sf_dir), r, K)


@register("f1_stratified_folds", W(*fold_ctes(1)) + "SELECT report_id, label, test_fold FROM fo")
def f1_stratified_folds(spark, sf_dir):
    rep = SP.with_realizations(FX.reports(spark, sf_dir).select("report_id", "label"), 1)
    f = SP.stratified_fold(rep, K, [F.col("realization")], group_cols=["realization"], out_col="test_fold")
    return f.select("report_id", "label", "test_fold")


@register("f2_repeated_folds", W(*fold_ctes()) + "SELECT realization, report_id, test_fold FROM fo")
def f2_repeated_folds(spark, sf_dir):
    return outer(spark, sf_dir).select("realization", "report_id", "test_fold")


@register("f4_patient_lookup", W(*fold_ctes()) + """,
t AS (SELECT DISTINCT f.realization, f.test_fold AS outer_fold, r.content FROM fo f JOIN reports r USING (report_id))
SELECT t.realization, t.outer_fold, coalesce(s.ipp, -1) AS ipp, count(*) AS n_rows
FROM reports s JOIN t ON s.content = t.content GROUP BY ALL""".replace("\n,", ",", 0))
def f4_patient_lookup(spark, sf_dir):
    """Patients of every fold's (unrepaired) test rows, looked up by text in
    the session table (here: the reports themselves as (report, ipp))."""
    rep = FX.reports(spark, sf_dir).select("report_id", F.sha2("content", 256).alias("key"), "ipp")
    fo = outer(spark, sf_dir).select("realization", F.col("test_fold").alias("outer_fold"), "report_id")
    hits = SP.patients_of(fo.join(rep.select("report_id", "key"), "report_id"), rep, ["realization", "outer_fold"])
    return hits.groupBy("realization", "outer_fold", F.coalesce("ipp", F.lit(-1)).alias("ipp")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("f5_shared_patients", W(*fold_ctes()) + """,
b AS (SELECT f.realization, CAST(o.range AS INT) AS outer_fold, f.ipp, f.test_fold = o.range AS is_test
      FROM fo f CROSS JOIN range(5) o WHERE f.ipp IS NOT NULL)
SELECT DISTINCT realization, outer_fold, ipp FROM b WHERE is_test
INTERSECT SELECT DISTINCT realization, outer_fold, ipp FROM b WHERE NOT is_test""")
def f5_shared_patients(spark, sf_dir):
    f = outer(spark, sf_dir).withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    test = f.where(F.col("test_fold") == F.col("outer_fold"))
    train = f.where(F.col("test_fold") != F.col("outer_fold"))
    return SP.shared_patients(train, test, ["realization", "outer_fold"])


@register("f6_leak_repair", W(*fold_ctes()) + "SELECT realization, outer_fold, report_id, role FROM ro")
def f6_leak_repair(spark, sf_dir):
    return SP.outer_roles(outer(spark, sf_dir), K).select("realization", "outer_fold", "report_id", "role")


@register("f3_inner_folds", W(*fold_ctes()) +
          "SELECT realization, outer_fold, report_id, inner_fold, inner_pure FROM fip")
def f3_inner_folds(spark, sf_dir):
    inner = SP.inner_folds(outer(spark, sf_dir), K, KI)
    return inner.select("realization", "outer_fold", "report_id", "inner_fold", "inner_pure")


@register("f7_split_table", W(*fold_ctes()) + f"""
SELECT realization, outer_fold, -1 AS inner_fold, report_id, role FROM ro
UNION ALL
SELECT realization, outer_fold, CAST(v.range AS INT) AS inner_fold, report_id,
       CASE WHEN inner_fold = v.range AND inner_pure THEN 'val' ELSE 'train' END AS role
FROM fip CROSS JOIN range({KI}) v""")
def f7_split_table(spark, sf_dir):
    f = outer(spark, sf_dir)
    return SP.split_table(f, SP.inner_folds(f, K, KI), K, KI)


@register("f8_row_stacking", W(*fold_ctes()) + """
SELECT realization, outer_fold, CAST(count_if(test_fold <> outer_fold) AS BIGINT) AS n_train_base,
       CAST(count_if(test_fold = outer_fold AND NOT pure) AS BIGINT) AS n_moved,
       CAST(count_if(role = 'train') AS BIGINT) AS n_train, CAST(count_if(role = 'test') AS BIGINT) AS n_test
FROM ro GROUP BY ALL""")
def f8_row_stacking(spark, sf_dir):
    ro = SP.outer_roles(outer(spark, sf_dir), K)
    c = lambda cond: F.count_if(cond)
    return ro.groupBy("realization", "outer_fold").agg(
        c(F.col("test_fold") != F.col("outer_fold")).alias("n_train_base"),
        c((F.col("test_fold") == F.col("outer_fold")) & ~F.col("pure")).alias("n_moved"),
        c(F.col("role") == "train").alias("n_train"), c(F.col("role") == "test").alias("n_test"))


@register("f8_stacked_rows", W(*fold_ctes()) +
          "SELECT realization, outer_fold, report_id, label, test_fold = outer_fold AS moved FROM ro WHERE role = 'train'")
def f8_stacked_rows(spark, sf_dir):
    """The training rows of every split, stacked."""
    ro = SP.outer_roles(outer(spark, sf_dir), K)
    return SP.stacked_training(ro).select("realization", "outer_fold", "report_id", "label", "moved")


@register("p7_gather_rows", W(*fold_ctes()) + """
SELECT ro.realization, ro.outer_fold, ro.role, ro.report_id,
       CAST(CASE WHEN ro.label = 2 THEN 1 ELSE ro.label END AS INT) AS y, md5(r.content) AS content_md5
FROM ro JOIN reports r USING (report_id) WHERE ro.label <> 3""")
def p7_gather_rows(spark, sf_dir):
    """Materialise the binary-task rows of every (realization, outer fold, role)
    by joining the split table to the reports on the key."""
    ro = SP.outer_roles(outer(spark, sf_dir), K).select("realization", "outer_fold", "role", "report_id", "label")
    # hash once per report: the text does not travel once per copy of its row
    hashed = FX.reports(spark, sf_dir).select("report_id", F.md5("content").alias("content_md5"))
    return SP.binary_task(ro).join(hashed, "report_id").select(
        "realization", "outer_fold", "role", "report_id", "y", "content_md5")
