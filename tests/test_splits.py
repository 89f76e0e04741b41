"""Fold properties: one base fold per row, balanced sizes, no
patient on both sides after repair, partition-count invariance."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import splits as SP
from tessera.plans import fixtures as FX

from .conftest import SF_CHECK


def test_fold_sizes_balanced_and_stratified(spark):
    f = SP.outer_folds(FX.reports(spark, SF_CHECK), 2, 5)
    sizes = f.groupBy("realization", "test_fold").count().groupBy("realization").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)
    per_class = f.groupBy("realization", "label", "test_fold").count().groupBy("realization", "label").agg(
        (F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in per_class)
    assert f.groupBy("realization", "report_id").count().where("count <> 1").count() == 0


def test_no_patient_on_both_sides(spark):
    f = SP.outer_folds(FX.reports(spark, SF_CHECK), 1, 5)
    ro = SP.outer_roles(f, 5)
    assert f.where("ipp IS NULL").count() > 0
    both = ro.where("ipp IS NOT NULL").groupBy("realization", "outer_fold", "ipp").agg(F.count_distinct("role").alias("k"))
    assert both.where("k > 1").count() == 0
    inner = SP.inner_roles(SP.inner_folds(f, 5, 3), 3)
    both = inner.where("ipp IS NOT NULL").groupBy("realization", "outer_fold", "val_fold", "ipp").agg(F.count_distinct("role").alias("k"))
    assert both.where("k > 1").count() == 0


def test_same_folds_for_any_partitioning(spark):
    rep = FX.reports(spark, SF_CHECK)
    a = SP.outer_folds(rep, 1, 5).select("report_id", "test_fold", "pure")
    b = SP.outer_folds(rep.repartition(13), 1, 5).select("report_id", "test_fold", "pure")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rows_in_rows_out_with_and_without_patients(spark):
    rep = FX.reports(spark, SF_CHECK)
    n = rep.count()
    f = SP.outer_folds(rep, 2, 5)
    assert f.count() == 2 * n and f.where("ipp IS NULL AND NOT pure").count() == 0
    nobody = rep.withColumn("ipp", F.lit(None).cast("long"))
    g = SP.outer_folds(nobody, 1, 5)
    assert g.count() == n and g.where("NOT pure").count() == 0
    tested = SP.outer_roles(g, 5).where("role = 'test'")
    assert tested.count() == n          # without patients every row is tested exactly once


def test_null_label_is_refused(spark):
    rep = spark.createDataFrame([(1, 0, 1), (2, None, 1)], "report_id long, label int, ipp long")
    with pytest.raises(Exception, match="label is NULL in row 2"):
        SP.outer_folds(rep, 1, 2).count()
