"""Label extraction and its run-time guards."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.sources.readers import REPORT_SCHEMA


def _reports(spark, entries):
    rows = [(1, "x", {"classificationResult": entries})]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def test_last_classification_entry_wins(spark):
    df = _reports(spark, [{"label": "Classification", "classes": [" Global_unknown"]},
                          {"label": "Other", "classes": [" Global_stable"]},
                          {"label": "Classification", "classes": ["x", " Global_progression"]}])
    assert L.extract_labels(df).first()["label"] == 2


def test_two_global_classes_fail(spark):
    df = _reports(spark, [{"label": "Classification", "classes": [" Global_stable", " Global_response"]}])
    with pytest.raises(Exception, match="Only one value"):
        L.extract_labels(df).collect()


def test_missing_classification_fails(spark):
    df = _reports(spark, [{"label": "Other", "classes": [" Global_stable"]}])
    with pytest.raises(Exception, match="not found"):
        L.extract_labels(df).collect()


def test_unknown_global_value_fails(spark):
    df = _reports(spark, [{"label": "Classification", "classes": ["Global_stable"]}])
    with pytest.raises(Exception, match="global label not found"):
        L.extract_labels(df).collect()


def test_nulls_refused(spark):
    df = spark.createDataFrame([(1, None)], "report_id long, content string")
    with pytest.raises(ValueError):
        L.require_no_nulls(df, ["content"])


def test_combo_key_round_trip(spark):
    df = spark.createDataFrame([(3, None, 0.8), (5, 0.9, 1.0)], "n_gram int, pvs double, mf double")
    k = df.select(L.tfidf_combo_key(F.col("n_gram"), F.col("pvs"), F.col("mf")).alias("k"))
    assert [r.k for r in k.collect()] == ["ngram3_pvsNone_mf0.8", "ngram5_pvs0.9_mf1.0"]
    back = k.select(*L.parse_tfidf_key(F.col("k"))).collect()
    assert [(r.n_gram, r.pvs, r.mf) for r in back] == [(3, None, 0.8), (5, 0.9, 1.0)]
