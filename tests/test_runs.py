"""Whole nested cross-validation run on the smallest data (properties only:
forest scores are not SQL-checkable)."""
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.config import RunConfig
from tessera.operators import forest as RF
from tessera.operators import splits as SP
from tessera.plans import fixtures as FX
from tessera.plans import runs as RN
from tessera.plans.ledger import RunFolder
from tessera.session import cut_lineage
from tessera.sources import sinks as K

from .conftest import SF_SMALL


def test_tfidf_run_properties(spark):
    cfg = RunConfig(realizations=1, outer_folds=3, inner_folds=2, n_trees=5, max_depth=4, ngrams=(2,),
                    pvs=(0.9, None), max_features=(0.8, 1.0), concurrent_fits=4)
    rep = FX.reports(spark, SF_SMALL)
    r = RN.tfidf_run(spark, rep, cfg)
    p = r.predictions
    assert p.groupBy("realization", "report_id").count().where("count > 1").count() == 0
    assert r.val_scores.count() == 3 * 2 * 4
    assert p.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    # tested rows are exactly the pure test rows of the binary task
    f = SP.binary_task(SP.outer_folds(rep, 1, 3)).where(F.col("pure"))
    assert p.count() == f.count()
    assert r.summary.count() == 1 and r.best_outer.count() == 3


SMALL = RunConfig(realizations=1, outer_folds=3, inner_folds=2, n_trees=3, max_depth=3, ngrams=(1, 2),
                  pvs=(0.5,), max_features=(0.8,), concurrent_fits=2, run_date="Jun_19_2021")


def _rows(r):
    p = sorted((x.outer_fold, x.report_id, x.y_true, x.y_pred, x.score) for x in r.predictions.collect())
    v = sorted((x.outer_fold, x.inner_fold, x.seq, x.n_gram, x.pvs, x.mf, x.f1) for x in r.val_scores.collect())
    return p, v


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    rep = cut_lineage(FX.reports(spark, SF_SMALL))
    whole = _rows(RN.tfidf_run(spark, rep, SMALL))
    fit, calls = RF.fit_many, []

    def counted(stop):
        def run(*args):
            if len(calls) >= stop:
                raise RuntimeError("stopped")
            calls.append(1)
            return fit(*args)
        return run

    folder = str(tmp_path / "run")
    monkeypatch.setattr(RF, "fit_many", counted(5))
    with pytest.raises(RuntimeError, match="stopped"):          # inside the 12 inner fits
        RN.tfidf_run(spark, rep, SMALL, run_dir=folder)
    committed = len([x for x in (tmp_path / "run" / "scores").iterdir() if (x / "_SUCCESS").exists()])
    assert 1 <= committed <= 5
    calls.clear()
    monkeypatch.setattr(RF, "fit_many", counted(12 - committed + 2))
    with pytest.raises(RuntimeError, match="stopped"):          # inside the 3 outer fits
        RN.tfidf_run(spark, rep, SMALL, run_dir=folder)
    assert len(calls) == 12 - committed + 2
    calls.clear()
    monkeypatch.setattr(RF, "fit_many", counted(99))
    resumed = RN.tfidf_run(spark, rep, SMALL, run_dir=folder)
    assert 1 <= len(calls) <= 3                                 # only the outer fits that were not committed
    assert _rows(resumed) == whole
    calls.clear()
    assert _rows(RN.tfidf_run(spark, rep, SMALL, run_dir=folder)) == whole and not calls
    assert not (tmp_path / "run" / "work").exists()
    with pytest.raises(ValueError, match="another run"):
        RN.tfidf_run(spark, rep, replace(SMALL, n_trees=4), run_dir=folder)
    with pytest.raises(ValueError, match="another run"):
        RN.tfidf_run(spark, rep.where("report_id > 3"), SMALL, run_dir=folder)


def test_scores_are_those_of_the_stored_validation_predictions(spark):
    r = RN.tfidf_run(spark, FX.reports(spark, SF_SMALL), SMALL)
    p = {}
    for x in r.validation.collect():
        p.setdefault((x.outer_fold, x.inner_fold, x.seq), []).append((x.y_true, x.y_pred))
    for x in r.val_scores.collect():
        rows = p[x.outer_fold, x.inner_fold, x.seq]
        tp, wrong = sum(a * b for a, b in rows), sum(a != b for a, b in rows)
        assert x.f1 == pytest.approx(2 * tp / (2 * tp + wrong) if tp else 0.0)


def test_writing_a_run_again_leaves_one_set_of_rows(spark, tmp_path):
    rows = spark.createDataFrame([("tf_idf", "d1", 0, 1), ("tf_idf", "d1", 1, 2), ("d2v", "d1", 0, 3)],
                                 "embedding string, run_date string, realization int, report_id long")
    for _ in range(2):
        K.write_run_results(rows, str(tmp_path / "s4"))
    K.write_run_results(rows.where("realization = 1").withColumn("report_id", F.lit(7).cast("long")), str(tmp_path / "s4"))
    assert sorted(r.report_id for r in spark.read.parquet(str(tmp_path / "s4")).collect()) == [1, 3, 7]
    expl = spark.createDataFrame([("TP", "tf_idf", "w"), ("FN", "tf_idf", "v")], "outcome string, embedding string, word string")
    for _ in range(2):
        K.write_explanations(expl, str(tmp_path / "s6"))
    assert spark.read.parquet(str(tmp_path / "s6")).count() == 2


def test_a_split_reads_its_own_folder(spark, tmp_path):
    rows = [(s, f"w{i}", 1.0, i) for s in range(4) for i in range(5)]
    run = RunFolder(spark, "vocabularies", str(tmp_path / "run"))
    vocab = run.once("vocab", lambda: spark.createDataFrame(rows, "split_id int, term string, idf double, idx int"), ["split_id"])
    assert run.once("vocab", lambda: 1 / 0, ["split_id"]).count() == 20
    one = vocab.where(F.col("split_id") == 2)
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*split_id", plan) and one.count() == 5


def test_unknown_embedding_is_refused(spark):
    with pytest.raises(ValueError, match="embedding"):
        RN.curve_run(spark, "/nowhere", {"bag": "Jun_19_2021"})


def test_epoch_order_is_not_one_task(spark):
    from tessera.plans.q_embed import e11_epoch_order
    plan = e11_epoch_order(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Coalesce 1" not in plan and "Repartition 1, false" not in plan


def test_queries_of_whole_runs_take_the_library_settings(spark, monkeypatch):
    """The summary and the ROC band over realizations are of all 10 of them, 5/5 folds, 501 trees and the whole
    grid, not of a part; a band of one realization would have no spread."""
    from tessera.plans import q_embed, q_models
    rows = [("tf_idf", r, i, int(i % 2), (i % 2) * 0.3 + ((i * 7 + r * 3) % 10) / 20) for r in range(10) for i in range(40)]
    pred = spark.createDataFrame(rows, "embedding string, realization int, report_id long, y_true int, score double")
    asked = []

    def run(kind):
        def of(spark, reports, cfg=None, **more):
            asked.append((kind, cfg, more))
            return RN.RunResult(pred, *["x"] * 5, summary=kind)
        return of

    monkeypatch.setattr(RN, "tfidf_run", run("tfidf"))
    monkeypatch.setattr(RN, "d2v_run", run("d2v"))
    monkeypatch.setattr(q_models, "_MEMO", {})
    assert q_models.m12_tfidf_run_summary(spark, SF_SMALL) == "tfidf" and q_embed.m12_d2v_run_summary(spark, SF_SMALL) == "d2v"
    band = q_models.m12_tfidf_run_roc_band(spark, SF_SMALL)
    assert band.where("std > 0").count() > 0
    assert asked == [("tfidf", RunConfig(), {}), ("d2v", RunConfig(), {})]          # one run for the two queries of TF-IDF
    cfg = asked[0][1]
    assert (cfg.realizations, cfg.outer_folds, cfg.inner_folds, cfg.n_trees, cfg.max_depth) == (10, 5, 5, 501, 30)
    assert (cfg.ngrams, cfg.pvs, cfg.max_features, cfg.d2v_sizes, cfg.d2v_epochs) == ((3, 4, 5), (0.9, None), (0.8, 1.0), (10, 30, 50), 100)
