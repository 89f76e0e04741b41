"""Per-split vocabularies by complement equal the direct per-split join."""
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.config import RunConfig
from tessera.operators import features as FE
from tessera.operators import splits as SP
from tessera.plans import fixtures as FX
from tessera.plans import runs as RN
from tessera.session import cut_lineage

from .conftest import SF_SMALL


def _direct(dterms, members, cap):
    """Every split's vocabulary by a plain join; ``members``: (split_id, report_id, n_gram)."""
    n = {r["split_id"]: r["c"] for r in members.groupBy("split_id").agg(F.count("*").alias("c")).collect()}
    stats = (dterms.join(members, "report_id").where("n <= n_gram").groupBy("split_id", "term")
             .agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).collect())
    out = {}
    for s in n:
        rows = sorted((-r["ctf"], r["term"], r["df"]) for r in stats
                      if r["split_id"] == s and 2 <= r["df"] <= 0.9 * n[s])
        kept = sorted(t for _, t, _ in (rows if cap(s) is None else rows[:cap(s)]))
        df = {t: d for _, t, d in rows}
        out[s] = [(i, t, round(math.log((1 + n[s]) / (1 + df[t])) + 1, 9)) for i, t in enumerate(kept)]
    return out


@pytest.fixture(scope="module")
def parts(spark):
    rep = FX.reports(spark, SF_SMALL)
    folds = SP.outer_folds(rep, 1, 3)
    inner = SP.inner_folds(folds, 3, 2)
    docs = SP.binary_task(rep).select("report_id", F.col("content").alias("clean_text"))
    return folds, inner, cut_lineage(FE.doc_terms(docs, "clean_text", 2))


def _grouped(v):
    out = {}
    for r in v.collect():
        out.setdefault(r["split_id"], []).append((r["idx"], r["term"], round(r["idf"], 9)))
    return {s: sorted(x) for s, x in out.items()}


def test_heldout_vocabularies_equal_direct(spark, parts):
    _, inner, dterms = parts
    cfg = RunConfig(realizations=1, outer_folds=3, inner_folds=2)
    splits = [(0, o, v, n, p) for o in range(3) for v in range(2) for n, p in ((2, 0.05), (1, None))]
    combos = spark.createDataFrame([(*s, i) for i, s in enumerate(splits)],
                                   "realization int, outer_fold int, fold int, n_gram int, pvs double, split_id int")
    universe = SP.binary_task(inner).select("realization", "outer_fold", "report_id",
                                            RN.held_fold("inner_fold", "inner_pure"))
    held = RN.heldout_vocabularies(dterms, universe, ["realization", "outer_fold"], 2, combos, 5000, cfg)
    roles = SP.binary_task(SP.inner_roles(inner, 2)).where("role = 'train'").withColumnRenamed("val_fold", "fold")
    members = roles.join(combos, ["realization", "outer_fold", "fold"]).select("split_id", "report_id", "n_gram")
    want = _direct(dterms, members, lambda s: 250 if splits[s][-1] else None)
    assert _grouped(held) == want and any(want.values())


def test_train_vocab_scope_caps_by_split_unigrams(spark, parts):
    folds, _, dterms = parts
    cfg = replace(RunConfig(realizations=1, outer_folds=3), vocab_scope="train")
    universe = SP.binary_task(folds).select("realization", "report_id", RN.held_fold("test_fold", "pure"))
    combos = spark.createDataFrame([(0, f, 1, 0.05, f) for f in range(3)],
                                   "realization int, fold int, n_gram int, pvs double, split_id int")
    v = _grouped(RN.heldout_vocabularies(dterms, universe, ["realization"], 3, combos, 10 ** 9, cfg))
    for f in range(3):
        train = universe.where(F.col("fold") != f).select("report_id")
        words = dterms.where("n = 1").join(train, "report_id").select("term").distinct().count()
        assert len(v[f]) == int(words * 0.05 + 0.5)


def test_cap_ranks_ties_without_one_task_per_tie(spark):
    rows = [(0, f"w{i:05d}", 2, 2) for i in range(3000)] + [(0, "top", 2, 9), (1, "only", 3, 3)]
    pruned = spark.createDataFrame(rows, "split_id int, term string, df long, ctf long")
    got = sorted((r["split_id"], r["term"]) for r in FE.cap_vocabulary(pruned, 1001).collect())
    assert got == sorted([(0, "top"), (1, "only")] + [(0, f"w{i:05d}") for i in range(1000)])
    n = FE.numbered_vocabulary(pruned).collect()
    assert sorted((r["split_id"], r["idx"], r["term"]) for r in n) == sorted(
        [(0, i, t) for i, t in enumerate(sorted(r[1] for r in rows if r[0] == 0))] + [(1, 0, "only")])


def test_vectors_of_members_without_terms(spark):
    terms = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 1), (2, "z", 1, 1)], "report_id long, term string, n int, tf long")
    vocab = spark.createDataFrame([(0, "a", 1.0, 0), (0, "b", 2.0, 1)], "split_id int, term string, idf double, idx int")
    members = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "split_id int, report_id long")
    got = {r.report_id: r.features.toArray().tolist()
           for r in FE.sparse_vectors(FE.indexed_weights(terms, members, vocab), members, 2).collect()}
    assert got[2] == got[3] == [0.0, 0.0] and got[1] == pytest.approx([0.5 ** 0.5] * 2)


def test_norm_is_summed_once_a_vector(spark):
    """The sum of squares stands outside the lambda over the entries, also after optimisation."""
    w = spark.createDataFrame([(1, 0, 3.0), (1, 2, 4.0)], "report_id long, idx int, weight double")
    m = spark.createDataFrame([(1,), (2,)], "report_id long")
    rows = FE.sparse_rows(w, m, 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "weight / SQRT(" not in plan and plan.count("SQRT(aggregate(") == 1
    got = {r["report_id"]: r["features"] for r in rows.collect()}
    assert got[1]["indices"] == [0, 2] and got[1]["values"] == [0.6, 0.8] and got[2]["values"] == []


def test_terms_outside_the_vocabulary_stay_where_they_are(spark):
    """No known term is lost before the join, few unknown ones pass, and split and bits matter."""
    vocab = cut_lineage(spark.range(3000).select((F.col("id") % 2).cast("int").alias("split_id"),
                                                 F.concat(F.lit("t"), "id").alias("term"), F.lit(1.5).alias("idf")))
    rows = spark.range(40000).select((F.col("id") % 2).cast("int").alias("split_id"), F.col("id").alias("report_id"),
                                     F.concat(F.lit("t"), "id").alias("term"))
    left = FE.maybe_known(rows, vocab, 3000)
    assert left.columns == rows.columns
    ids = {r["report_id"] for r in left.collect()}
    assert set(range(3000)) <= ids and len(ids) < 3000 + 37000 // 8
    swapped = FE.maybe_known(rows.withColumn("split_id", 1 - F.col("split_id")), vocab, 3000)
    assert swapped.count() < 40000 // 8
    assert FE.maybe_known(rows, vocab, FE.FILTER_BITS) is rows
    assert FE.maybe_known(rows, vocab.limit(0), 0).count() == 0


def test_weights_move_known_terms_only(spark):
    terms = spark.createDataFrame([(i, t, 1, 1 + i % 2) for i in range(40) for t in ("all", f"own{i}", f"pair{i // 2}")],
                                  "report_id long, term string, n int, tf long")
    members = terms.select(F.lit(0).alias("split_id"), "report_id").distinct()
    vocab = cut_lineage(FE.vocabulary(terms, members, max_df=1.0))
    found = {(r["report_id"], r["term"]): r["tfidf"] for r in FE.tfidf_weights(terms, members, vocab).collect()}
    assert set(found) == {(i, t) for i in range(40) for t in ("all", f"pair{i // 2}")}
    x, y = 1.0, math.log(41 / 3) + 1
    assert all(abs(v - (x if t == "all" else y) / math.hypot(x, y)) < 1e-12 for (_, t), v in found.items())
    plan = FE.tfidf_weights(terms, members, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_no_query_writes_its_table_of_ngrams(spark, monkeypatch):
    """Written, the n-grams of the reports are ten times their texts; the vocabularies alone are stored, and of the
    single forests' terms those that may be in one of the small vocabularies."""
    from tessera.plans import q_features as QF
    from tessera.plans import q_models as QM
    written = []

    def noted(df, cut=QF.cut_lineage):
        written.append(out := cut(df))
        return out

    class Enough(Exception):
        pass

    def enough(*_):
        raise Enough

    for module in (QF, QM):
        monkeypatch.setattr(module, "cut_lineage", noted)
    monkeypatch.setattr(QM.RF, "run_parallel", enough)
    assert QF.e5_split_vocabularies(spark, SF_SMALL).count() > 0 and QF.e8_sparse_vectors(spark, SF_SMALL).count() > 0
    assert written and not any("tf" in df.columns for df in written)
    written.clear()
    try:
        QM._forest(spark, SF_SMALL)
    except Enough:
        pass
    (terms,), (vocab,) = ([df for df in written if c in df.columns] for c in ("tf", "idx"))
    known = {r.term for r in vocab.select("term").distinct().collect()}
    found = {r.term for r in terms.select("term").distinct().collect()}
    assert known <= found and len(found) < 3 * len(known) + 200


def test_a_runs_reports_are_written_as_texts(spark):
    """The tokens come back from the text: also none, and those of a report without a text."""
    from tessera.config import RunConfig
    from tessera.operators.clean import clean_reports
    from tessera.plans import runs as RN
    rows = [(1, 0, "a", "Indication: the Left lobe, left 12_05!"), (2, 1, "a", ""), (3, 1, "b", "... !"), (4, 0, None, None), (5, 2, "c", "one")]
    df = spark.createDataFrame(rows, "report_id long, label int, ipp string, content string")
    got, _, v = RN.prepare(df, RunConfig(outer_folds=2))
    want = clean_reports(df).select("report_id", "tokens", "clean_text").collect()
    assert sorted(map(tuple, got.select("report_id", "tokens", "clean_text").collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert v == len({t for r in want for t in r.tokens or []})
    assert "tokens" not in got._jdf.queryExecution().optimizedPlan().children().head().output().mkString(",")
