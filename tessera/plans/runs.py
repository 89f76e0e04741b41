"""Whole runs: repeated nested cross-validation with TF-IDF or document vectors
(M12), the explanation run (X8) and the curve run.

Shape of a run: clean once -> fold tables (two small jobs) -> the vocabularies of a
realization's inner splits in one job -> its fits (concurrent Spark ML jobs) -> selection
aggregates -> outer vocabularies in one job -> refits -> predictions written per
fold -> metrics and curves as aggregates. The vocabularies are written once,
partitioned by split, and the fold tables by their parent, so a split's job
reads its own folders only. Nothing of a vocabulary reaches the driver.

Every finished fit is committed to the run's folder (``ledger``). A run started
again with the same ``run_dir`` does only the fits that are not there. Fits are
repeatable: vectors are sums in a fixed order, training rows have a fixed layout.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.text import explode_rows, round_half_up
from ..operators import clean as C
from ..operators import curves as CV
from ..operators import doc2vec as DV
from ..operators import explain as X
from ..operators import features as FE
from ..operators import forest as RF
from ..operators import labels as L
from ..operators import metrics as MT
from ..operators import perturbed as PS
from ..operators import splits as SP
from ..operators import tuning as TU
from ..session import cut_lineage, scratch_path
from ..sources import readers as R
from ..sources import sinks as K
from .ledger import RunFolder, delete, digest_of

PARAMS = ("n_gram", "pvs", "mf")


@dataclass
class RunResult:
    predictions: DataFrame       # (embedding, realization, outer_fold, report_id, y_true, y_pred, score)
    val_scores: DataFrame        # (realization, outer_fold, inner_fold, seq, params..., f1)
    best_outer: DataFrame        # M7
    params_outer: DataFrame      # M8
    params_realizations: DataFrame  # M9
    metrics: DataFrame           # per realization: G2 + AUC + AUPR (multi-class: G3)
    summary: DataFrame           # G8
    validation: DataFrame | None = None  # (realization, outer_fold, inner_fold, seq, report_id, y_true, y_pred)


def prepare(reports: DataFrame, cfg: RunConfig, first_seed: int = 0):
    """Clean once; fold tables; vocabulary size V of the cleaned corpus."""
    cleaned = C.clean_reports(reports, cfg.clean).select("report_id", "label", "ipp", "clean_text")
    # tokens hold no blank: the text alone is written, a quarter of its list of tokens
    tokens = F.when(F.col("clean_text") == "", F.array().cast("array<string>")).otherwise(F.split("clean_text", " "))
    cleaned = cut_lineage(cleaned.repartition("report_id")).select("report_id", "label", "ipp", tokens.alias("tokens"), "clean_text")
    vocab_size = explode_rows(cleaned, F.col("tokens"), "t").select("t").distinct().count()
    folds = SP.outer_folds(cleaned, cfg.realizations, cfg.outer_folds, first_seed=first_seed)
    return cleaned, folds, vocab_size


def task_rows(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """The rows and classes ``y`` of the task: binary (P5 + P6), or all four labels as they are."""
    return SP.binary_task(df) if cfg.binary else df.withColumn("y", F.col("label").cast("int"))


def n_classes(cfg: RunConfig) -> int:
    return 2 if cfg.binary else 4


def cap_column(vocab_size: int, pvs_col):
    """E5: round_half_up(V * pvs); NULL (no cap) where pvs is NULL."""
    return round_half_up(F.lit(float(vocab_size)) * pvs_col, 0).cast("long")


def heldout_vocabularies(doc_terms: DataFrame, universe: DataFrame, parent_cols, n_folds: int,
                         combos: DataFrame, vocab_size: int, cfg: RunConfig) -> DataFrame:
    """E3-E5 and E8's numbers for all k-fold splits of many parents at once, by complement
    (``features.heldout_term_stats``). ``combos``: (parent..., fold, n_gram, pvs, split_id).
    Terms are pruned per (parent, fold) before the grid multiplies them.
    Returns (split_id, term, idf, idx)."""
    pc = list(parent_cols)
    stats, n_docs = FE.heldout_term_stats(doc_terms, universe, pc, n_folds, min_df=cfg.min_df)
    hi = F.col("n_docs") * F.lit(float(cfg.max_df))
    pruned = stats.join(n_docs, pc + ["fold"]).where((F.col("df") >= cfg.min_df) & (F.col("df") <= hi))
    caps = combos
    if cfg.vocab_scope == "train":
        # V counts every word of the training rows, those that pruning drops too
        words, _ = FE.heldout_term_stats(doc_terms.where("n = 1"), universe, pc, n_folds)
        v = words.groupBy(*pc, "fold").agg(F.count(F.lit(1)).alias("_v"))
        caps = caps.join(v, pc + ["fold"], "left").withColumn(
            "_cap", round_half_up(F.col("_v").cast("double") * F.col("pvs"), 0).cast("long")).drop("_v")
    else:
        caps = caps.withColumn("_cap", cap_column(vocab_size, F.col("pvs")))
    x = pruned.join(caps, pc + ["fold"]).where(F.col("n") <= F.col("n_gram"))
    v = FE.cap_vocabulary(x.select("split_id", "term", "df", "ctf", "n_docs", "_cap"), F.col("_cap"))
    return FE.numbered_vocabulary(v.select("split_id", "term", FE.idf_column(F.col("n_docs"), F.col("df")).alias("idf")))


def split_sizes(vocab: DataFrame) -> dict[int, int]:
    """Terms per split: one number per split of the grid."""
    return {r["split_id"]: r["n"] for r in vocab.groupBy("split_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def held_fold(fold_col: str, pure_col: str):
    return F.when(F.col(pure_col), F.col(fold_col)).otherwise(F.lit(-1)).alias("fold")


def _held(table: DataFrame, where, fold_col: str, pure_col: str, fold: int) -> DataFrame:
    """(report_id, held) of one split straight from a compact fold table: held out iff the row
    drew that fold and its patient is pure. No per-split membership table is ever written."""
    return table.where(where).select("report_id", ((F.col(fold_col) == F.lit(fold)) & F.col(pure_col)).alias("held"))


def split_vectors(dterms: DataFrame, vocab: DataFrame, split_id: int, size: int, members: DataFrame) -> DataFrame:
    """E6-E8 of one split: (report_id, features as the stored struct)."""
    v = vocab.where(F.col("split_id") == split_id)
    m = members.select(F.lit(split_id).alias("split_id"), "report_id")
    return FE.sparse_rows(FE.indexed_weights(dterms, m, v, n_terms=size), m, max(size, 1))


def fixed_layout(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """The rows in the same tasks and order however they arrived: the learner draws per task and place."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key)


def _fit(vectors: DataFrame, ys: DataFrame, members: DataFrame, mfs, cfg: RunConfig, seed: int, path: str):
    """Forests of one split on its training rows, applied to its held-out rows: [(mf, predictions)]. The
    split's vectors are stored at ``path``, which the caller drops."""
    rows = FE.stored_vectors(vectors.join(members, "report_id").join(ys, "report_id"), path)
    models = RF.fit_many([RF.forest(cfg.n_trees, mf, seed, cfg.max_depth, cfg.max_bins) for mf in mfs],
                         fixed_layout(rows.where(~F.col("held"))), n_classes(cfg))
    held = rows.where("held")
    return [(mf, RF.predict(m, held).select("report_id", "y", "y_pred", "score")) for mf, m in zip(mfs, models)]


_TYPES = {"n_gram": "int", "pvs": "double", "size": "int", "mf": "double"}
VALIDATION = "realization int, outer_fold int, inner_fold int, seq int, report_id long, y_true int, y_pred int"


def nested_cv(spark: SparkSession, folds: DataFrame, ys: DataFrame, grid: list[tuple], params: Sequence[str],
              cfg: RunConfig, embedding: str, inner_vectors, outer_vectors, run: RunFolder) -> RunResult:
    """M5-M12 for any features. ``grid``: (feature settings..., mf) in loop order;
    ``inner_vectors(parents, splits, name)``, asked for one realization at a time, and ``outer_vectors(parents, splits,
    name)`` give functions from a split to its (report_id, features); what they store has that name in the
    run's folder. Fits that ``run`` holds are not done again."""
    inner = run.once("inner-folds", lambda: task_rows(SP.inner_folds(folds, cfg.outer_folds, cfg.inner_folds), cfg).select(
        "realization", "outer_fold", "report_id", "inner_fold", "inner_pure"), ["realization", "outer_fold"])
    outer = run.once("outer-folds", lambda: task_rows(folds, cfg).select("realization", "report_id", "test_fold", "pure"),
                     ["realization"])
    seqs = {combo: i for i, combo in enumerate(grid)}
    features = list(dict.fromkeys(c[:-1] for c in grid))
    schema = ("realization int, outer_fold int, inner_fold int, seq int, "
              + ", ".join(f"{p} {_TYPES[p]}" for p in params) + ", f1 double")
    parents = sorted((r["realization"], r["outer_fold"]) for r in inner.select("realization", "outer_fold").distinct().collect())
    fits = [(r, o, v, *f) for r, o in parents for v in range(cfg.inner_folds) for f in features]
    done = run.finished(schema, ["realization", "outer_fold", "inner_fold", *params[:-1]])
    score = MT.binary_metrics if cfg.binary else MT.weighted_metrics

    def task(vectors_of, r, o, v, *f):
        def do():
            where = (F.col("realization") == r) & (F.col("outer_fold") == o)
            members = _held(inner, where, "inner_fold", "inner_pure", v)
            mfs = [c[-1] for c in grid if c[:-1] == f]
            name = "vectors-" + run._fit_name((r, o, v, *f))
            found = None
            for mf, p in _fit(vectors_of((r, o, v, *f), members), ys, members, mfs, cfg, r, run.work(name)):
                x = p.select(F.lit(r).alias("realization"), F.lit(o).alias("outer_fold"), F.lit(v).alias("inner_fold"),
                             F.lit(seqs[(*f, mf)]).alias("seq"), "report_id", F.col("y").cast("int").alias("y_true"), "y_pred")
                found = x if found is None else found.unionByName(x)
            found = cut_lineage(found)
            f1 = {x["seq"]: x["f1"] for x in score(found, ["seq"]).collect()}
            rows = [(r, o, v, seqs[(*f, mf)], *f, float(mf), float(f1.get(seqs[(*f, mf)], 0.0))) for mf in mfs]
            run.commit_scores((r, o, v, *f), spark.createDataFrame(rows, schema), found)
            run.drop(name)
        return do

    # the splits' tables of one realization at a time: ten of them would stand beside each other for nothing
    for r in sorted({f[0] for f in fits if f not in done}):
        mine = [f for f in fits if f[0] == r]
        vectors_of = inner_vectors(inner.where(F.col("realization") == r), mine, f"inner-vocabularies-{r}")
        RF.run_parallel([task(vectors_of, *f) for f in mine if f not in done], cfg.concurrent_fits)
        run.drop(f"inner-vocabularies-{r}")
    val_scores = run.scores(schema)
    values = spark.createDataFrame([tuple(c) for c in grid], ", ".join(f"{p} {_TYPES[p]}" for p in params))
    best_inner = TU.best_per_inner_fold(val_scores, ["realization", "outer_fold", "inner_fold"], list(params))
    best_outer = cut_lineage(TU.best_per_outer_fold(best_inner, ["realization", "outer_fold"], "inner_fold", list(params)))
    L.require_on_grid(best_outer, values, list(params))
    chosen = sorted(((r["realization"], r["outer_fold"], *(r[p] for p in params)) for r in best_outer.collect()),
                    key=lambda c: c[:2])
    absent = [c for c in chosen if not run.has_predictions(embedding, cfg.run_date, c[0], c[1])]
    vectors_of = outer_vectors(outer, [c[:-1] for c in chosen], "outer-vocabularies") if absent else None

    def otask(r, o, *combo):
        def do():
            members = _held(outer, F.col("realization") == r, "test_fold", "pure", o)
            name = f"vectors-outer-{r}-{o}"
            ((_, p),) = _fit(vectors_of((r, o, *combo[:-1]), members), ys, members, [combo[-1]], cfg, r, run.work(name))
            run.commit_predictions(p.select(
                F.lit(embedding).alias("embedding"), F.lit(cfg.run_date).alias("run_date"), F.lit(r).alias("realization"),
                F.lit(o).alias("outer_fold"), "report_id", F.col("y").alias("y_true"), "y_pred", "score"))
            run.drop(name)
        return do

    RF.run_parallel([otask(*c) for c in absent], cfg.concurrent_fits)
    pooled = R.read_curves(spark, f"{run.root}/predictions", embedding, cfg.run_date).select(
        "embedding", "realization", "outer_fold", "report_id", "y_true", "y_pred", "score")
    run.finish()
    return _finish(pooled, val_scores, best_outer, params, cfg, run.validation(VALIDATION))


def _run_folder(spark: SparkSession, reports: DataFrame, cfg: RunConfig, embedding: str, run_dir: str | None) -> RunFolder:
    digest = digest_of(reports, ["report_id", "label", "ipp", "content"]) if run_dir else ""
    return RunFolder(spark, f"{embedding} {digest} {cfg!r}", run_dir)


def tfidf_run(spark: SparkSession, reports: DataFrame, cfg: RunConfig = RunConfig(),
              embedding: str = "tf_idf", vectors_dir: str | None = None, run_dir: str | None = None) -> RunResult:
    """Repeated nested cross-validation, TF-IDF + random forest. With
    ``vectors_dir`` the test rows' vectors of the first realization are written (S3). With a
    ``run_dir`` (a shared folder) a run that was stopped goes on where it was; the folder of
    another run is refused."""
    run = _run_folder(spark, reports, cfg, embedding, run_dir)
    cleaned, folds, vsize = prepare(reports, cfg)
    rows = task_rows(cleaned, cfg)
    ys = cut_lineage(rows.select("report_id", "y"))
    dterms = cut_lineage(FE.doc_terms(rows, "clean_text", max(cfg.ngrams)))
    grid = [(n, p, m) for n in cfg.ngrams for p in cfg.pvs for m in cfg.max_features]

    def of_splits(universe, parent_cols, n_folds, splits, name):
        """One vocabulary per split, written by split; a function from a split to its vectors."""
        ids = {s: i for i, s in enumerate(splits)}
        combos = spark.createDataFrame([(*s, i) for s, i in ids.items()], ", ".join(
            f"{c} int" for c in [*parent_cols, "fold", "n_gram"]) + ", pvs double, split_id int")
        vocab = run.once(name, lambda: heldout_vocabularies(dterms, universe, parent_cols, n_folds, combos, vsize, cfg), ["split_id"])
        sizes = split_sizes(vocab)
        return lambda split, members: split_vectors(dterms, vocab, ids[split], sizes.get(ids[split], 0), members)

    def inner_vectors(inner, splits, name):
        universe = inner.select("realization", "outer_fold", "report_id", held_fold("inner_fold", "inner_pure"))
        return of_splits(universe, ["realization", "outer_fold"], cfg.inner_folds, splits, name)

    def outer_vectors(outer, splits, name):
        universe = outer.select("realization", "report_id", held_fold("test_fold", "pure"))
        of = of_splits(universe, ["realization"], cfg.outer_folds, splits, name)
        if vectors_dir is not None:
            for split in (s for s in splits if s[0] == min(x[0] for x in splits)):
                members = _held(outer, F.col("realization") == split[0], "test_fold", "pure", split[1])
                test = FE.stored_vectors(of(split, members).join(members.where("held").select("report_id"), "report_id")
                                         .join(ys, "report_id"), run.work(f"vectors-written-{split[1]}"))
                K.write_vectors_tsv(test.withColumn("outer_fold", F.lit(split[1])), f"{vectors_dir}/fold-{split[1]}",
                                    label_col="y")
        return of

    return nested_cv(spark, folds, ys, grid, PARAMS, cfg, embedding, inner_vectors, outer_vectors, run)


def d2v_run(spark: SparkSession, reports: DataFrame, cfg: RunConfig = RunConfig(), embedding: str = "d2v",
            run_dir: str | None = None) -> RunResult:
    """M12 with document vectors: per split and size one model trained on the split's training
    rows, applied to its held-out rows. ``run_dir`` as in ``tfidf_run``."""
    run = _run_folder(spark, reports, cfg, embedding, run_dir)
    cleaned, folds, _ = prepare(reports, cfg)
    rows = task_rows(cleaned, cfg)
    ys = cut_lineage(rows.select("report_id", "y"))
    docs = cut_lineage(rows.select("report_id", F.col("tokens").alias("words")))
    grid = [(s, m) for s in cfg.d2v_sizes for m in cfg.max_features]

    def vectors(table, splits, name):
        def of(split, members):
            model = DV.train(docs.join(members.where(~F.col("held")), "report_id"), size=split[-1],
                             epochs=cfg.d2v_epochs, seed=split[0], partitions=cfg.d2v_partitions)
            return DV.infer(model, docs.join(members, "report_id")).select("report_id", "features")
        return of

    return nested_cv(spark, folds, ys, grid, ("size", "mf"), cfg, embedding, vectors, vectors, run)


def _finish(pooled: DataFrame, val_scores: DataFrame, best_outer: DataFrame, params, cfg: RunConfig,
            validation: DataFrame) -> RunResult:
    k = ["embedding", "realization"]
    if cfg.binary:
        metrics = MT.binary_metrics(pooled, k).join(CV.roc_auc(pooled, k), k).join(CV.pr_auc(pooled, k), k)
        names = MT.METRICS
    else:
        metrics, names = MT.weighted_metrics(pooled, k), MT.METRICS[:6]
    p_outer = TU.most_frequent_params(best_outer, ["realization"], "outer_fold", params)
    wide = p_outer.groupBy("realization").pivot("param", list(params)).agg(F.first("value"))
    p_real = TU.most_frequent_params(wide, [], "realization", params)
    return RunResult(pooled, val_scores, best_outer, p_outer, p_real, metrics, MT.summarize(metrics, metrics=names), validation)


# ------------------------------------------------------------ runs from files
def reports_from_files(spark: SparkSession, report_paths, session_paths) -> DataFrame:
    """S1 -> P1, P2 -> P3, P4, and the patient of each report looked up by its text (S2, F4):
    (report_id, content, label, ipp). A report without a session keeps a NULL patient; of
    several patients with one text the smallest id is taken."""
    reports = L.extract_labels(L.require_no_nulls(R.read_reports(spark, report_paths)))
    reports = SP.text_keys(reports.select("report_id", "content", "label"), "content")
    sessions = SP.text_keys(R.read_sessions(spark, session_paths), "report")
    owner = SP.patients_of(reports, sessions, ["key"]).groupBy("key").agg(F.min("ipp").alias("ipp"))
    return reports.join(owner, "key", "left").select("report_id", "content", "label", "ipp")


def run_from_files(spark: SparkSession, report_paths, session_paths, out_dir: str, cfg: RunConfig = RunConfig(),
                   embedding: str = "tf_idf", resume: bool = False) -> RunResult:
    """M12 from files to files: reads the reports and sessions, runs, writes the pooled predictions
    and the first realization's test vectors (S3) below ``out_dir``. With ``resume`` the run's folder
    is kept below ``out_dir`` too, and a run that was stopped goes on."""
    r = tfidf_run(spark, reports_from_files(spark, report_paths, session_paths), cfg, embedding,
                  vectors_dir=f"{out_dir}/vectors", run_dir=f"{out_dir}/run" if resume else None)
    K.write_run_results(r.predictions.withColumn("run_date", F.lit(cfg.run_date)), f"{out_dir}/predictions")
    return r


def curve_run(spark: SparkSession, root: str, runs: dict[str, str]) -> dict[str, DataFrame]:
    """The curve run: stored predictions of each embedding and its run date (S5), their averaged
    ROC and PR bands (G9, G10), no-skill level (G12) and the comparison (G13)."""
    allowed = ("tf_idf", "d2v")
    if unknown := set(runs) - set(allowed):
        raise ValueError(f"embedding must be one of {allowed}, not {sorted(unknown)}")
    stored = None
    for embedding, date in runs.items():
        one = R.read_curves(spark, root, embedding, date)
        stored = one if stored is None else stored.unionByName(one)
    roc = CV.roc_band_of(stored)
    return {"roc_band": roc, "pr_band": CV.pr_band_of(stored), "no_skill": CV.no_skill(stored),
            "compare": CV.compare_embeddings(roc, values=list(runs))}


# ------------------------------------------------------------ explanation run
def lime_run(spark: SparkSession, reports: DataFrame, cfg: RunConfig = RunConfig(), n_gram: int = 3,
             pvs: float | None = 0.9, mf: float = 0.8, seed: int = 123, num_samples: int = 5000,
             num_features: int = 6, out_dir: str | None = None) -> dict:
    """Fixed hyper-parameters, k-fold, every test report explained; words
    most often behind each outcome; pooled metrics. With ``out_dir`` the
    explanations are written by outcome (S6). Note the run keeps the cleaning
    default of removing stop words."""
    cfg = replace(cfg, realizations=1)
    cleaned, folds, vsize = prepare(reports, cfg, first_seed=seed)
    rows = SP.binary_task(cleaned)
    docs = cut_lineage(rows.select("report_id", "y", "tokens"))
    dterms = cut_lineage(FE.doc_terms(rows, "clean_text", n_gram))
    fb = cut_lineage(SP.binary_task(folds).select("realization", "report_id", "test_fold", "pure"))
    universe = fb.select("realization", "report_id", held_fold("test_fold", "pure"))
    combos = spark.createDataFrame([(seed, f, n_gram, pvs, f) for f in range(cfg.outer_folds)],
                                   "realization int, fold int, n_gram int, pvs double, split_id int")
    run = RunFolder(spark, "explain")
    vocab = run.once("vocabularies", lambda: heldout_vocabularies(
        dterms, universe, ["realization"], cfg.outer_folds, combos, vsize, cfg), ["split_id"])
    sizes = split_sizes(vocab)

    def task(fold):
        def do():
            members = _held(fb, F.lit(True), "test_fold", "pure", fold)
            path = run.work(f"vectors-{fold}")
            data = FE.stored_vectors(split_vectors(dterms, vocab, fold, sizes.get(fold, 0), members)
                                     .join(members, "report_id").join(docs, "report_id"), path)
            model = RF.fit(RF.forest(cfg.n_trees, mf, seed, cfg.max_depth, cfg.max_bins),
                           fixed_layout(data.where(~F.col("held")).select("report_id", "y", "features")))
            pred = RF.predict(model, data.where("held")).select("report_id", "y", "y_pred", "score", "tokens")
            pred = cut_lineage(pred.withColumn("outcome", X.outcome(F.col("y"), F.col("y_pred"))))
            delete(spark, path)
            # One row per report; its samples live in the worker that explains it
            v = PS.term_words(vocab.where(F.col("split_id") == fold), dterms)
            rows = PS.dealt(PS.report_rows(pred.where(F.size("tokens") > 0), v))
            expl = PS.explain_rows(rows, PS.forest_arrays(spark, model), num_samples, seed, num_features)
            expl = expl.join(pred.select("report_id", "outcome"), "report_id")
            return (pred.select(F.lit(fold).alias("outer_fold"), "report_id", F.col("y").alias("y_true"),
                                "y_pred", "score", "outcome"),
                    cut_lineage(expl.withColumn("outer_fold", F.lit(fold))))
        return do

    out = RF.run_parallel([task(f) for f in range(cfg.outer_folds)], cfg.concurrent_fits)
    preds, expls = out[0]
    for p, e in out[1:]:
        preds, expls = preds.unionByName(p), expls.unionByName(e)
    preds = cut_lineage(preds.withColumn("embedding", F.lit("tf_idf")).withColumn("realization", F.lit(0)))
    run.finish()
    if out_dir is not None:
        K.write_explanations(expls.withColumn("embedding", F.lit("tf_idf")), out_dir)
    return {"predictions": X.numbered_by_fold(preds, ["outcome"]), "explanations": expls,
            "common_words": X.common_words(expls),
            "metrics": MT.binary_metrics(preds, ["embedding", "realization"])}
