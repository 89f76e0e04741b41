"""Stratified, patient-grouped, nested, repeated folds (F1-F8).

Fold numbering (F1) is the usual shuffled stratified split: within a class,
rows are ranked by a seeded md5 key; a class offset then deals the rows of all
classes round-robin over k folds, so every fold gets the same share of each
class and fold sizes differ by at most one.

Scale: a window over a whole class would put a third of the data in one task.
Rank in two levels instead: the first ``bucket_digits`` hex digits of the md5
key name a bucket; a small aggregate gives rows per (group, class, bucket)
and its prefix sums (the offsets); rows are ranked only inside their bucket.
The offset table has at most groups x classes x 16**digits rows.

Leak repair (F6): a test row whose patient also has training rows moves to
training. Equivalently a patient stays in test for fold f only if *all* its
rows drew fold f - a per-patient min/max aggregate (partial aggregation, so
a patient holding a third of the rows is no hot task) joined back by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import seed_key
from ..session import cut_lineage


def stratified_fold(df: DataFrame, k: int, key_parts: Sequence, label_col: str = "label",
                    id_col: str = "report_id", group_cols: Sequence[str] = (),
                    out_col: str = "fold", bucket_digits: int = 3) -> DataFrame:
    """add ``out_col`` in 0..k-1, stratified on ``label_col`` within each
    ``group_cols`` group. ``key_parts`` (values or columns) seed the order:
    rows are ranked by md5(key_parts..., id), then id. A NULL label fails the
    job: a row without a class can be dealt to no fold."""
    g = list(group_cols)
    df = df.withColumn(label_col, F.coalesce(label_col, F.raise_error(
        F.concat(F.lit(f"{label_col} is NULL in row "), F.coalesce(F.col(id_col).cast("string"), F.lit("NULL"))))
        .cast(df.schema[label_col].dataType)))
    x = df.withColumn("_h", seed_key(*key_parts, F.col(id_col))) \
          .withColumn("_b", F.substring("_h", 1, bucket_digits))
    cnt = x.groupBy(*g, label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    in_class = Window.partitionBy(*g, label_col).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cls_tot = Window.partitionBy(*g, label_col)
    cnt = cnt.withColumn("_bo", F.sum("_n").over(in_class) - F.col("_n")) \
             .withColumn("_cn", F.sum("_n").over(cls_tot))
    classes = cnt.select(*g, label_col, "_cn").distinct()
    cls_w = Window.partitionBy(*g).orderBy(label_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    classes = classes.withColumn("_co", F.sum("_cn").over(cls_w) - F.col("_cn")).drop("_cn")
    off = cnt.join(classes, g + [label_col]).select(*g, label_col, "_b", (F.col("_co") + F.col("_bo")).alias("_o"))
    r = F.row_number().over(Window.partitionBy(*g, label_col, "_b").orderBy("_h", id_col))
    out = x.join(off, g + [label_col, "_b"]).withColumn(
        out_col, ((F.col("_o") + r - 1) % k).cast("int"))
    return out.drop("_h", "_b", "_o")


def with_realizations(df: DataFrame, n: int, col: str = "realization", first_seed: int = 0) -> DataFrame:
    """one copy of every row per realization seed (explode, no join)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + n - 1))))


def patient_purity(df: DataFrame, group_cols: Sequence[str], fold_col: str, patient_col: str = "ipp",
                   out_col: str = "pure") -> DataFrame:
    """F6 helper: ``out_col`` is true when every row of the patient (within
    the group) drew the same fold. A row without a patient id is a patient of
    its own: it is pure and stays in its fold.

    Only patients with rows in several folds are joined back (an anti join in
    effect), and rows without an id never enter the join."""
    g = list(group_cols)
    mixed = (df.where(F.col(patient_col).isNotNull()).groupBy(*g, patient_col)
             .agg(F.min(fold_col).alias("_lo"), F.max(fold_col).alias("_hi")).where("_lo <> _hi")
             .select(*g, patient_col, F.lit(False).alias("_pure")))
    return df.join(mixed, g + [patient_col], "left").withColumn(
        out_col, F.coalesce("_pure", F.lit(True))).drop("_pure")


def outer_folds(reports: DataFrame, realizations: int, k: int, label_col: str = "label",
                id_col: str = "report_id", patient_col: str = "ipp", first_seed: int = 0,
                materialize: bool = True) -> DataFrame:
    """F1 + F2 + F6: (realization, report_id, label, ipp, test_fold, pure).
    Row r is tested in fold f iff test_fold = f and pure; otherwise it trains.
    Realization i uses seed ``first_seed + i``.

    Numbering and repair each read their input twice (counts, then the join
    back); stacking levels would multiply the copies of the scan in one plan,
    so the result is written once to the shared checkpoint folder."""
    x = with_realizations(reports.select(id_col, label_col, patient_col), realizations, first_seed=first_seed)
    x = stratified_fold(x, k, [F.col("realization")], label_col, id_col, ["realization"], "test_fold")
    out = patient_purity(x, ["realization"], "test_fold", patient_col, "pure")
    return cut_lineage(out) if materialize else out


def outer_role(test_fold, pure, outer_fold):
    return F.when((test_fold == outer_fold) & pure, F.lit("test")).otherwise(F.lit("train"))


def outer_roles(folds: DataFrame, k: int) -> DataFrame:
    """F6/F7 outer level: (realization, outer_fold, report_id, ..., role)."""
    x = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return x.withColumn("role", outer_role(F.col("test_fold"), F.col("pure"), F.col("outer_fold")))


def inner_folds(folds: DataFrame, k_outer: int, k_inner: int, label_col: str = "label",
                id_col: str = "report_id", patient_col: str = "ipp", materialize: bool = True) -> DataFrame:
    """F3 (+ F6 inside): the training rows of every outer fold, split again.
    (realization, outer_fold, report_id, label, ipp, inner_fold, inner_pure),
    written once to the shared checkpoint folder (see ``outer_folds``)."""
    tr = outer_roles(folds, k_outer).where(F.col("role") == "train") \
        .select("realization", "outer_fold", id_col, label_col, patient_col)
    x = stratified_fold(tr, k_inner, [F.col("realization"), F.col("outer_fold")], label_col, id_col,
                        ["realization", "outer_fold"], "inner_fold")
    out = patient_purity(x, ["realization", "outer_fold"], "inner_fold", patient_col, "inner_pure")
    return cut_lineage(out) if materialize else out


def stacked_training(roles: DataFrame) -> DataFrame:
    """F8: every split's training rows as the base rows with the moved rows below them; ``moved`` tells
    them apart. ``roles``: ``outer_roles`` rows."""
    base = roles.where(F.col("test_fold") != F.col("outer_fold")).withColumn("moved", F.lit(False))
    moved = roles.where((F.col("test_fold") == F.col("outer_fold")) & ~F.col("pure")).withColumn("moved", F.lit(True))
    return base.unionByName(moved)


def inner_roles(inner: DataFrame, k_inner: int) -> DataFrame:
    """Inner level: role 'val' iff inner_fold = v and inner_pure, else 'train'."""
    x = inner.withColumn("val_fold", F.explode(F.sequence(F.lit(0), F.lit(k_inner - 1))))
    return x.withColumn("role", F.when((F.col("inner_fold") == F.col("val_fold")) & F.col("inner_pure"),
                                       F.lit("val")).otherwise(F.lit("train")))


def split_table(folds: DataFrame, inner: DataFrame, k_outer: int, k_inner: int,
                id_col: str = "report_id") -> DataFrame:
    """one long table (realization, outer_fold, inner_fold, report_id, role);
    inner_fold = -1 marks the outer train/test level."""
    o = outer_roles(folds, k_outer).select("realization", "outer_fold", F.lit(-1).alias("inner_fold"),
                                           id_col, "role")
    i = inner_roles(inner, k_inner).select("realization", "outer_fold", F.col("val_fold").alias("inner_fold"),
                                           id_col, "role")
    return o.unionByName(i)


def text_keys(df: DataFrame, text_col: str, out_col: str = "key") -> DataFrame:
    """``out_col``: the SHA-256 of the text, which stands for it in joins."""
    return df.withColumn(out_col, F.sha2(F.col(text_col), 256))


def patients_of(rows: DataFrame, sessions: DataFrame, keys: Sequence[str] = (), key_col: str = "key",
                patient_col: str = "ipp") -> DataFrame:
    """patient ids of a row set looked up by report text: the session rows
    whose text key is among the row set's, as (keys..., ipp) per session row.
    Both sides carry ``text_keys``, so no text travels."""
    keys = list(keys)
    wanted = rows.select(*keys, key_col).distinct()
    return sessions.select(key_col, patient_col).join(wanted, key_col).select(*keys, patient_col)


def shared_patients(train_ipps: DataFrame, test_ipps: DataFrame, keys: Sequence[str] = (),
                    patient_col: str = "ipp") -> DataFrame:
    """patients present on both sides (set intersection per key); rows
    without an id belong to no patient."""
    cols = list(keys) + [patient_col]
    known = F.col(patient_col).isNotNull()
    return train_ipps.where(known).select(*cols).intersect(test_ipps.where(known).select(*cols))


def binary_task(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P5 + P6 after the split: drop unknown, merge 2 into 1."""
    return df.where(F.col(label_col) != 3).withColumn(
        "y", F.when(F.col(label_col) == 2, 1).otherwise(F.col(label_col)).cast("int"))
