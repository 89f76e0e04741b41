"""Validation, label extraction and hyper-parameter keys.

Checks are one aggregate each and raise on the driver; extraction is a
projection with higher-order functions, so it runs inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CLASSIFICATION_VALUE, GLOBAL_LABELS


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, ``n_null_<col>`` per column (a single pass)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(f"n_null_{c}") for c in cols])


def require_no_nulls(df: DataFrame, cols: Sequence[str] = ("annotation", "content")) -> DataFrame:
    """P1 + P2: refuse missing values, then keep the columns of interest."""
    present = [c for c in cols if c in df.columns]
    row = null_counts(df, present).first()
    bad = {c: row[f"n_null_{c}"] for c in present if row[f"n_null_{c}"]}
    if bad:
        raise ValueError(f"There are some missing values in the columns {bad}")
    keep = ["report_id"] + present if "report_id" in df.columns else present
    return df.select(*keep)


def _entry_is_classification(entry: Column, entry_type: T.StructType) -> Column:
    """True when any string field of the entry equals the marker value."""
    conds = [entry[f.name] == F.lit(CLASSIFICATION_VALUE)
             for f in entry_type.fields if isinstance(f.dataType, T.StringType)]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def classification_entry(df: DataFrame, annotation_col: str = "annotation") -> Column:
    """The last entry of ``classificationResult`` marked 'Classification';
    the job fails when a report has none."""
    arr_type = df.schema[annotation_col].dataType["classificationResult"].dataType
    entry_type = arr_type.elementType
    arr = F.col(f"{annotation_col}.classificationResult")
    hits = F.filter(arr, lambda e: _entry_is_classification(e, entry_type))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise(
        F.raise_error(F.lit("Dictionary is empty or not found")))


def global_label(classes: Column) -> Column:
    """Exactly one class containing 'Global', mapped to 0-3; fails otherwise."""
    only = F.filter(classes, lambda x: x.contains("Global"))
    value = F.element_at(only, 1)
    mapped = None
    for text, code in GLOBAL_LABELS:
        mapped = (F.when(value == F.lit(text), F.lit(code)) if mapped is None
                  else mapped.when(value == F.lit(text), F.lit(code)))
    mapped = mapped.otherwise(F.raise_error(F.lit("global label not found")))
    return F.when(F.size(only) != 1, F.raise_error(F.lit("Only one value should be retrieved"))) \
        .otherwise(mapped).cast("int")


def extract_labels(df: DataFrame, annotation_col: str = "annotation") -> DataFrame:
    """P3 + P4: add ``label`` (0 stable, 1 response, 2 progression, 3 unknown)."""
    entry = classification_entry(df, annotation_col)
    return df.withColumn("label", global_label(entry["classes"]))


def known_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P5: drop reports of unknown label (3)."""
    return df.where(F.col(label_col) != 3)


def binary_label(label: Column) -> Column:
    """Progression (2) joins response (1): 0 stable, 1 unstable."""
    return F.when(label == 2, F.lit(1)).otherwise(label).cast("int")


def tfidf_combo_key(n_gram: Column, pvs: Column, mf: Column) -> Column:
    """``ngram{n}_pvs{p}_mf{m}``; a missing ``pvs`` prints as None."""
    return F.format_string("ngram%s_pvs%s_mf%s", n_gram.cast("string"),
                           F.coalesce(pvs.cast("string"), F.lit("None")), mf.cast("string"))


def d2v_combo_key(d2v_type: Column, size: Column, mf: Column) -> Column:
    """P8 for paragraph vectors: ``type{t}_vs{s}_mf{m}``."""
    return F.format_string("type%s_vs%s_mf%s", d2v_type.cast("string"), size.cast("string"),
                           mf.cast("string"))


def parse_tfidf_key(key: Column) -> list[Column]:
    """Typed (n_gram, pvs, mf) back from a key; ``pvsNone`` gives NULL."""
    return [F.regexp_extract(key, r"ngram(\d+)", 1).cast("int").alias("n_gram"),
            F.when(key.contains("pvsNone"), F.lit(None).cast("double"))
             .otherwise(F.regexp_extract(key, r"pvs(\d+\.\d+)", 1).cast("double")).alias("pvs"),
            F.regexp_extract(key, r"mf(\d+\.\d+)", 1).cast("double").alias("mf")]


def parse_d2v_key(key: Column) -> list[Column]:
    """P9 for paragraph vectors: (d2v_type 1 PV-DM / 0 PV-DBOW, size, mf)."""
    t = F.regexp_extract(key, r"type(\d+)", 1)
    return [F.when(t.contains("1"), 1).when(t.contains("0"), 0)
             .otherwise(F.raise_error(F.lit("Unknown value for doc2vec type"))).alias("d2v_type"),
            F.regexp_extract(key, r"vs(\d+)", 1).cast("int").alias("size"),
            F.regexp_extract(key, r"(\d+\.\d+)", 1).cast("double").alias("mf")]


def off_grid(parsed: DataFrame, grid: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: parsed rows whose values are not a grid point (null-safe match).
    The grid is a fixed handful of rows: a bounded broadcast side."""
    cond = None
    for c in cols:
        e = parsed[c].eqNullSafe(grid[c])
        cond = e if cond is None else cond & e
    return parsed.join(F.broadcast(grid), cond, "left_anti")


def require_on_grid(parsed: DataFrame, grid: DataFrame, cols: Sequence[str]) -> None:
    n = off_grid(parsed, grid, cols).limit(1).count()
    if n:
        raise ValueError("hyper-parameter has unexpected value")


def distinct_no_skill(no_skill: DataFrame, value_col: str = "no_skill") -> DataFrame:
    """How many different no-skill values there are (must be 1)."""
    return no_skill.agg(F.count_distinct(F.round(value_col, 12)).cast("long").alias("n_distinct"))
