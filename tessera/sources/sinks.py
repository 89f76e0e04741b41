"""Sinks: vectors as tab-separated text, run results and explanations as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_vectors_tsv(df: DataFrame, out_dir: str, vector_col: str = "features",
                      label_col: str = "label", fold_col: str = "outer_fold", layout: str = "dense") -> None:
    """S3: one tab-separated line per row, plus the label files; one folder per test fold
    (``outer_fold=k``). Layout ``dense``: all numbers of the vector, which makes a line as long as
    the vocabulary; ``sparse``: ``index:value`` of the non-zero ones."""
    vector_lines(df, vector_col, fold_col, layout).write.mode("overwrite").partitionBy(fold_col).text(f"{out_dir}/vectors")
    lab = df.select(fold_col, F.col(label_col).cast("string").alias("value"))
    lab.write.mode("overwrite").partitionBy(fold_col).text(f"{out_dir}/labels")


def vector_lines(df: DataFrame, vector_col: str, fold_col: str, layout: str) -> DataFrame:
    """(fold, value), sorted by fold within a task. The vectors are sorted, not their lines, which may be
    many times as long: writing to one folder per fold needs no further sort."""
    v = F.unwrap_udt(F.col(vector_col))
    if layout == "dense":
        line = F.when(v["type"] == 1, F.concat_ws("\t", v["values"].cast("array<string>"))).otherwise(_dense_line(v))
    elif layout == "sparse":
        line = F.concat_ws("\t", F.zip_with(v["indices"], v["values"], lambda i, x: F.concat(
            i.cast("string"), F.lit(":"), x.cast("string"))))
    else:
        raise ValueError("layout must be 'dense' or 'sparse'")
    return df.sortWithinPartitions(fold_col).select(fold_col, line.alias("value"))


def _dense_line(v: Column) -> Column:
    """All numbers of a sparse vector: its entries with a run of zeros before each and after the last, so the
    work is by entries and bytes and no array as long as the vocabulary is built."""
    wrong = F.raise_error(F.lit("a vector's indices must ascend and be below its size"))
    zeros = F.zip_with(F.concat(F.array(F.lit(-1)), v["indices"]), F.concat(v["indices"], F.array(v["size"])),
                       lambda a, b: F.when(b <= a, wrong.cast("string")).otherwise(F.repeat(F.lit("\t0.0"), b - a - 1)))
    entries = F.concat(F.transform(v["values"], lambda x: F.concat(F.lit("\t"), x.cast("string"))), F.array(F.lit("")))
    return F.ltrim(F.array_join(F.zip_with(zeros, entries, lambda z, e: F.concat(z, e)), ""), F.lit("\t"))


def write_run_results(df: DataFrame, root: str,
                      partition_cols=("embedding", "run_date", "realization")) -> None:
    """Predictions / curve points partitioned so S5 prunes folders. The folders that ``df`` has
    rows for are replaced, all others stay: writing a run again leaves one set of rows.
    Each task sorts its rows by the folder keys and writes its own files: no
    shuffle, and a folder value holding a third of the rows is still written
    by many tasks, not one."""
    _replace(df.sortWithinPartitions(*partition_cols), root, partition_cols)


def write_explanations(df: DataFrame, root: str, partition_cols=("outcome", "embedding")) -> None:
    """Explanations grouped in folders by outcome and embedding, replaced as in S4."""
    _replace(df, root, partition_cols)


def _replace(df: DataFrame, root: str, partition_cols) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(root))
