"""Exact dedup: tree-merge of sorted digest runs, DataFrame operations only.

Each input partition is a run: its rows reduced to (digest, best row, count)
and sorted by digest. Runs meet in binomial rounds: in every round ``2**bits``
neighbouring runs are merged by digest, keeping the best identifier and the
summed count, until one run is left. A digest that holds a third of all rows
is one row per run from the first round on, so no task ever sees more than
``2**bits`` rows of it. The way back follows the same tree: the final run
answers the runs below it, the last of them the rows of one partition, so the
join back has no hot key either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, id_text


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One narrow row per document, written once: doc_id, digest key, run, row.

    The key is SHA-256 followed by a 64-bit hash of another family: a row is
    merged only if both agree (the verification of each merge), so two texts
    that collide in one of them stay apart."""
    text = F.col("text") if normalise is None else normalise(F.col("text"))
    rows = id_text(docs, id_col, text_col).select("doc_id", text.alias("text")).select(
        "doc_id",
        F.unhex(F.concat(F.sha2("text", 256), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))).alias("key"),
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"))
    return cut_lineage(rows)


def _best(keep: str, *cols: str) -> Column:
    """Ordering struct of a row: rows with an id win over rows without."""
    if keep == "largest":
        return F.struct(F.col(cols[0]).isNotNull().alias("ok"), *cols)
    return F.struct(F.col(cols[0]).isNull().alias("ok"), *cols)


def tree_merge(rows: DataFrame, keep: str = "smallest", bits: int = 4) -> DataFrame:
    """Rows of ``digest_rows`` with best (struct doc_id, row) and group_size."""
    pick = F.max if keep == "largest" else F.min
    n_runs = (rows.agg(F.max("run").alias("m")).first()["m"] or 0) + 1
    level = (rows.groupBy("run", "key")
             .agg(pick(_best(keep, "doc_id", "row")).alias("best"), F.count("*").alias("n")))
    levels = [level]
    while n_runs > 1:
        up = level.withColumn("run", F.shiftright("run", bits))
        level = up.groupBy("run", "key").agg(pick("best").alias("best"), F.sum("n").alias("n"))
        levels.append(level)
        n_runs = -(-n_runs // (1 << bits))
    found = levels[-1].select("run", "key", "best", "n")
    for below in reversed(levels[:-1]):
        # each run takes its answers from the merged run that holds it
        own = below.select(F.col("run").alias("own"), F.shiftright("run", bits).alias("run"), "key")
        found = own.join(found, ["run", "key"]).select(F.col("own").alias("run"), "key", "best", "n")
    return rows.join(found, ["run", "key"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", bits: int = 4,
                normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalise`` (default: unchanged).
    Of equal texts the row with the smallest (or ``keep='largest'``) id stays.
    Null text: empty text. Null id: loses against any id; a group without ids
    keeps one row, keep_id null. Repeated rows (same id, same text): exactly
    one is kept, the earlier one in the input for 'smallest', the later for
    'largest'. Empty table: no rows."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    out = tree_merge(digest_rows(docs, id_col, text_col, normalise), keep, bits)
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", bits: int = 4) -> DataFrame:
    """The input rows that stay, with all their columns.

    The kept rows are found by id and digest; only rows repeated under one id
    need ``dropDuplicates``, all others pass a semi join."""
    rows = digest_rows(docs, id_col, text_col)
    merged = tree_merge(rows, keep, bits)
    stay = (merged.where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
            .groupBy(F.col("doc_id").alias("_keep_id"), F.col("key").alias("_keep_key"))
            .agg(F.count("*").alias("_same")))
    stay = cut_lineage(stay).alias("k")
    text = F.coalesce(F.col(f"d.{text_col}").cast("string"), F.lit(""))
    key = F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.xxhash64(text)), 16, "0")))
    mark = free_name(docs.columns, "__text_key")

    def having(some: DataFrame) -> DataFrame:
        on = (key.eqNullSafe(F.col("k._keep_key"))
              & F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("k._keep_id")))
        return docs.alias("d").join(some.hint("shuffle_hash"), on, "left_semi")

    repeated = (having(stay.where("k._same > 1")).select("d.*", key.alias(mark))
                .dropDuplicates([id_col, mark]).drop(mark))
    return having(stay.where("k._same = 1")).unionByName(repeated)
