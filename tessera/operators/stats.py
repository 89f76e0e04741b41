"""Corpus statistics (C1-C6) as aggregates over the cleaned report table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CLASS_NAMES_2, CLASS_NAMES_4
from ..functions.text import explode_rows

BOX_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def token_counts(cleaned: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Tokens per report before and after cleaning."""
    return cleaned.select(id_col, "n_orig_tokens", "n_tokens")


def _length_long(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode(F.array(
        F.struct(F.lit("original").alias("series"), F.col("n_orig_tokens").alias("len")),
        F.struct(F.lit("preprocessed").alias("series"), F.col("n_tokens").alias("len")))).alias("s")
    ).select("s.*")


def length_box(cleaned: DataFrame) -> DataFrame:
    """Box-plot numbers of report length before vs after cleaning.

    One pass over the reports builds a value-count histogram (series, length,
    count) - its size is the number of distinct lengths, not of reports.
    Exact quartiles (linear interpolation at position p*(n-1)) and the
    whiskers (most extreme length within 1.5 IQR of the quartiles) are then
    computed on that small table."""
    hist = _length_long(cleaned).groupBy("series", "len").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("series").orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("series")))
    aggs = []
    for i, p in enumerate(BOX_PROBS):
        pos = F.lit(p) * (F.col("n") - 1)
        lo = F.floor(pos)
        v_lo = F.min(F.when(F.col("cum") > lo, F.col("len")))
        v_hi = F.min(F.when(F.col("cum") > F.least(lo + 1, F.col("n") - 1), F.col("len")))
        frac = F.max(pos - lo)
        aggs.append((v_lo + frac * (v_hi - v_lo)).cast("double").alias(f"q{i}"))
    q = h.groupBy("series").agg(F.max("n").alias("n"), *aggs).withColumn("iqr", F.col("q3") - F.col("q1"))
    # one row per series: a bounded broadcast side
    j = hist.join(F.broadcast(q.select("series", "q1", "q3", "iqr")), "series")
    lo_ok = F.col("len") >= F.col("q1") - F.col("iqr") * 1.5
    hi_ok = F.col("len") <= F.col("q3") + F.col("iqr") * 1.5
    wk = j.groupBy("series").agg(F.min(F.when(lo_ok, F.col("len"))).cast("double").alias("whisker_low"),
                                 F.max(F.when(hi_ok, F.col("len"))).cast("double").alias("whisker_high"))
    return (q.join(wk, "series")
             .select("series", "n", F.col("q0").alias("min_len"), F.col("q1"),
                     F.col("q2").alias("median"), F.col("q3"), F.col("q4").alias("max_len"),
                     "whisker_low", "whisker_high"))


def vocabulary_size(cleaned: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct tokens before and after cleaning."""
    long = cleaned.select(F.explode(F.array(
        F.struct(F.lit("original").alias("series"), F.col("orig_tokens").alias("t")),
        F.struct(F.lit("preprocessed").alias("series"), F.col("tokens").alias("t")))).alias("s"))
    toks = explode_rows(long, F.col("s.t"), "token", F.col("s.series").alias("series"))
    agg = F.approx_count_distinct("token") if approx else F.count_distinct("token")
    return toks.groupBy("series").agg(agg.cast("long").alias("vocabulary_size"))


def top_tokens(cleaned: DataFrame, k: int = 10, tokens_col: str = "tokens") -> DataFrame:
    """C4: the k most frequent tokens (ties by token). A partial aggregate per
    task, then a top-k without a global sort."""
    counts = (explode_rows(cleaned, F.col(tokens_col), "token")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.col("n").desc(), F.col("token")).limit(k)


def class_distribution(df: DataFrame, label_col: str = "label", binary: bool = False) -> DataFrame:
    """Reports per class, with the class name joined by value."""
    names = CLASS_NAMES_2 if binary else CLASS_NAMES_4
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(label_col) + 1)
    return (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
              .select(F.col(label_col).alias("label"), name.alias("class_name"), "n"))


def most_frequent(df: DataFrame, group_cols: Sequence[str], value_col: str,
                  seq_col: str) -> DataFrame:
    """Most frequent value per group; ties go to the value seen first
    (smallest ``seq_col``). Aggregates only, no window."""
    g = list(group_cols)
    per = df.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("n"),
                                        F.min(seq_col).alias("first_seen"))
    best = per.groupBy(*g).agg(F.max_by(F.struct(value_col, "n"),
                                        F.struct(F.col("n"), -F.col("first_seen"))).alias("b"))
    return best.select(*g, F.col(f"b.{value_col}").alias(value_col), F.col("b.n").alias("n"))
