"""Running sums, neighbours and numbers without one window per (possibly huge) group.

Two levels: a ``bucket`` expression that is monotone in the sort order cuts
each group into pieces; one small aggregate gives per-bucket totals, their
prefix sums give each bucket's offset, and the window runs only inside a
(group, bucket) piece. The offset table has one row per non-empty bucket.
Where no expression cuts the order evenly (words, tied counts), ``ordered_number``
takes the pieces from a range partitioning of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column,
                 values: Sequence[str], bucket_desc: bool = False, suffix: str = "_cum",
                 few_pieces: bool = False) -> DataFrame:
    """Adds ``<value><suffix>``: the sum of ``value`` over the rows of the
    group up to and including this row in ``order``. ``bucket`` must grow
    with ``order`` (or shrink, with ``bucket_desc``). ``few_pieces``: groups and
    buckets are bounded in number, so their offsets are broadcast."""
    g = list(group)
    x = df.withColumn("_bk", bucket)
    tot = x.groupBy(*g, "_bk").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    bo = F.col("_bk").desc() if bucket_desc else F.col("_bk")
    wb = Window.partitionBy(*g).orderBy(bo).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for v in values:
        tot = tot.withColumn(f"_o_{v}", F.sum(f"_t_{v}").over(wb) - F.col(f"_t_{v}")).drop(f"_t_{v}")
    wi = Window.partitionBy(*g, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = x.join(F.broadcast(tot) if few_pieces else tot, g + ["_bk"])
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.sum(v).over(wi)).drop(f"_o_{v}")
    return out.drop("_bk")


def running_number(df: DataFrame, group: Sequence[str], order: Sequence, bucket: Column,
                   out_col: str = "n") -> DataFrame:
    """1-based row number per group in ``order`` (bucket monotone in order)."""
    x = df.withColumn("_one", F.lit(1))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return running_sums(x, group, order_cols, bucket, ["_one"]).withColumnRenamed("_one_cum", out_col).drop("_one")


def with_next(df: DataFrame, group: Sequence[str], pos: str, bucket: Column, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_next``: the value on the group's next row in ``pos`` order, NULL on its last,
    and ``is_first``. Inside a bucket by ``lead``; a bucket's last row takes the first row of the
    next bucket from the small bucket table."""
    g = list(group)
    x = df.withColumn("_bk", bucket)
    heads = x.groupBy(*g, "_bk").agg(F.min_by(F.struct(*cols), F.col(pos)).alias("_head"))
    wb = Window.partitionBy(*g).orderBy("_bk")
    heads = heads.select(*g, "_bk", F.lead("_head").over(wb).alias("_after"),
                         (F.row_number().over(wb) == 1).alias("_front"))
    wi = Window.partitionBy(*g, "_bk").orderBy(pos)
    out = x.join(heads, g + ["_bk"]).withColumn("_in", F.lead(F.struct(*cols)).over(wi)) \
           .withColumn("is_first", F.col("_front") & (F.row_number().over(wi) == 1))
    nxt = F.coalesce(F.col("_in"), F.col("_after"))
    return out.select(*df.columns, "is_first", *[nxt[c].alias(f"{c}_next") for c in cols])


def ordered_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], out_col: str = "n") -> DataFrame:
    """1-based row number per group in ``order``, for orders that no expression cuts evenly.

    The rows are range-partitioned by (group, order), so a piece is a range
    partition whatever the values' distribution; the partitioning is written
    once, since a range partitioning drawn anew may cut elsewhere."""
    g = list(group)
    x = df.repartitionByRange(*[F.col(c) for c in g], *order).withColumn("_bk", F.spark_partition_id())
    return running_number(cut_lineage(x), g, list(order), F.col("_bk"), out_col)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    spread_key: Column, buckets: int = 64, out_col: str = "pos") -> DataFrame:
    """The first k rows per group in ``order`` (1-based ``out_col``), in two
    rounds: top k inside each (group, hash bucket of ``spread_key``), then top
    k over the at most buckets x k survivors. Exact: a row in the group's top
    k is in its bucket's top k."""
    g = list(group)
    x = df.withColumn("_sb", F.pmod(F.xxhash64(spread_key), F.lit(buckets)))
    first = x.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "_sb").orderBy(*order))) \
             .where(F.col("_r") <= k).drop("_r", "_sb")
    return first.withColumn(out_col, F.row_number().over(Window.partitionBy(*g).orderBy(*order))) \
                .where(F.col(out_col) <= k)
