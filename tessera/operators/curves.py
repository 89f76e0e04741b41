"""ROC / PR curves, areas and averaged bands.

Plan shape: predictions are first grouped by (curve, score) - a partial
aggregate, so a curve of billions of rows shrinks to its distinct scores
(forest votes: at most trees+1) - and only that small table is ordered by
windows. Bands need no join: every curve segment emits the grid points it
covers with ``sequence``/``explode``, so each curve costs points + grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CURVE_GRID
from ..functions.ranking import running_number, running_sums, with_next

# Pieces each curve's distinct scores are cut into, and points per piece of a numbered curve.
PIECES, PIECE_POINTS = 64, 4096


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "score",
                 y_true: str = "y_true") -> DataFrame:
    """Positives/negatives per (curve, distinct score), with running totals
    tp/fp in descending score order, the 1-based position k of the score and
    the curve totals n_pos/n_neg.

    The order is cut into pieces at quantiles of the curve's distinct scores
    (one bounded row per curve), so the pieces are even however narrow the
    range of the scores is."""
    keys = list(keys)
    s = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(y_true).cast("long")).alias("p"),
        F.sum((1 - F.col(y_true)).cast("long")).alias("n"))
    per = s.groupBy(*keys).agg(
        F.percentile_approx(F.col("score").cast("double"), [i / PIECES for i in range(1, PIECES)], 1000).alias("_q"),
        F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    # one row per curve (a run has embeddings x realizations of them), then PIECES per curve
    c = s.join(F.broadcast(per), keys).withColumn("_one", F.lit(1))
    piece = F.size(F.filter("_q", lambda q: q > F.col("score").cast("double")))
    c = running_sums(c, keys, [F.col("score").desc()], piece, ["p", "n", "_one"], few_pieces=True)
    return c.drop("_q", "_one").withColumnsRenamed({"p_cum": "tp", "n_cum": "fp", "_one_cum": "k"})


def _piece(pos: str):
    return F.floor(F.col(pos) / F.lit(PIECE_POINTS))


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", y_true: str = "y_true",
               drop_intermediate: bool = True) -> DataFrame:
    """(keys, seq, fpr, tpr); seq 0 is the (0, 0) start. Interior points
    whose fp and tp second differences are both zero are dropped, as the
    usual ROC routine does."""
    keys = list(keys)
    c = score_counts(df, keys, score, y_true)
    if drop_intermediate:
        # the second difference at a point is the next point's step minus its own
        c = with_next(c, keys, "k", _piece("k"), ["p", "n"])
        c = c.where(F.col("p_next").isNull() | (F.col("k") == 1)
                    | (F.col("p_next") != F.col("p")) | (F.col("n_next") != F.col("n")))
    # the first score also emits the start point; the kept points are renumbered 0.. in order
    point = lambda k, fp, tp: F.struct(*[v.cast("long").alias(n) for n, v in (("k", k), ("fp", fp), ("tp", tp))])
    own, zero = point(F.col("k"), F.col("fp"), F.col("tp")), F.lit(0)
    pts = c.select(*keys, "n_pos", "n_neg", F.explode(
        F.when(F.col("k") == 1, F.array(point(zero, zero, zero), own)).otherwise(F.array(own))).alias("_p"))
    allp = running_number(pts.select(*keys, "n_pos", "n_neg", "_p.*"), keys, ["k"], _piece("k"), "_seq")
    return allp.select(*keys, (F.col("_seq") - 1).cast("int").alias("seq"),
                       F.try_divide(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"),
                       F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"))


def auc_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G5 on ``score_counts`` rows. Exact integer sums of 38 digits: the products outgrow a
    long from a few billion rows on."""
    wide = lambda x: F.expr(x).cast("decimal(19,0)")
    # the previous point is the running total before this score: no lag
    area = F.sum((wide("n") * wide("2 * tp - p")).cast("decimal(38,0)"))
    whole = wide("max(n_pos)") * wide("max(n_neg)")
    return counts.groupBy(*keys).agg(F.try_divide(area.cast("double"), whole.cast("double") * 2).alias("auc"))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str = "score", y_true: str = "y_true") -> DataFrame:
    """Trapezoid area under the ROC curve, one division."""
    return auc_of_counts(score_counts(df, keys, score, y_true), keys)


def pr_points(df: DataFrame, keys: Sequence[str], score: str = "score", y_true: str = "y_true",
              stop_at_full_recall: bool = False) -> DataFrame:
    """(keys, seq, recall, precision) in increasing-recall order; seq 0 is
    the (0, 1) anchor, then one point per distinct score, highest first."""
    keys = list(keys)
    c = score_counts(df, keys, score, y_true)
    if stop_at_full_recall:
        ff = c.groupBy(*keys).agg(F.min(F.when(F.col("tp") == F.col("n_pos"), F.col("k"))).alias("_ff"))
        c = c.join(ff, keys).where(F.col("k") <= F.col("_ff")).drop("_ff")
    # the first score also emits the anchor
    own = F.struct(F.col("k").cast("int").alias("seq"),
                   F.try_divide(F.col("tp").cast("double"), F.col("n_pos")).alias("recall"),
                   F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
                              F.lit(0.0)).alias("precision"))
    anchor = F.struct(F.lit(0).alias("seq"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return c.select(*keys, F.explode(F.when(F.col("k") == 1, F.array(anchor, own)).otherwise(F.array(own)))
                    .alias("_p")).select(*keys, "_p.*")


def pr_auc(df: DataFrame, keys: Sequence[str], score: str = "score", y_true: str = "y_true") -> DataFrame:
    """Trapezoid area under the PR curve from the (0, 1) anchor."""
    keys = list(keys)
    c = score_counts(df, keys, score, y_true)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    prec = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    c = c.withColumn("prec", prec).withColumn("tp0", tp0) \
         .withColumn("prec0", F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0.cast("double") / (tp0 + fp0)))
    area = F.sum((F.col("tp") - F.col("tp0")) * (F.col("prec") + F.col("prec0")))
    return c.groupBy(*keys).agg(F.try_divide(area, (F.max("n_pos") * 2).cast("double")).alias("aupr"))


def _grid_x(i):
    """x of grid point i on an evenly spaced [0, 1] grid (last point exactly 1)."""
    step = 1.0 / (CURVE_GRID - 1)
    return F.when(i == CURVE_GRID - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(step))


def interpolate(points: DataFrame, keys: Sequence[str], x: str, y: str, seq: str = "seq") -> DataFrame:
    """Piecewise-linear value of each curve at every grid point: (keys, i, gx, gy).

    Left of the first point: first y; from the last point on: last y; at a
    repeated x the last point at that x wins. The line is cut into pieces -
    before the first point, each rising segment [x_j, x_j+1), from the last
    point on - and each piece emits only the grid indices it covers (no join)."""
    keys = list(keys)
    s = points.select(*keys, F.col(seq).alias("_seq"), F.col(x).alias("x0"), F.col(y).alias("y0"))
    s = with_next(s, keys, "_seq", _piece("_seq"), ["x0", "y0"]) \
        .withColumnsRenamed({"x0_next": "x1", "y0_next": "y1"})
    last = CURVE_GRID - 1
    x0, x1 = F.col("x0"), F.col("x1")
    near = lambda v, d: F.least(F.greatest(F.floor(v * last).cast("int") + d, F.lit(0)), F.lit(last))
    main = F.when(x1.isNull(), F.struct(F.lit(1).alias("kind"), near(x0, -1).alias("lo"), F.lit(last).alias("hi"))) \
            .when(x1 > x0, F.struct(F.lit(0).alias("kind"), near(x0, -1).alias("lo"), near(x1, 2).alias("hi")))
    before = F.when(F.col("is_first"), F.struct(F.lit(2).alias("kind"), F.lit(0).alias("lo"), near(x0, 2).alias("hi")))
    pieces = F.filter(F.array(main, before), lambda p: p.isNotNull())
    e = (s.select("*", F.explode(pieces).alias("p"))
          .select("*", F.explode(F.sequence("p.lo", "p.hi")).alias("i"))
          .withColumn("gx", _grid_x(F.col("i"))))
    g, kind = F.col("gx"), F.col("p.kind")
    inside = (((kind == 0) & (g >= x0) & (g < x1)) | ((kind == 1) & (g >= x0)) | ((kind == 2) & (g < x0)))
    gy = F.when(kind == 0, F.col("y0") + (F.col("y1") - F.col("y0")) * (g - x0) / (x1 - x0)) \
          .otherwise(F.col("y0"))
    return e.where(inside).select(*keys, "i", "gx", gy.alias("gy"))


def _segments_on_grid(counts: DataFrame, keys: Sequence[str], x0, y0, x1, y1) -> DataFrame:
    """(keys, i, gx, gy) of curves whose rows are their own segments: a score's row holds the point
    before it (its totals less its own counts) and the point after it. Nothing has to look at a
    neighbour, so the running totals are the only scan. The first segment begins at x = 0; points in
    line with their neighbours make no difference to the line."""
    last = CURVE_GRID - 1
    s = counts.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
                      ((F.col("tp") == F.col("n_pos")) & (F.col("fp") == F.col("n_neg"))).alias("_end"))
    near = lambda v, d: F.least(F.greatest(F.floor(v * last).cast("int") + d, F.lit(0)), F.lit(last))
    lo, hi = near(F.col("x0"), -1), F.when(F.col("_end"), F.lit(last)).otherwise(near(F.col("x1"), 2))
    e = (s.where((F.col("x1") > F.col("x0")) | F.col("_end"))
          .select("*", F.explode(F.sequence(lo, hi)).alias("i")).withColumn("gx", _grid_x(F.col("i"))))
    g, rising = F.col("gx"), (F.col("gx") >= F.col("x0")) & (F.col("gx") < F.col("x1"))
    gy = F.when(rising, F.col("y0") + (F.col("y1") - F.col("y0")) * (g - F.col("x0")) / (F.col("x1") - F.col("x0"))) \
          .otherwise(F.col("y1"))
    return e.where(rising | (F.col("_end") & (g >= F.col("x1")))).select(*keys, "i", "gx", gy.alias("gy"))


def roc_band_of(df: DataFrame, keys: Sequence[str] = ("embedding",), member: str = "realization",
                score: str = "score", y_true: str = "y_true") -> DataFrame:
    """G9 from predictions: ``roc_band`` of their curves without building the points."""
    ks = [*keys, member]
    part = lambda a, b: F.try_divide(a.cast("double"), F.col(b))
    c = score_counts(df, ks, score, y_true)
    it = _segments_on_grid(c, ks, part(F.col("fp") - F.col("n"), "n_neg"), part(F.col("tp") - F.col("p"), "n_pos"),
                           part(F.col("fp"), "n_neg"), part(F.col("tp"), "n_pos"))
    return _averaged(it, keys, 0.0, 1.0)


def pr_band_of(df: DataFrame, keys: Sequence[str] = ("embedding",), member: str = "realization",
               score: str = "score", y_true: str = "y_true") -> DataFrame:
    """G10 from predictions: ``pr_band`` of their curves without building the points."""
    ks = [*keys, member]
    c = score_counts(df, ks, score, y_true)
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    it = _segments_on_grid(c, ks, F.try_divide(tp0.cast("double"), F.col("n_pos")),
                           F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(F.try_divide(tp0.cast("double"), tp0 + fp0)),
                           F.try_divide(F.col("tp").cast("double"), F.col("n_pos")),
                           F.col("tp").cast("double") / (F.col("tp") + F.col("fp")))
    return _averaged(it, keys, 1.0, None)


def band(points: DataFrame, keys: Sequence[str], member: str, x: str, y: str,
         first_value: float | None, last_mean: float | None) -> DataFrame:
    """Per (keys, grid point) mean, population std and the band
    clipped to [0, 1]. ``first_value`` forces every curve's first grid value;
    ``last_mean`` forces the mean (not the std) at the last grid point."""
    return _averaged(interpolate(points, [*keys, member], x, y), keys, first_value, last_mean)


def _averaged(it: DataFrame, keys: Sequence[str], first_value: float | None, last_mean: float | None) -> DataFrame:
    keys = list(keys)
    if first_value is not None:
        it = it.withColumn("gy", F.when(F.col("i") == 0, F.lit(float(first_value))).otherwise(F.col("gy")))
    b = it.groupBy(*keys, "i").agg(F.first("gx").alias("x"), F.avg("gy").alias("mean"),
                                   F.stddev_pop("gy").alias("std"))
    if last_mean is not None:
        b = b.withColumn("mean", F.when(F.col("i") == CURVE_GRID - 1, F.lit(float(last_mean)))
                         .otherwise(F.col("mean")))
    return b.select(*keys, "i", "x", "mean", "std",
                    F.least(F.col("mean") + F.col("std"), F.lit(1.0)).alias("upper"),
                    F.greatest(F.col("mean") - F.col("std"), F.lit(0.0)).alias("lower"))


def roc_band(roc: DataFrame, keys: Sequence[str] = ("embedding",), member: str = "realization") -> DataFrame:
    """Averaged ROC curve; first value 0, mean at the end 1."""
    return band(roc, keys, member, "fpr", "tpr", 0.0, 1.0)


def pr_band(pr: DataFrame, keys: Sequence[str] = ("embedding",), member: str = "realization") -> DataFrame:
    """Averaged PR curve on increasing recall; first value 1."""
    return band(pr, keys, member, "recall", "precision", 1.0, None)


def no_skill(df: DataFrame, keys: Sequence[str] = ("embedding",), member: str = "realization",
             y_true: str = "y_true") -> DataFrame:
    """Positive share per member, averaged per key."""
    keys = list(keys)
    per = df.groupBy(*keys, member).agg(F.avg(F.col(y_true).cast("double")).alias("p"))
    return per.groupBy(*keys).agg(F.avg("p").alias("no_skill"))


def compare_embeddings(band_df: DataFrame, value: str = "mean", key: str = "embedding",
                       values: Sequence[str] = ("tf_idf", "d2v")) -> DataFrame:
    """Bands of both embeddings side by side, one row per grid point."""
    return band_df.groupBy("i").pivot(key, list(values)).agg(F.first(value))
