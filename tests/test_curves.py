"""Curves and metrics against brute force NumPy."""
import numpy as np
import pytest

from tessera.operators import curves as CV
from tessera.operators import metrics as MT


def _df(spark, rows):
    return spark.createDataFrame([(0,) + r for r in rows], "g int, score double, y_true int")


def test_aupr_tie_case(spark):
    df = _df(spark, [(0.9, 1), (0.9, 0), (0.2, 1)])
    assert abs(CV.pr_auc(df, ["g"]).first()["aupr"] - 2 / 3) < 1e-12


def test_auc_equals_rank_statistic(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 20, 300).astype(float)
    y = (rng.random(300) < 0.3 + s / 40).astype(int)
    auc = CV.roc_auc(_df(spark, list(zip(s.tolist(), y.tolist()))), ["g"]).first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12


def test_band_matches_numpy_interp(spark):
    rng = np.random.default_rng(2)
    rows, curves = [], []
    for r in range(4):
        s = rng.integers(0, 15, 80).astype(float)
        y = (rng.random(80) < 0.4).astype(int)
        rows += [(r, a, b) for a, b in zip(s.tolist(), y.tolist())]
    df = spark.createDataFrame([("e",) + x for x in rows], "embedding string, realization int, score double, y_true int")
    roc = CV.roc_points(df, ["embedding", "realization"]).toPandas()
    grid = np.linspace(0, 1, 100)
    for r in range(4):
        c = roc[roc.realization == r].sort_values("seq")
        v = np.interp(grid, c.fpr.to_numpy(), c.tpr.to_numpy())
        v[0] = 0.0
        curves.append(v)
    mean, std = np.mean(curves, axis=0), np.std(curves, axis=0)
    mean[-1] = 1.0
    band = CV.roc_band(spark.createDataFrame(roc)).toPandas().sort_values("i")
    assert np.allclose(band["mean"].to_numpy(), mean) and np.allclose(band["std"].to_numpy(), std)


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (1, 1, 0)], "g int, y_true int, y_pred int")
    m = {r.g: r for r in MT.binary_metrics(df, ["g"]).collect()}
    assert m[0].precision == 0.0 and m[0].recall == 0.0 and m[0].f1 == 0.0 and m[0].npv == 1.0
    assert m[1].specificity is None and m[1].recall == 0.0


def _numpy_points(s, y):
    """(k, fp, tp) of the distinct scores, highest first."""
    out, fp, tp = [], 0, 0
    for v in np.unique(s)[::-1]:
        tp, fp = tp + int(y[s == v].sum()), fp + int((1 - y)[s == v].sum())
        out.append((fp, tp))
    return out


@pytest.mark.parametrize("width,points", [(1.0, 4096), (1e-9, 3)])
def test_points_in_pieces(spark, monkeypatch, width, points):
    """Running totals over many pieces, for scores however close together."""
    monkeypatch.setattr(CV, "PIECE_POINTS", points)
    rng = np.random.default_rng(3)
    s = 0.5 + rng.integers(0, 200, 900) / 200 * width
    y = (rng.random(900) < 0.4).astype(int)
    df = _df(spark, list(zip(s.tolist(), y.tolist())))
    c = CV.score_counts(df, ["g"]).toPandas().sort_values("k")
    assert list(zip(c.fp, c.tp)) == _numpy_points(s, y) and c.k.tolist() == list(range(1, len(c) + 1))
    whole = CV.roc_points(df, ["g"], drop_intermediate=False).toPandas().sort_values("seq")
    kept = CV.roc_points(df, ["g"]).toPandas().sort_values("seq")
    pts = [(0, 0)] + _numpy_points(s, y)
    n, p = pts[-1]
    assert np.allclose(whole[["fpr", "tpr"]], [(a / n, b / p) for a, b in pts])
    keep = [i for i, (a, b) in enumerate(pts) if i in (0, 1, len(pts) - 1)
            or (pts[i + 1][0] - 2 * a + pts[i - 1][0], pts[i + 1][1] - 2 * b + pts[i - 1][1]) != (0, 0)]
    assert np.allclose(kept[["fpr", "tpr"]], [(pts[i][0] / n, pts[i][1] / p) for i in keep])
    assert kept.seq.tolist() == list(range(len(keep)))
    g = CV.interpolate(CV.roc_points(df, ["g"]), ["g"], "fpr", "tpr").toPandas().sort_values("i")
    assert np.allclose(g.gy, np.interp(np.linspace(0, 1, 100), kept.fpr, kept.tpr))


def test_auc_of_billions(spark):
    n = 3_000_000_000
    c = spark.createDataFrame([(0, n, 0, n, 0, n, n), (0, 0, n, n, n, n, n)],
                              "g int, p long, n long, tp long, fp long, n_pos long, n_neg long")
    assert CV.auc_of_counts(c, ["g"]).first()["auc"] == 1.0


def test_a_third_class_is_refused(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 2, 1)], "g int, y_true int, y_pred int")
    with pytest.raises(Exception, match="2 x 2"):
        MT.binary_metrics(df, ["g"]).collect()


def test_bands_from_predictions_equal_those_of_the_points(spark):
    rng = np.random.default_rng(6)
    rows = [(e, r, float(a), int(rng.random() < .2 + .05 * a)) for e in "ab" for r in range(3) for a in rng.integers(0, 12, 90)]
    rows += [("a", 3, float(i), int(i > 4)) for i in range(9)] + [("b", 3, 0.5, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "embedding string, realization int, score double, y_true int")
    k = ["embedding", "realization"]
    for of, want in ((CV.roc_band_of(df), CV.roc_band(CV.roc_points(df, k))), (CV.pr_band_of(df), CV.pr_band(CV.pr_points(df, k)))):
        a, b = (x.toPandas().sort_values(["embedding", "i"]) for x in (of, want))
        assert len(a) == len(b) == 200 and np.allclose(a[["x", "mean", "std", "upper", "lower"]], b[["x", "mean", "std", "upper", "lower"]])
    plan = CV.roc_band_of(df)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count(" Exchange ") <= 10
