"""Matrix methods, fits and edge rows against numpy, and the differences between reference and paper forms."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special, vec
from tidemark.operators import aggregations, drift, ensembles, features, gmm, gram, lifecycle, logits, metrics, preprocess
from tidemark.plans import pipelines
from tidemark.plans.fixtures import fit_rows, probe_rows
from tidemark.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def arrays(spark, data):
    fit = fit_rows(spark, data).toPandas()
    test = probe_rows(spark, data).orderBy("domain", "id").toPandas()
    return np.array(fit.x.tolist()), fit.label.to_numpy(), np.array(test.x.tolist()), test


def scores(df):
    return df.orderBy("domain", "id").toPandas().score.to_numpy()


def pooled(x, y):
    mus = np.stack([x[y == c].mean(0) for c in np.unique(y)])
    centred = np.concatenate([x[y == c] - x[y == c].mean(0) for c in np.unique(y)])
    return mus, centred.T @ centred / len(x)


@pytest.mark.parametrize("semantics", ["reference", "paper"])
def test_mahalanobis(spark, data, semantics):
    x, y, t, _ = arrays(spark, data)
    mus, cov = pooled(x, y)
    cov = cov + 1e-6 * np.eye(len(cov))
    a = np.linalg.inv(np.linalg.cholesky(cov)).T if semantics == "reference" else np.linalg.inv(cov)
    d = np.stack([np.einsum("ij,jk,ik->i", t - m, a, t - m) for m in mus], 1)
    with np.errstate(invalid="ignore"):
        want = -np.nan_to_num(np.sqrt(d).min(1), nan=1e6)
    got = scores(features.mahalanobis(probe_rows(spark, data), fit_rows(spark, data), semantics=semantics))
    assert np.allclose(got, want, rtol=1e-6, atol=1e-7)


def test_mahalanobis_nan_is_a_million(spark):
    fit = frame(spark, [(i, [float(a), float(b)], 0) for i, (a, b) in enumerate([(0, 0), (1, 2), (2, 1), (3, 5), (4, 3)])], "id long, x array<double>, label int")
    assert not features.mahalanobis(fit, fit).where(F.isnan("score")).count()


def test_mean_squared_distance_is_the_dimension(spark, data):
    fit = fit_rows(spark, data)
    classes = gram.moments(fit, "label")
    mus, scatter, n = gram.pooled(classes)
    x, y, _, _ = arrays(spark, data)
    centred = np.concatenate([x[y == c] - mus[i] for i, c in enumerate(np.unique(y))])
    inv = np.linalg.pinv(scatter / n)
    assert abs(np.einsum("ij,jk,ik->i", centred, inv, centred).mean() - np.linalg.matrix_rank(scatter)) < 1e-6


def test_relative_mahalanobis(spark, data):
    x, y, t, _ = arrays(spark, data)
    mus, cov = pooled(x, y)
    inv, binv, bm = np.linalg.pinv(cov), np.linalg.pinv(np.cov(x.T)), x.mean(0)
    near = np.stack([np.sqrt(np.einsum("ij,jk,ik->i", t - m, inv, t - m)) for m in mus], 1)
    far = np.sqrt(np.einsum("ij,jk,ik->i", t - bm, binv, t - bm))
    got = scores(features.relative_mahalanobis(probe_rows(spark, data), fit_rows(spark, data)))
    assert np.allclose(got, -(near - far[:, None]).min(1), rtol=1e-6)


def test_vim(spark, data):
    x, y, t, _ = arrays(spark, data)
    mus = np.stack([x[y == c].mean(0) for c in np.unique(y)])
    w, b = 10 * mus, -5 * (mus**2).sum(1)
    u = -np.linalg.pinv(w) @ b
    values, vectors = np.linalg.eigh((x - u).T @ (x - u) / len(x))
    r = vectors[:, np.argsort(-values)[20:]]
    alpha = (x @ w.T + b).max(1).mean() / np.linalg.norm((x - u) @ r, axis=1).mean()
    z = t @ w.T + b
    want = np.log(np.exp(z).sum(1)) - alpha * np.linalg.norm((t - u) @ r, axis=1)
    assert np.allclose(scores(features.vim(probe_rows(spark, data), fit_rows(spark, data), w, b, 20)), want, rtol=1e-6)
    assert (scores(features.vim(probe_rows(spark, data), fit_rows(spark, data), w, b)) == 1e6).all()  # empty residual, as published


def test_gmm_reference_is_one_gaussian(spark, data):
    x, _, t, _ = arrays(spark, data)
    m = gmm.fit(fit_rows(spark, data), 3)
    assert m.converged and m.iterations <= 3 and np.allclose(m.means, x.mean(0))
    cov = np.cov(x.T, bias=True)
    cov = cov + 1e-6 * np.trace(cov) * np.eye(len(cov))
    d = t - x.mean(0)
    want = -0.5 * (len(cov) * np.log(2 * np.pi) + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    assert np.allclose(m.score_samples(t), want, rtol=1e-6)


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_gmm_paper_separates(spark, kind):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0, 5, 10)])
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    m = gmm.fit(df, 3, kind, semantics="paper")
    assert m.means.shape == (3, 2) and m.predict_proba(x).sum(1) == pytest.approx(np.ones(180))
    assert m.aic(-1.0, 180) < m.bic(-1.0, 180) and m.sample(50).shape == (50, 2)
    with pytest.raises(NotImplementedError):
        gmm.fit(df, 3, init="kmeans")
    with pytest.raises(ValueError):
        gmm.fit(df.limit(2), 3)
    with pytest.raises(ValueError):
        gmm.require_fitted(None)


def test_covariance_estimators():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    s = (x - x.mean(0)).T @ (x - x.mean(0))
    for method in ("EmpiricalCovariance", "ShrunkCovariance", "OAS", "GraphicalLasso", "GraphicalLassoCV"):
        c = gram.covariance(s, 200, method)
        assert np.allclose(c, c.T) and (np.linalg.eigvalsh(c) > 0).all(), method
    assert np.allclose(gram.covariance(s, 200, "ShrunkCovariance", shrinkage=1.0), np.trace(s / 200) / 5 * np.eye(5))
    inv = np.linalg.inv(s / 200)
    for method in ("cholesky", "svd"):
        r = gram.reduction_matrix(s / 200, method)
        assert np.allclose(r @ r.T, inv)
    with pytest.raises(ValueError):
        gram.covariance(s, 200, "nothing")


def test_ledoit_wolf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    df = frame(spark, [(0, [float(v) for v in r]) for r in x], "label int, x array<double>")
    c = x - x.mean(0)
    s = c.T @ c / 80
    mu = np.trace(s) / 4
    delta = ((s - mu * np.eye(4)) ** 2).sum() / 4
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / 80**2 / 4, delta)
    k = beta / delta
    assert np.allclose(gram.covariance(s * 80, 80, "LedoitWolf", df, {0: x.mean(0)}), (1 - k) * s + k * mu * np.eye(4), rtol=1e-8)


def test_gradnorm_closed_form(spark):
    rng = np.random.default_rng(3)
    w, b, h = rng.normal(size=(4, 6)), rng.normal(size=4), rng.normal(size=6)

    def loss(m):
        z = m @ h + b
        return -(z - np.log(np.exp(z).sum())).sum()

    g = np.zeros_like(w)
    for i in np.ndindex(*w.shape):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        g[i] = (loss(up) - loss(down)) / 2e-6
    df = frame(spark, [([float(v) for v in w @ h + b], [float(v) for v in h])], "z array<double>, x array<double>")
    assert df.select(logits.gradnorm(F.col("z"), F.col("x"))).first()[0] == pytest.approx(np.abs(g).sum(), rel=1e-6)


def test_perturbation_gradients(spark):
    rng = np.random.default_rng(4)
    w, x = rng.normal(size=(3, 5)), rng.normal(size=5)
    df = frame(spark, [([float(v) for v in x], [float(v) for v in w @ x], [[float(v) for v in r] for r in w])], "x array<double>, z array<double>, w array<array<double>>")
    fns = {"energy": lambda v: np.log(np.exp(w @ v).sum()), "doctor": lambda v: ((np.exp(w @ v) / np.exp(w @ v).sum()) ** 2).sum() - 1}
    for name, fn in fns.items():
        g = np.array([(fn(x + 1e-6 * e) - fn(x - 1e-6 * e)) for e in np.eye(5)])
        got = np.array(df.select(logits.perturbed(F.col("x"), F.col("z"), F.col("w"), name, 0.5, 1.0)).first()[0])
        assert np.allclose(got, x + 0.5 * np.sign(g))
    with pytest.raises(ValueError):
        logits.perturbed(F.col("x"), F.col("z"), F.col("w"), "msp", 0.1, 1.0)


def test_mcdropout_reference_can_exceed_one(spark):
    rows = frame(spark, [(1, [1.0] * 40, [[5.0] * 40, [-5.0] * 40], [0.0, 0.0])], "id long, x array<double>, w array<array<double>>, b array<double>")
    ref, paper = (logits.mcdropout(rows, semantics=s).first().score for s in ("reference", "paper"))
    assert paper == pytest.approx(1.0) and ref == pytest.approx(1.2)


def test_mcdropout_of_many_classes(spark):
    d, classes, rng = 128, 40, np.random.default_rng(3)
    w, b, x = rng.normal(size=(classes, d)), rng.normal(size=classes), rng.normal(size=(8, d))
    rows = frame(spark, [(i, r.tolist(), w.tolist(), b.tolist()) for i, r in enumerate(x)], "id long, x array<double>, w array<array<double>>, b array<double>")
    began = time.monotonic()
    got = {r.id: r.score for r in logits.mcdropout(rows.repartition(2), semantics="paper").select("id", "score").collect()}
    assert time.monotonic() - began < 10  # masks and logits are computed once a pass, not once for each class and feature
    for i, r in enumerate(x):
        p = []
        for k in range(5):
            digits = "".join(hashlib.md5(f"drop:{k}:{j}:{i}".encode()).hexdigest() for j in range(d // 32 + 1))
            z = w @ np.array([2 * v if c >= "8" else 0.0 for v, c in zip(r, digits)]) + b
            p.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        assert got[i] == pytest.approx(np.mean(p, axis=0).max())


def test_mcdropout_of_one_head_by_batch(spark):
    """A head for all rows gives the scores of the same head in each row, odd rows too; its passes don't take Spark's lambdas."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    for d in (5, 70):
        w, b = rng.normal(size=(3, d)).tolist(), rng.normal(size=3).tolist()
        x = [r.tolist() for r in rng.normal(size=(40, d))]
        x[1], x[2], x[3], x[4], x[5] = None, [], [1.0] * (d + 1), [None, *x[4][1:]], [nan, *x[5][1:]]
        x[6], x[7], x[8] = [inf, *x[6][1:]], [None] * d, [v * 1e200 for v in x[8]]
        ids = [None if i == 20 else i for i in range(len(x))]
        kinds = "w array<array<double>>, b array<double>"
        rows = frame(spark, [(n, i, v) for n, (i, v) in enumerate(zip(ids, x))], "n int, id long, x array<double>").repartition(3)
        odd = [([], []), ([[*w[0][:-1], None], *w[1:]], b), (w, b[:-1])]
        for head, semantics in [((w, b), "reference"), ((w, b), "paper"), *((h, "paper") for h in odd[: 3 if d == 5 else 0])]:
            one = frame(spark, [head], kinds)
            got = {r.n: r.score for r in logits.mcdropout(rows, semantics=semantics, head=one).collect()}
            want = {r.n: r.score for r in logits.mcdropout(rows.crossJoin(one), semantics=semantics).collect()}
            assert len(got) == len(x) and got == pytest.approx(want, nan_ok=True)
            assert {n for n in got if got[n] is None} == {n for n in want if want[n] is None}
    plan = logits.mcdropout(rows, head=frame(spark, [(w, b)], kinds))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate" not in plan


def test_kl_matching_unseen_class_raises(spark):
    df = frame(spark, [(1, [5.0, 0.0])], "id long, z array<double>")
    other = frame(spark, [(1, [0.5, 0.5])], "pred int, q array<double>")
    with pytest.raises(Exception, match="without a centroid"):
        logits.kl_matching(df, other).collect()


# ---------------------------------------------------------------- metrics


def brute_metrics(score, label):
    order = np.argsort(-score, kind="stable")
    s, y = score[order], label[order]
    last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tps, fps = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    thr = s[last]
    precision, recall = tps / (tps + fps), tps / tps[-1]
    aupr = np.trapezoid(np.append(1, precision), np.append(0, recall))
    out = np.trapezoid(np.append(1, fps / (tps + fps)), np.append(0, fps / fps[-1]))
    if len(last) > 2:
        keep = np.concatenate([[True], (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), [True]])
        tps, fps, thr = tps[keep], fps[keep], thr[keep]
    tpr, fpr = np.append(0, tps / tps[-1]), np.append(0, fps / fps[-1])
    i = np.flatnonzero(tpr >= 0.95)[0]
    t = np.append(np.inf, thr)[i]
    pos = label.mean()
    pred = score > t
    f1 = 2 * (pred & (label == 1)).sum() / max(1, pred.sum() + label.sum())
    return {"auroc": np.trapezoid(tpr, fpr), "aupr_in": aupr, "aupr_out": out, "fpr_at_tpr": fpr[i], "thr": t, "f1": f1, "detection_error": (pos * (1 - tpr) + (1 - pos) * fpr).min()}


@pytest.mark.parametrize("seed,levels", [(0, 1000), (1, 5), (2, 2), (3, 40)])
def test_metrics_with_ties(spark, seed, levels):
    rng = np.random.default_rng(seed)
    score, label = rng.integers(0, levels, 400).astype(float), rng.integers(0, 2, 400)
    df = frame(spark, [("m", i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))], "method string, id long, score double, label int")
    got = metrics.ood_results(df, ["method"]).first().asDict()
    for k, v in brute_metrics(score, label).items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    flipped = metrics.ood_results(df.withColumn("score", -F.col("score")), ["method"]).first().auroc
    assert got["auroc"] + flipped == pytest.approx(1.0)


def test_metrics_vertical_run_at_the_level(spark):
    # points between two ends of a straight run are dropped, so the threshold is that of the run's end
    rows = [("m", i, float(100 - i), 1) for i in range(40)] + [("m", 99, 0.0, 0)]
    r = metrics.ood_results(frame(spark, rows, "method string, id long, score double, label int"), ["method"]).first()
    assert r.thr == 61.0 and r.fpr_at_tpr == 0.0


def test_metrics_one_class_and_empty(spark):
    schema = "method string, id long, score double, label int"
    r = metrics.ood_results(frame(spark, [("m", 1, 1.0, 1), ("m", 2, None, 0)], schema), ["method"]).first()
    assert r.n_in == 1 and r.auroc is None
    assert metrics.ood_results(frame(spark, [], schema), ["method"]).count() == 0


def test_risk_coverage_against_loops(spark):
    rng = np.random.default_rng(5)
    score, label = rng.integers(0, 30, 200).astype(float), rng.integers(0, 2, 200)
    df = frame(spark, [("m", i, float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))], "method string, id long, score double, label int")
    for leq in (False, True):
        got = {r.thr: (r.coverage, r.risk) for r in metrics.risk_coverage(df, ["method"], n=None, leq=leq).collect()}
        for t in np.unique(score):
            c = score <= t if leq else score > t
            if c.any():
                assert got[t] == pytest.approx((c.mean(), label[c].mean()))
            else:
                assert t not in got


def test_plugin_bb_against_loops(spark):
    rng = np.random.default_rng(6)
    sc, ood, label = rng.random(120).round(2), (rng.random(120) + 1).round(2), rng.integers(0, 2, 120)
    df = frame(spark, [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(sc, ood, label))], "id long, sc double, ood double, label int")
    got = {round(r.brej, 3): r for r in metrics.plugin_bb(df, n=11).collect()}
    pi = (label == 0).mean()
    low = min(0, 0.75 / (1 - pi), -0.25 / (1 - pi), 1 / pi) - 1
    high = max(-0.25 / (1 - pi), 1 / pi, low, 0.75 / (1 - pi)) + 1
    lam = low + np.arange(1000) * ((high - low) / 999)
    c_in, c_out = lam * pi, 0.75 - lam * (1 - pi)
    rej = ((1 - c_in - c_out)[:, None] * sc + c_out[:, None] * (1 / (ood + 1e-7)) < (1 - 2 * c_in - c_out)[:, None]).mean(1)
    for b in np.linspace(0, 1, 11):
        i = int(((rej - b) ** 2).argmin())
        assert got[round(b, 3)].lbd == pytest.approx(lam[i]) and got[round(b, 3)].coverage == pytest.approx(1 - rej[i])


# ---------------------------------------------------------------- aggregations, p-values, preprocessors


def stack_frame(spark, m):
    return frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, s array<double>")


def test_p_values_against_interp(spark):
    rng = np.random.default_rng(7)
    ref, test = rng.normal(size=(150, 3)).round(1), rng.normal(size=(60, 3)).round(1) * 3
    got = np.array([r.p for r in aggregations.p_values(stack_frame(spark, test), stack_frame(spark, ref)).orderBy("id").collect()])
    for j in range(3):
        x = ref[:, j]
        lo, hi = x.min() * (1 / 150 if x.min() > 0 else 150), x.max() * (150 if x.max() > 0 else 1 / 150)
        xs = np.sort(np.concatenate([[lo], x, [hi]]))
        assert np.allclose(got[:, j], np.maximum(np.interp(test[:, j], xs, np.arange(1, 153) / 152), 1e-8), atol=1e-12)


def test_combiners_are_symmetric(spark):
    a = frame(spark, [([0.1, 0.5, 0.9],), ([0.9, 0.1, 0.5],)], "p array<double>")
    for name in aggregations.COMBINERS:
        x, y = (r[0] for r in a.select(aggregations.combiner(name.upper())(F.col("p"))).collect())
        assert x == pytest.approx(y), name
    with pytest.raises(NotImplementedError):
        aggregations.combiner("nothing")


def test_special_functions(spark):
    from statistics import NormalDist

    df = frame(spark, [(p,) for p in (1e-8, 0.01, 0.3, 0.5, 0.99)], "p double")
    for r in df.select("p", special.normal_ppf(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)
    got = df.select(special.normal_cdf(F.lit(1.0)), special.chi2_cdf_even(F.lit(4.0), 2)).first()
    assert got[0] == pytest.approx(NormalDist().cdf(1.0), abs=1e-6) and got[1] == pytest.approx(1 - math.exp(-2) * 3)


def test_stateless_aggregations_edge_rows(spark):
    df = frame(spark, [([1.0, float("nan"), 3.0],), ([2.0, 2.0],)], "s array<double>")
    a, b = df.select(aggregations.least(F.col("s")), aggregations.median(F.col("s"))).collect()
    assert math.isnan(a[0]) and math.isnan(a[1]) and tuple(b) == (2.0, 2.0)


def test_numeric_aggregations(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3))
    fit, far = stack_frame(spark, x), stack_frame(spark, np.concatenate([x[:20], np.full((5, 3), 9.0)]))
    for name in ("mahalanobis", "lof", "if"):
        s = aggregations.aggregate_stack(far, fit, name).orderBy("id").toPandas().score.to_numpy()
        assert s[20:].max() < np.median(s[:20]), name
    q = aggregations.aggregate_stack(fit, fit, "quantile").toPandas().score
    assert abs(q.mean()) < 0.05
    lam, m, sd = aggregations.power_fit(stack_frame(spark, np.exp(x)), "s")[0]
    y = aggregations.yeo_johnson(np.exp(x[:, 0]), lam)
    assert m == pytest.approx(y.mean()) and sd == pytest.approx(y.std()) and lam < 0.5
    with pytest.raises(ValueError):
        aggregations.aggregate_stack(fit, fit, "nothing")


@pytest.mark.parametrize("rows", [37, 50_000])
def test_lof_brute_force(spark, rows):
    """Every fit row counts, copies as often as they occur, whatever number of rows is held at a time."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(130, 3)), rng.normal(size=(70, 3)) * 0.1 + 4])
    x = np.concatenate([x, x[:15], np.repeat(x[20:21], 12, 0)])
    q = np.concatenate([x[:30], rng.normal(size=(30, 3)) * 3])
    n = 20

    def nearest(a, own):
        d = np.sqrt(((a[:, None] - x[None]) ** 2).sum(2))
        if own:
            np.fill_diagonal(d, np.inf)
        i = np.argsort(d, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(d, i, 1), i

    d, i = nearest(x, True)
    k_dist = d[:, -1]
    lrd = 1 / (np.maximum(d, k_dist[i]).mean(1) + 1e-10)
    d, i = nearest(q, False)
    want = -lrd[i].mean(1) * (np.maximum(d, k_dist[i]).mean(1) + 1e-10)
    got = aggregations.lof(stack_frame(spark, q), stack_frame(spark, x), n=n, rows=rows)
    assert got.columns == ["id", "s", "score"]
    assert got.orderBy("id").toPandas().score.to_numpy() == pytest.approx(want, rel=1e-9)


def test_preprocessors_zero_range(spark):
    df = stack_frame(spark, [[1.0, 5.0], [1.0, 7.0]])
    for name, want in (("minmax", [0.0, 0.0]), ("standard", [0.0, -1.0]), ("maxabs", [1.0, 5 / 7])):
        assert preprocess.PREPROCESSORS[name](df, df).orderBy("id").first().s == pytest.approx(want), name


def test_losses():
    rng = np.random.default_rng(9)
    f = rng.normal(size=(6, 2, 4))
    f /= np.linalg.norm(f, axis=2, keepdims=True)
    labels = np.array([0, 0, 1, 1, 2, 2])
    assert preprocess.supcon_loss(f, labels) > 0 and preprocess.supcon_loss(f, mode="one") > 0
    assert preprocess.csi_loss(f, np.zeros((4, 2)), np.zeros(4, int)) == pytest.approx(preprocess.supcon_loss(f) + math.log(2))
    with pytest.raises(ValueError):
        preprocess.supcon_loss(f[:, 0])
    with pytest.raises(ValueError):
        preprocess.supcon_loss(f, labels[:2])


# ---------------------------------------------------------------- drift


@pytest.mark.parametrize("block", [7, 64, 65536])
def test_moving_and_ema_across_blocks(spark, block):
    rng = np.random.default_rng(10)
    s = rng.normal(size=300)
    df = frame(spark, [(i, float(v)) for i, v in enumerate(s)], "seq long, score double")
    got = np.array([r.ma for r in drift.moving(df, 25, warm=0.3, block=block).orderBy("seq").collect()])
    padded = np.concatenate([np.full(24, 0.3), s])
    assert np.allclose(got, [padded[i : i + 25].mean() for i in range(300)])
    e = [0.3]
    for v in s[1:]:
        e.append(0.9 * e[-1] + 0.1 * v)
    assert np.allclose([r.ema for r in drift.ema(df, 0.3, 0.9, block=block).orderBy("seq").collect()], e)


def test_window_longer_than_the_series(spark):
    df = frame(spark, [(0, 2.0), (1, 4.0)], "seq long, score double")
    assert [r.ma for r in drift.moving(df, 4, warm=1.0).orderBy("seq").collect()] == [1.25, 2.0]


def test_constant_label_has_auroc_one(spark):
    df = frame(spark, [(i, float(i), 0) for i in range(40)], "seq long, score double, mistake int")
    r = drift.drift_summary(drift.covariate_drift(df, 5, 8, [0, 8, 24, 40])).first()
    assert r.auroc_mistakes == 1.0 and r.auroc_drift == 1.0 and r.first_drift == 0 and r.fpr_drift is None


# ---------------------------------------------------------------- scorers, sources, pipelines


def test_every_detector_scores(spark, data):
    rows = probe_rows(spark, data).where("domain <= 1")
    n = rows.count()
    for name in lifecycle.list_scorers():
        params = {"vim": {"top_k": 16}, "ssd": {"k": 2, "iterations": 3}, "gmm": {"k": 2}}.get(name, {})
        got = lifecycle.create_scorer(name, **params).fit(fit_rows(spark, data)).transform(rows)
        assert got.where(F.col("score").isNotNull()).count() == n, name
    with pytest.raises(ValueError):
        lifecycle.create_scorer("nothing")
    with pytest.raises(ValueError):
        lifecycle.hyperparameters("nothing")
    assert lifecycle.hyperparameters("l1norm") == {} and lifecycle.hyperparameters("odin")["eps"] == {"low": 0.0, "high": 0.005, "step": 0.0001}
    assert all(lifecycle.hyperparameters(n) == {} or lifecycle.grid(n) for n in lifecycle.list_scorers())
    assert [t["k"] for t in lifecycle.grid("knn_cosine") if t["avg_topk"]] == [1, 26, 51, 71, 96] and len(lifecycle.grid("mahalanobis")) == 6


def test_detector_round_trip(spark, data, tmp_path):
    rows = probe_rows(spark, data).where("domain = 0")
    fitted = lifecycle.create_scorer("energy").with_params(temperature=2.0).fit(fit_rows(spark, data))
    fitted.save(str(tmp_path / "d"))
    again = lifecycle.load(spark, str(tmp_path / "d"))
    assert again.detector.params == {"temperature": 2.0}
    assert np.allclose(scores(fitted.transform(rows)), scores(again.transform(rows)))


def test_knn_in_parts(spark, data):
    a = features.knn(probe_rows(spark, data), fit_rows(spark, data), "knn_cosine", 5)
    b = features.knn(probe_rows(spark, data), fit_rows(spark, data), "knn_cosine", 5, reference_rows=40)
    assert np.allclose(scores(a), scores(b))


def test_csi_aligned():
    x, r = np.eye(3), 2 * np.eye(3)
    assert np.allclose(features.csi_aligned(x, r), 1.0)
    with pytest.raises(ValueError):
        features.csi_aligned(x, np.ones((2, 3)))


def test_rankfeat_removes_the_first_component():
    m = np.random.default_rng(0).normal(size=(2, 4, 3))
    assert np.allclose(np.linalg.svd(features.rankfeat(m), compute_uv=False)[:, 0], np.linalg.svd(m, compute_uv=False)[:, 1])


def test_sources(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(name, split, c, i, k, [1.0], 0) for k, (name, split, c, i) in enumerate([("cifar10", "train", None, None), ("cifar10_c", "test", "fog", 1), ("cifar10_c", "test", "snow", 1), ("cifar10_c", "test", "fog", 3)])], "dataset string, split string, corruption string, intensity int, id long, features array<double>, label int")
    tables.write_dataset(df, root, "dataset", "split", "corruption", "intensity")
    assert tables.read_dataset(spark, "cifar10", root).count() == 1
    assert tables.read_dataset(spark, "cifar10_c", root, "test", "fog", 3).count() == 1
    assert tables.read_dataset(spark, "cifar10_c", root, "test", "all").count() == 3
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "nothing", root)
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "cifar10_c", root, "test", "rain")
    assert tables.delete_dataset(spark, root)
    if "own" not in tables.list_datasets():
        tables.register_dataset("own")(lambda spark, root, split, **o: spark.range(3))
    assert tables.read_dataset(spark, "own", "").count() == 3
    with pytest.raises(ValueError):
        tables.register_dataset("own")
    for kind in tables.NOISES:
        f = tables.read_dataset(spark, kind, "", n=20).first()
        assert len(f.features) == 16 and f.label == -1 and all(0 <= v <= 255 for v in f.features)


def test_image_folder_and_logs(spark, tmp_path):
    for c in ("b", "a"):
        (tmp_path / "im" / c).mkdir(parents=True)
        (tmp_path / "im" / c / f"{c}.png").write_bytes(b"x")
    got = {r.class_name: r.label for r in tables.image_folder(spark, str(tmp_path / "im")).collect()}
    assert got == {"a": 0, "b": 1}
    assert {r.label for r in tables.image_folder(spark, str(tmp_path / "im"), single_class=True).collect()} == {0}
    log = spark.createDataFrame([("m", 1.0)], "model string, auroc double")
    for fmt in ("csv", "parquet"):
        tables.append_log(log, str(tmp_path / fmt), fmt)
        tables.append_log(log, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_pipeline_registry(spark, data):
    assert "ood_benchmark_cifar10" in pipelines.list_pipelines() and "osr_imagenet" in pipelines.list_pipelines()
    assert pipelines.create_pipeline("ood_benchmark", "cifar10")(spark, data).count() == 4
    with pytest.raises(ValueError):
        pipelines.create_pipeline("nothing")


def test_ensembles(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in rng.normal(i % 2, 1, 3)], i % 2) for i in range(200)]
    df = frame(spark, rows, "id long, s array<double>, label int")
    got = ensembles.weight_regression(df, 50).toPandas()
    assert len(got) == 100 and got[got.label == 1].score.mean() > got[got.label == 0].score.mean()
    p = np.column_stack([[0.9, 0.8, 0.1], [0.1, 0.2, 0.9]])
    w = ensembles.max_min_weights(p)
    kl = (p[:, None] * np.log(p[:, None] / p[None])).sum(2)
    assert w.sum() == pytest.approx(1) and (w @ kl).max() <= (np.full(3, 1 / 3) @ kl).max() + 1e-9
    mixed = ensembles.mutual_information(frame(spark, [(1, [0.2, 0.4])], "id long, s array<double>")).first().score
    assert 0.2 <= mixed <= 0.4


def test_vector_edge_rows(spark):
    df = frame(spark, [([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vec.lse(F.col("a")), vec.argmax(F.col("a")), features.maxcosine(F.col("a"), F.array(F.col("b")))).first()
    assert r[0] == pytest.approx(math.log(2)) and r[1] == 0 and r[2] == 0.0


def test_model_seam(spark):
    from tidemark.sources import models

    models.register_model("double")(lambda: lambda batch: batch * 2)
    df = frame(spark, [(1, [1.0, 2.0])], "id long, v array<double>")
    assert models.with_outputs(df, "double", "v", 2).first().x == [2.0, 4.0]
    with pytest.raises(ValueError):
        models.with_outputs(df, "nothing", "v", 2)


def test_long_tail_draws_and_hooks(spark, data):
    df = fit_rows(spark, data)
    got = tables.long_tail_draws(df)
    assert 0 < got.count() < df.count() and got.columns == df.columns
    aggregations.register_aggregation("own")(lambda df, fit, s: df.withColumn("score", F.lit(2.0)))
    assert "own" in aggregations.list_aggregations()
    one = stack_frame(spark, [[1.0]])
    assert aggregations.aggregate_stack(one, one, "own").first().score == 2.0
    aggregations.NUMERIC.pop("own")
    preprocess.register_preprocessing("own")(lambda df, fit, s="s": df)
    assert preprocess.PREPROCESSORS.pop("own")(one, one) is one


def test_knn_classify_in_parts(spark, data):
    a, b = (features.knn_classify(probe_rows(spark, data), fit_rows(spark, data), reference_rows=r).orderBy("domain", "id").collect() for r in (1000, 50))
    assert a == b


def test_knn_classify_ties_and_bounds(spark, duck, monkeypatch):
    """Copies of a vector under several labels, beyond k, in whatever part they are: larger labels come first, as in the SQL."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 5))
    refs = [(i, x[i % 30].tolist(), (i // 30) % 7) for i in range(900)]
    probes = [(i, 0, r.tolist()) for i, r in enumerate(np.concatenate([x, rng.normal(size=(40, 5))]))]
    a, b = frame(spark, refs, "id long, x array<double>, label int"), frame(spark, probes, "id long, domain int, x array<double>")
    u = "list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))"
    s = "list_dot_product(p.x, r.u) / sqrt(list_dot_product(p.x, p.x))"
    pdf, rdf = b.toPandas(), a.toPandas()  # noqa: F841
    want = duck.sql(f"""WITH rl AS (SELECT id, label, {u} AS u FROM rdf), s AS (SELECT p.id, r.label, {s} AS s FROM pdf p, rl r),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, label DESC) <= 20), w AS (SELECT id, label, sum(exp(s / 0.07)) AS w FROM k GROUP BY ALL)
SELECT id, label AS pred FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1""").fetchall()
    monkeypatch.setattr(features, "QUERY_ROWS", 16)
    for rows in (1000, 100):
        assert sorted((r.id, r.pred) for r in features.knn_classify(b, a, reference_rows=rows).collect()) == sorted(want)
    # 512 x 40,000 cosines (164 MB) are never held at once
    import tracemalloc

    q, r = rng.normal(size=(512, 4)), rng.normal(size=(40_000, 4))
    tracemalloc.start()
    row, _, _ = features._nearest(q, r / np.linalg.norm(r, axis=1, keepdims=True), np.zeros(len(r), np.int32), 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 512 * 20 and most < 120e6


def test_knn_classify_cells_are_small(spark, data, monkeypatch):
    """Tasks get cells of bounded size, as many as keep the cores busy; rows of zeros and of tiny or huge numbers keep their exact cosines."""
    seen = spark.sparkContext.accumulator(0)
    whole = features._nearest

    def watched(q, refs, label, k, *rest):
        assert len(refs) <= features.CELL_ROWS
        seen.add(1)
        return whole(q, refs, label, k, *rest)

    monkeypatch.setattr(features, "_nearest", watched)
    monkeypatch.setattr(features, "LEAST_ROWS", 20)
    assert features.knn_classify.__defaults__[-1] <= features.CELL_ROWS <= 65_536
    cells = features.knn_classify(probe_rows(spark, data), fit_rows(spark, data))
    assert cells.orderBy("domain", "id").collect() and seen.value >= 12
    rng = np.random.default_rng(2)
    q, r = rng.normal(size=(64, 6)), rng.normal(size=(5000, 6))
    r[::50] = r[7]
    q[0], q[1], q[2], q[3, 1], q[4] = 0, q[1] * 1e-170, q[2] * 1e170, np.nan, r[7] * 3
    with np.errstate(all="ignore"):
        unit, label = r / np.sqrt(features._dots(r, r))[:, None], rng.integers(0, 5, len(r)).astype(np.int32)
        unit[99], unit[100] = np.nan, 0
        row, s, lab = whole(q, unit, label, 20, block=512, pairs=1000)
        for i, v in enumerate(q):
            all_s = features._dots(np.broadcast_to(v, unit.shape), unit) / np.sqrt(features._dots(v[None], v[None]))
            best = np.lexsort((-label.astype(int), -np.where(np.isnan(all_s), np.inf, all_s)))[:20]
            np.testing.assert_array_equal(s[row == i], all_s[best])
            assert lab[row == i].tolist() == label[best].tolist()
