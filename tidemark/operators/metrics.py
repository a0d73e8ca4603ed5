"""Metrics of scores against labels: ROC, precision-recall, risk-coverage, and the plug-in rejector.

Equal scores are merged first, so curves are no longer than the number of distinct scores. Cumulative counts run in
sorted runs: each group's scores are cut at approximate quantiles, counts before a run come from a small table of run
totals, and windows are partitioned by (group, run). No window holds a whole group, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNS = 16


def merged(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, pos, neg): counts of each distinct score; rows with a null score or label take no part."""
    y = F.col(label).cast("int")
    return df.where(F.col(score).isNotNull() & y.isin(0, 1)).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def cumulative(df: DataFrame, keys: list[str], values: list[str], order: str = "score", runs: int = RUNS) -> DataFrame:
    """df (one row for each (keys, order)) with cum_<v>, next_<v> and <v>_total of the values, from the largest order down."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, F.array(*[F.lit(i / runs) for i in range(1, runs)]), 1000).alias("_cuts"), *[F.sum(v).alias(f"{v}_total") for v in values])
    df = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    df = df.withColumn("_run", F.size(F.filter("_cuts", lambda c: c <= F.col(order)))).drop("_cuts")
    totals = df.groupBy(*keys, "_run").agg(*[F.sum(v).alias(f"_s_{v}") for v in values], F.max_by(F.struct(*values), order).alias("_first"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_run"))
    totals = totals.select(*keys, "_run", *[F.coalesce(F.sum(f"_s_{v}").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{v}") for v in values], F.lead("_first").over(above).alias("_next"))
    df = df.join(totals, [*keys, "_run"])
    inside = Window.partitionBy(*keys, "_run").orderBy(F.desc(order))
    up = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for v in values:
        df = df.withColumn(f"cum_{v}", F.sum(v).over(up) + F.col(f"_b_{v}")).withColumn(f"next_{v}", F.coalesce(F.lead(v).over(inside), F.col("_next")[v]))
    return df.drop("_run", "_next", *[f"_b_{v}" for v in values])


def roc_points(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, pos, neg, tps, fps, p_total, n_total, kept): one row for each distinct score, in no order.

    kept: whether the point stays when collinear points are dropped (no change of either count's increment to the next).
    The point (0, 0) above all scores is not listed.
    """
    c = cumulative(merged(df, keys, score, label), keys, ["pos", "neg"])
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return c.select(*keys, "score", "pos", "neg", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"), F.col("pos_total").alias("p_total"), F.col("neg_total").alias("n_total"), (first | last | bend).alias("kept"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ood_results(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", level: float = 0.95) -> DataFrame:
    """(keys, n_in, n_out, fpr_at_tpr, detection_error, auroc, aupr_in, aupr_out, f1, thr), label 1 = in distribution.

    thr: the largest score whose kept ROC point reaches the level; f1 counts scores strictly above it; aupr_out takes
    label 0 as positive with the scores as they are. Without both labels the metrics are null.
    """
    p = roc_points(df, keys, score, label)
    tp, fp, tp0, fp0 = F.col("tps"), F.col("fps"), F.col("tps") - F.col("pos"), F.col("fps") - F.col("neg")
    tpr, fpr = _ratio(tp, F.col("p_total")), _ratio(fp, F.col("n_total"))
    precision = _ratio(tp, tp + fp)
    before = F.when(tp0 + fp0 > 0, _ratio(tp0, tp0 + fp0)).otherwise(1.0)
    out_precision = _ratio(fp, tp + fp)
    out_before = F.when(tp0 + fp0 > 0, _ratio(fp0, tp0 + fp0)).otherwise(1.0)
    ratio = _ratio(F.col("p_total"), F.col("p_total") + F.col("n_total"))
    reached = F.col("kept") & (tpr >= level)
    g = p.groupBy(*keys).agg(
        F.max("p_total").alias("n_in"),
        F.max("n_total").alias("n_out"),
        F.max_by(F.when(reached, F.struct("tps", "fps", "pos", "neg")), F.when(reached, F.col("score"))).alias("at"),
        F.max(F.when(reached, F.col("score"))).alias("thr"),
        F.min(ratio * (1 - tpr) + (1 - ratio) * fpr).alias("error"),
        F.max(ratio).alias("ratio"),
        F.sum((fp - fp0) * (tp + tp0) / 2.0).alias("area"),
        F.sum((tp - tp0) * (precision + before) / 2.0).alias("pr_in"),
        F.sum((fp - fp0) * (out_precision + out_before) / 2.0).alias("pr_out"),
    )
    both = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    hit, miss = F.col("at.tps") - F.col("at.pos"), F.col("at.fps") - F.col("at.neg")
    return g.select(
        *keys,
        "n_in",
        "n_out",
        F.when(both, _ratio(F.col("at.fps"), F.col("n_out"))).alias("fpr_at_tpr"),
        F.when(both, F.least("error", "ratio")).alias("detection_error"),
        F.when(both, _ratio(F.col("area"), F.col("n_in") * F.col("n_out"))).alias("auroc"),
        F.when(both, _ratio(F.col("pr_in"), F.col("n_in"))).alias("aupr_in"),
        F.when(both, _ratio(F.col("pr_out"), F.col("n_out"))).alias("aupr_out"),
        F.when(both, F.coalesce(_ratio(2 * hit, hit + F.col("n_in") + miss), F.lit(0.0))).alias("f1"),
        F.when(both, F.col("thr")).alias("thr"),
    )


_SQL_METRICS = {
    "fpr_at_tpr": "afp / n_out",
    "detection_error": "least(error, ratio)",
    "auroc": "area / (CAST(n_in AS DOUBLE) * n_out)",
    "aupr_in": "pr_in / n_in",
    "aupr_out": "pr_out / n_out",
    "f1": "coalesce(2 * hit / (hit + n_in + miss), 0)",
    "thr": "thr",
}


def ood_results_sql(source: str, keys: str, level: float = 0.95) -> str:
    """The same as CTEs over `source` (keys, score, label); the last one is `res`."""
    return f"""mg AS (SELECT {keys}, CAST(score AS DOUBLE) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} WHERE score IS NOT NULL AND label IN (0, 1) GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, lead(pos) OVER w2 AS np, lead(neg) OVER w2 AS nn, sum(pos) OVER (PARTITION BY {keys}) AS pt, sum(neg) OVER (PARTITION BY {keys}) AS nt FROM mg
 WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY {keys} ORDER BY score DESC)),
pts_ AS (SELECT *, (tps = pos AND fps = neg) OR np IS NULL OR np <> pos OR nn <> neg AS kept, tps / pt AS tpr, fps / nt AS fpr, tps - pos AS tp0, fps - neg AS fp0, pt / (pt + nt) AS ratio FROM cu),
ag AS (SELECT {keys}, CAST(max(pt) AS BIGINT) AS n_in, CAST(max(nt) AS BIGINT) AS n_out, arg_max(fps, score) FILTER (kept AND tpr >= {level}) AS afp, arg_max(tp0, score) FILTER (kept AND tpr >= {level}) AS hit, arg_max(fp0, score) FILTER (kept AND tpr >= {level}) AS miss,
 max(score) FILTER (kept AND tpr >= {level}) AS thr, min(ratio * (1 - tpr) + (1 - ratio) * fpr) AS error, max(ratio) AS ratio, sum(neg * (tps + tp0) / 2.0) AS area,
 sum(pos * (tps / (tps + fps) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2.0) AS pr_in, sum(neg * (fps / (tps + fps) + CASE WHEN tp0 + fp0 > 0 THEN fp0 / (tp0 + fp0) ELSE 1 END) / 2.0) AS pr_out FROM pts_ GROUP BY {keys}),
res AS (SELECT {keys}, n_in, n_out, {", ".join(f"CASE WHEN n_in > 0 AND n_out > 0 THEN {e} END AS {n}" for n, e in _SQL_METRICS.items())} FROM ag)"""


METRICS = ("fpr_at_tpr", "detection_error", "auroc", "aupr_in", "aupr_out", "f1", "thr")
#: Names for reports.
PRETTY = {"fpr_at_tpr": "FPR at 95% TPR", "detection_error": "Detection error", "auroc": "AUROC", "aupr_in": "AUPR in", "aupr_out": "AUPR out", "f1": "F1", "thr": "Threshold", "aurc": "AURC", "accuracy": "Accuracy", "aufnr": "AUFNR", "aufpr": "AUFPR", "autc": "AUTC", "time": "Time (s)"}


def fnr_at_fixed_tnr(df: DataFrame, keys: list[str], level: float = 0.95, semantics: str = "reference") -> DataFrame:
    """(keys, fnr, tnr): at the first curve point that reaches the level; by `reference` that is always the start, FNR 1; by `paper` the last such point."""
    p = roc_points(df, keys)
    if semantics == "reference":
        return p.groupBy(*keys).agg(F.lit(1.0).alias("fnr"), F.lit(1.0).alias("tnr"))
    fnr, tnr = 1 - _ratio(F.col("tps"), F.col("p_total")), 1 - _ratio(F.col("fps"), F.col("n_total"))
    ok = F.col("kept") & (tnr >= level)
    g = p.groupBy(*keys).agg(F.min_by(F.when(ok, F.struct(fnr.alias("fnr"), tnr.alias("tnr"))), F.when(ok, F.col("score"))).alias("at"))
    return g.select(*keys, F.coalesce("at.fnr", F.lit(1.0)).alias("fnr"), F.coalesce("at.tnr", F.lit(1.0)).alias("tnr"))


def autc(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, aufnr, aufpr, autc): areas of FNR and FPR over the finite thresholds of the kept points."""
    p = roc_points(df, keys).where("kept").select(*keys, "score", _ratio(F.col("tps"), F.col("p_total")).alias("tpr"), _ratio(F.col("fps"), F.col("n_total")).alias("fpr"))
    w = Window.partitionBy(*keys).orderBy("score")
    step = F.col("score") - F.lag("score").over(w)
    p = p.withColumn("fnr", 1 - F.col("tpr")).withColumn("a", step * (F.col("fnr") + F.lag("fnr").over(w)) / 2).withColumn("b", step * (F.col("fpr") + F.lag("fpr").over(w)) / 2)
    return p.groupBy(*keys).agg(F.sum("a").alias("aufnr"), F.sum("b").alias("aufpr")).withColumn("autc", (F.col("aufnr") + F.col("aufpr")) / 2)


def risk_coverage(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", n: int | None = 1001, seed: str = "rc", leq: bool = False) -> DataFrame:
    """(keys, thr, coverage, risk): thresholds are the scores of the n rows (of id) with the least md5, or all scores.

    Covered are scores above the threshold (at most it, with leq); thresholds that cover nothing are left out.
    """
    c = cumulative(merged(df, keys, score, label), keys, ["pos", "neg"])
    below = leq
    covered = (F.col("pos_total") + F.col("neg_total") - F.col("cum_pos") - F.col("cum_neg") + F.col("pos") + F.col("neg")) if below else F.col("cum_pos") + F.col("cum_neg") - F.col("pos") - F.col("neg")
    wrong = (F.col("pos_total") - F.col("cum_pos") + F.col("pos")) if below else F.col("cum_pos") - F.col("pos")
    curve = c.select(*keys, F.col("score").alias("thr"), _ratio(covered, F.col("pos_total") + F.col("neg_total")).alias("coverage"), _ratio(wrong, covered).alias("risk")).where("risk is not null")
    if n is None:
        return curve
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), "id")
    picked = df.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(*keys, F.col(score).cast("double").alias("thr"))
    return picked.join(curve, [*keys, "thr"])


def aurc(curve: DataFrame, keys: list[str], swapped: bool = False) -> DataFrame:
    """(keys, aurc): trapezoids of risk over coverage; swapped: of coverage over risk along the same order, as some pipelines call it."""
    w = Window.partitionBy(*keys).orderBy("coverage", "thr")
    y, x = ("coverage", "risk") if swapped else ("risk", "coverage")
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(*keys, area.alias("a")).groupBy(*keys).agg(F.sum("a").alias("aurc"))


def plugin_bb(df: DataFrame, c_fn: float = 0.75, n: int = 101, grid: int = 1000, pi: float | None = None, backend: str = "brute") -> DataFrame:
    """(brej, lbd, thr, coverage, risk) for each rejection budget: the plug-in rule with the nearest rejection rate.

    df: id, sc, ood, label (1: misclassified or out of distribution). A row is rejected by lambda if
    (1 - c_in - c_out) sc + c_out inv(ood) < 1 - 2 c_in - c_out. Equal (sc, ood) pairs are merged; the lambda grid is
    bounded and meets the rows once, not once for each budget; ties of the objective go to the first lambda.
    brute: inv keeps the sign of the first row's score (by id); parallel: plain 1/x.
    """
    stats = df.agg(F.avg(1 - F.col("label")).alias("pi"), F.count("*").alias("n"), F.min_by("ood", "id").alias("o")).first()
    pi = float(stats.pi) if pi is None else pi
    if not 0 < pi < 1:
        raise ValueError("both labels are needed")
    low = min(0.0, c_fn / (1 - pi), (c_fn - 1) / (1 - pi), 1 / pi) - 1
    high = max((c_fn - 1) / (1 - pi), 1 / pi, low, c_fn / (1 - pi)) + 1
    sign = (stats.o > 0) - (stats.o < 0)
    inv = F.try_divide(F.lit(1.0), F.col("ood")) if backend == "parallel" else F.lit(float(sign)) / (F.col("ood") + 1e-7)
    rows = df.groupBy("sc", "ood").agg(F.count("*").alias("c"), F.sum("label").alias("bad")).withColumn("inv", inv)
    spark = df.sparkSession
    lam = spark.range(grid).select(F.col("id").alias("i"), (F.lit(low) + F.col("id") * F.lit((high - low) / (grid - 1))).alias("lbd"))
    c_in, c_out = F.col("lbd") * pi, F.lit(c_fn) - F.col("lbd") * (1 - pi)
    rule = rows.crossJoin(F.broadcast(lam)).withColumn("reject", ((1 - c_in - c_out) * F.col("sc") + c_out * F.col("inv") < 1 - 2 * c_in - c_out).cast("int"))
    rates = rule.groupBy("i", "lbd").agg((F.sum(F.col("reject") * F.col("c")) / float(stats.n)).alias("rate"), F.sum((1 - F.col("reject")) * F.col("c")).alias("covered"), F.sum((1 - F.col("reject")) * F.col("bad")).alias("bad"))
    budgets = spark.range(n).select((F.col("id") / float(n - 1)).alias("brej"))
    best = F.broadcast(budgets).crossJoin(rates).groupBy("brej").agg(F.min_by(F.struct("lbd", "covered", "bad"), F.struct(F.pow(F.col("rate") - F.col("brej"), 2).alias("d"), F.col("i"))).alias("b"))
    lbd = F.col("b.lbd")
    return best.select("brej", lbd.alias("lbd"), (1 - 2 * lbd * pi - (F.lit(c_fn) - lbd * (1 - pi))).alias("thr"), (F.col("b.covered") / float(stats.n)).alias("coverage"), (F.col("b.bad") / (F.col("b.covered") + 1e-7)).alias("risk"))
