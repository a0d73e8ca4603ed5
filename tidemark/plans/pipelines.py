"""Evaluation pipelines: score, union by domain, metrics for each domain, and their averages.

A pipeline is a function (spark, sf_dir, ...) -> DataFrame under a name; everything is one lazy plan but for fitted
parameters. The average row is the mean of the per-domain metrics, not the metric of pooled rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregations, drift, features, logits, metrics
from tidemark.plans import queries as q
from tidemark.plans.fixtures import class_means, fit_rows, head_of, probe_rows, with_logits
from tidemark.plans.queries import BASE_SQL, MUS, ORACLES, SC_SQL, SIMPLE, WIN_SQL, X, Z, q6, query, r6

PIPELINES: dict[str, Callable[..., DataFrame]] = {}
#: The names that a family of pipelines answers to; all of a family run the same plan on other tables.
FAMILIES = {
    "ood_benchmark": ("cifar10", "cifar100", "imagenet", "imagenet_reduced", "imagenet_near", "imagenet_far", "mnist"),
    "ood_validation": ("cifar10", "cifar100", "imagenet"),
    "ood_validation_noise": ("cifar10", "cifar100"),
    "sc_benchmark": ("cifar10", "cifar100", "imagenet"),
    "scod_benchmark": ("cifar10", "cifar100", "imagenet"),
    "covariate_drift": ("cifar10", "cifar100", "imagenet"),
    "drift_benchmark": ("imagenet_r", "imagenet_lt", "openimage_o"),
    "osr": ("cifar10", "cifar100", "imagenet"),
}


def register_pipeline(family: str) -> Callable:
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for d in FAMILIES.get(family, ()) or ("",):
            PIPELINES[f"{family}_{d}".rstrip("_")] = fn
        return fn

    return add


def list_pipelines() -> list[str]:
    return sorted(PIPELINES)


def create_pipeline(name: str, dataset: str | None = None) -> Callable[..., DataFrame]:
    key = f"{name}_{dataset}" if dataset else name
    if key not in PIPELINES:
        raise ValueError(f"unknown pipeline {key}; known: {', '.join(list_pipelines())}")
    return PIPELINES[key]


def per_domain(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, domain, score, label) for each out-of-distribution domain, joined by the in-distribution rows (domain 0, label 1)."""
    keys = keys or []
    domains = scored.where("domain > 0").select("domain").distinct()
    inside = scored.where("domain = 0").drop("domain").crossJoin(F.broadcast(domains)).select(*keys, "domain", "score", F.lit(1).alias("label"))
    return inside.unionByName(scored.where("domain > 0").select(*keys, "domain", "score", F.lit(0).alias("label")))


def with_average(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """results and a row with domain -1 for each key: the mean of the domains' metrics."""
    keys = keys or []
    names = [c for c in results.columns if c not in (*keys, "domain", "n_in", "n_out")]
    mean = results.groupBy(*keys).agg(F.lit(-1).alias("domain"), F.max("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), *[F.avg(c).alias(c) for c in names])
    return results.unionByName(mean)


def _report(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.select(*keys, "n_in", "n_out", *[r6(F.col(m), m) for m in metrics.METRICS])


def _domain_sql(scored: str, keys: str = "") -> str:
    """CTEs from (keys, domain, score) to the averaged result `allr`."""
    k = f"{keys}, " if keys else ""
    res = metrics.ood_results_sql("pd", f"{k}domain")
    names = ", ".join(f"avg({m}) AS {m}" for m in metrics.METRICS)
    return f"""dm AS (SELECT DISTINCT domain FROM {scored} WHERE domain > 0), pd AS (SELECT {k}dm.domain, score, 1 AS label FROM {scored} s, dm WHERE s.domain = 0 UNION ALL SELECT {k}domain, score, 0 FROM {scored} WHERE domain > 0), {res},
allr AS (SELECT {k}domain, n_in, n_out, {", ".join(metrics.METRICS)} FROM res UNION ALL SELECT {k}-1 AS domain, max(n_in), CAST(sum(n_out) AS BIGINT), {names} FROM res{f" GROUP BY {keys}" if keys else ""})"""  # fmt: skip


_SHOW = "n_in, n_out, " + ", ".join(q6(m, m) for m in metrics.METRICS)


@register_pipeline("ood_benchmark")
def ood_benchmark(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fit on in-distribution rows, score test rows and out-of-distribution sets, metrics for each set and their average."""
    fit = fit_rows(spark, sf_dir)
    rows = with_logits(probe_rows(spark, sf_dir), head_of(class_means(fit)))
    scored = score(rows) if score else rows.select("domain", F.round(features.maxcosine(X, MUS), 9).alias("score"))
    return with_average(metrics.ood_results(per_domain(scored), ["domain"]))


_MAXCOS = f"sc AS (SELECT domain, round({SIMPLE['maxcosine'][1]}, 9) AS score FROM lg)"


@query("pipe_ood_benchmark", f"WITH {BASE_SQL}, {_MAXCOS}, {_domain_sql('sc')} SELECT CAST(domain AS INTEGER) AS domain, {_SHOW} FROM allr")
def _pipe_ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(ood_benchmark(spark, sf_dir), ["domain"])


@register_pipeline("osr")
def osr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-set recognition: held-out classes are the only out-of-distribution set."""
    return ood_benchmark(spark, sf_dir, lambda rows: rows.where("domain <= 1").select("domain", F.round(logits.max_logits(Z), 9).alias("score")))


@query("pipe_osr", f"WITH {BASE_SQL}, sc AS (SELECT domain, round({SIMPLE['max_logits'][1]}, 9) AS score FROM lg WHERE domain <= 1), {_domain_sql('sc')} SELECT CAST(domain AS INTEGER) AS domain, {_SHOW} FROM allr")
def _pipe_osr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(osr(spark, sf_dir), ["domain"])


TEMPERATURES = (0.5, 1.0, 2.0, 5.0, 10.0)


@register_pipeline("ood_validation")
def ood_validation(spark: SparkSession, sf_dir: str, grid: tuple[float, ...] = TEMPERATURES, objective: str = "auroc") -> DataFrame:
    """Every trial of a parameter grid in one plan: (temperature, averaged metrics, best); largest auroc, least of the others."""
    rows = with_logits(probe_rows(spark, sf_dir), head_of(class_means(fit_rows(spark, sf_dir))))
    trials = rows.select("domain", "z", F.explode(F.array(*[F.lit(t) for t in grid])).alias("temperature"))
    z = F.transform("z", lambda v: v / F.col("temperature"))
    scored = trials.select("temperature", "domain", F.round(logits.msp(z), 9).alias("score"))
    average = with_average(metrics.ood_results(per_domain(scored, ["temperature"]), ["temperature", "domain"]), ["temperature"]).where("domain = -1")
    order = F.desc(objective) if objective == "auroc" else F.asc(objective)
    best = average.orderBy(order, "temperature").limit(1).select(F.col("temperature").alias("best_temperature"))
    return average.crossJoin(F.broadcast(best)).withColumn("best", (F.col("temperature") == F.col("best_temperature")).cast("int")).drop("best_temperature", "domain")


@register_pipeline("ood_validation_noise")
def ood_validation_noise(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return ood_validation(spark, sf_dir, **options)


@query("pipe_ood_validation", f"WITH {BASE_SQL}, sc AS (SELECT temperature, domain, round(1.0 / list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / temperature))), 9) AS score FROM lg, (SELECT unnest([0.5, 1.0, 2.0, 5.0, 10.0]::DOUBLE[]) AS temperature)), {_domain_sql('sc', 'temperature')}, av AS (SELECT * FROM allr WHERE domain = -1) SELECT temperature, {_SHOW}, CAST(temperature = (SELECT temperature FROM av ORDER BY auroc DESC, temperature LIMIT 1) AS INTEGER) AS best FROM av")
def _pipe_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(ood_validation(spark, sf_dir), ["temperature", "best"])


@register_pipeline("sc_benchmark")
def sc_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selective classification: misclassified rows are the negatives; ROC metrics, accuracy and both forms of AURC."""
    rows = q.sc_rows(spark, sf_dir).where("domain = 0").select(F.lit("msp").alias("method"), "id", F.col("sc").alias("score"), "label")
    ood = metrics.ood_results(rows.withColumn("label", 1 - F.col("label")), ["method"])
    curve = metrics.risk_coverage(rows, ["method"])
    both = metrics.aurc(curve, ["method"]).join(metrics.aurc(curve, ["method"], swapped=True).withColumnRenamed("aurc", "aurc_swapped"), "method")
    accuracy = rows.groupBy("method").agg(F.avg(1 - F.col("label")).alias("accuracy"))
    return ood.join(both, "method").join(accuracy, "method")


_RC_OF = "cv AS (SELECT {k}score AS thr, tp0f AS coverage, rk AS risk FROM (SELECT {k}score, (tp0 + fp0) / (pt + nt) AS tp0f, fp0 / nullif(tp0 + fp0, 0) AS rk FROM pts_) WHERE rk IS NOT NULL), pk AS (SELECT {k}score AS thr, id FROM {src} QUALIFY row_number() OVER (PARTITION BY {p} ORDER BY md5('rc:' || id), id) <= 1001), rc AS (SELECT cv.* FROM pk JOIN cv USING ({k}thr)), ar AS (SELECT {p}, sum((coverage - c0) * (risk + r0) / 2) AS aurc, sum((risk - r0) * (coverage + c0) / 2) AS aurc_swapped FROM (SELECT *, lag(coverage) OVER w AS c0, lag(risk) OVER w AS r0 FROM rc WINDOW w AS (PARTITION BY {p} ORDER BY coverage, thr)) GROUP BY {p})"


@query("pipe_sc_benchmark", f"WITH {SC_SQL}, src AS (SELECT 'msp' AS method, id, sc AS score, 1 - label AS label FROM scr WHERE domain = 0), {metrics.ood_results_sql('src', 'method')}, {_RC_OF.format(k='method, ', p='method', src='src')} SELECT method, {_SHOW}, {q6('aurc', 'aurc')}, {q6('aurc_swapped', 'aurc_swapped')}, {q6('(SELECT avg(label) FROM src)', 'accuracy')} FROM res JOIN ar USING (method)")
def _pipe_sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sc_benchmark(spark, sf_dir)
    return r.select("method", "n_in", "n_out", *[r6(F.col(m), m) for m in (*metrics.METRICS, "aurc", "aurc_swapped", "accuracy")])


@register_pipeline("scod_benchmark")
def scod_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selective classification with out-of-distribution rows: AURC of the softmax score and of the plug-in rule."""
    rows = q.sc_rows(spark, sf_dir)
    plain = metrics.aurc(metrics.risk_coverage(rows.select(F.lit("msp").alias("method"), "id", F.col("sc").alias("score"), "label"), ["method"]), ["method"])
    pi = rows.agg(F.avg((F.col("domain") == 0).cast("double"))).first()[0]
    plugin = metrics.plugin_bb(rows, pi=pi).withColumn("method", F.lit("plugin_bb"))
    return plain.unionByName(metrics.aurc(plugin, ["method"]))


_SCOD_SQL = f"""WITH {q.PLUGIN_SQL.replace("SELECT avg(1 - label) AS pi,", "SELECT avg(CAST(domain = 0 AS INTEGER)) AS pi,")}, src AS (SELECT 'msp' AS method, id, sc AS score, label FROM scr), {metrics.ood_results_sql("src", "method")},
cv AS (SELECT score AS thr, (tp0 + fp0) / (pt + nt) AS coverage, tp0 / nullif(tp0 + fp0, 0) AS risk FROM pts_ WHERE tp0 + fp0 > 0), pk AS (SELECT score AS thr, id FROM src QUALIFY row_number() OVER (ORDER BY md5('rc:' || id), id) <= 1001),
both_ AS (SELECT 'msp' AS method, cv.coverage, cv.risk, cv.thr FROM pk JOIN cv USING (thr) UNION ALL SELECT 'plugin_bb', cov / be.n, bad / (cov + 1e-7), 1 - 2 * lbd * pi - (0.75 - lbd * (1 - pi)) FROM be, pa),
ar AS (SELECT method, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS a FROM both_ WINDOW w AS (PARTITION BY method ORDER BY coverage, thr)) SELECT method, {q6("sum(a)", "aurc")} FROM ar GROUP BY method"""


@query("pipe_scod_benchmark", _SCOD_SQL)
def _pipe_scod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scod_benchmark(spark, sf_dir).select("method", r6(F.col("aurc"), "aurc"))


@register_pipeline("covariate_drift")
def covariate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_summary(q.drift_rows(spark, sf_dir))


query("pipe_covariate_drift", ORACLES["drift_summary"])(q.QUERIES["drift_summary"])


@register_pipeline("drift_benchmark")
def drift_benchmark(spark: SparkSession, sf_dir: str, criterion: str = "ks_2samp") -> DataFrame:
    """Window statistics of in-distribution and mixed windows against the reference; metrics for each window size, sign -1."""
    inside, mixed, ref = q.drift_windows(spark, sf_dir)
    stat, column = (drift.ks_2samp, "ks") if criterion == "ks_2samp" else (drift.mmd_rbf, "mmd")
    rows = [stat(w, ref).select("ws", (-F.round(column, 9)).alias("score"), F.lit(label).alias("label")) for w, label in ((inside, 1), (mixed, 0))]
    return metrics.ood_results(rows[0].unionByName(rows[1]), ["ws"])


@query("pipe_drift_benchmark", f"WITH {WIN_SQL}, {q._MIX}, src AS (SELECT ws, -round(ks, 9) AS score, 1 AS label FROM {q._ks_sql('wv')} UNION ALL SELECT ws, -round(ks, 9), 0 FROM {q._ks_sql('mx')}), {metrics.ood_results_sql('src', 'ws')} SELECT ws, {_SHOW} FROM res")
def _pipe_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(drift_benchmark(spark, sf_dir), ["ws"])


def _mmd_sql(source: str) -> str:
    return f"(SELECT yy.ws, yy.w, xx.v + yy.v - 2 * xy.v AS mmd FROM (SELECT a.ws, a.w, avg(exp(-pow(a.score - b.score, 2))) AS v FROM {source} a JOIN {source} b ON a.ws = b.ws AND a.w = b.w GROUP BY ALL) yy JOIN (SELECT ws, w, avg(exp(-pow(m.score - rf.score, 2))) AS v FROM {source} m, rf GROUP BY ws, w) xy USING (ws, w), (SELECT avg(exp(-pow(a.score - b.score, 2))) AS v FROM rf a, rf b) xx)"


@query("pipe_drift_benchmark_mmd", f"WITH {WIN_SQL}, {q._MIX}, src AS (SELECT CAST(ws AS INTEGER) AS ws, -round(mmd, 9) AS score, 1 AS label FROM {_mmd_sql('wv')} UNION ALL SELECT CAST(ws AS INTEGER), -round(mmd, 9), 0 FROM {_mmd_sql('mx')}), {metrics.ood_results_sql('src', 'ws')} SELECT ws, {_SHOW} FROM res")
def _pipe_drift_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(drift_benchmark(spark, sf_dir, "mmd_rbf"), ["ws"])


def ensemble_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three methods on one set, as p-values against the fit rows, combined: (id, domain, score)."""
    fit = fit_rows(spark, sf_dir)
    head = head_of(class_means(fit))
    stack = lambda rows: rows.withColumn("s", F.array(logits.msp(Z), logits.energy(Z), features.maxcosine(X, MUS)))
    test = stack(with_logits(probe_rows(spark, sf_dir), head)).select("id", "domain", "s")
    p = aggregations.p_values(test, stack(with_logits(fit, head)).select("id", "s"))
    return p.select("id", "domain", aggregations.fisher(F.col("p")).alias("score"))


_ENS_STACK = f"[{SIMPLE['msp'][1]}, {SIMPLE['energy'][1]}, {SIMPLE['maxcosine'][1]}]"
_ENS_SQL = q.P_SQL[q.P_SQL.index("rf AS (SELECT unnest(s)") :]


@query("pipe_ensemble_drift", f"WITH {BASE_SQL}, ts AS MATERIALIZED (SELECT id, domain, {_ENS_STACK} AS s FROM lg), fs AS MATERIALIZED (SELECT id, {_ENS_STACK} AS s FROM fitlg), {_ENS_SQL} SELECT id, domain, {q6(q.COMBINE_SQL['fisher'])} FROM ps")
def _pipe_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble_drift(spark, sf_dir).select("id", "domain", r6(F.col("score")))


def report(results: DataFrame, method: str = "method", domain: str = "domain", metric: str = "auroc") -> DataFrame:
    """A table of one metric: a row for each method, a column for each domain, in per cent with one decimal."""
    return results.groupBy(method).pivot(domain).agg(F.format_string("%.1f", F.first(F.col(metric)) * 100))

