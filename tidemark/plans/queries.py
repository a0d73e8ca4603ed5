"""One query for each operator over the canonical inputs, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import special, vec
from tidemark.operators import aggregations as agg
from tidemark.operators import drift, features, gmm, gram, logits, metrics, preprocess
from tidemark.plans.fixtures import BASE_SQL, LAYERS, WIDTH, class_means, fit_rows, head_of, layer_rows, table, probe_rows, vectors, with_logits, with_params
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column, name: str = "score") -> Column:
    """Rounded to 6 decimals; a negative zero becomes zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def q6(e: str, name: str = "score") -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


# ---------------------------------------------------------------- scores from logits


def _logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_logits(probe_rows(spark, sf_dir), head_of(class_means(fit_rows(spark, sf_dir))))


def _fit_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_rows(spark, sf_dir)
    return with_logits(fit, head_of(class_means(fit)))


#: Column names; no session is needed to import this module.
Z, X, W, B, MUS = "z", "x", "w", "b", "mus"


def s_sum(z: str, f: str) -> str:
    return f"list_sum(list_transform({z}, lambda v: {f}))"


def s_lse(z: str) -> str:
    return f"(list_max({z}) + ln({s_sum(z, f'exp(v - list_max({z}))')}))"


def s_soft(z: str) -> str:
    return f"list_transform({z}, lambda v: exp(v - {s_lse(z)}))"


def s_scaled(z: str, k: float) -> str:
    return f"list_transform({z}, lambda v: v * {k!r})"


def s_logits(x: str) -> str:
    return f"list_transform(w, lambda c, i: list_dot_product(c, {x}) + b[i])"


SIMPLE: dict[str, tuple[Callable[[], Column], str]] = {
    "always_one": (lambda: logits.always(1), "1.0::DOUBLE"),
    "always_zero": (lambda: logits.always(0), "0.0::DOUBLE"),
    "msp": (lambda: logits.msp(Z), f"1.0 / {s_sum('z', 'exp(v - list_max(z))')}"),
    "max_logits": (lambda: logits.max_logits(Z), "list_max(z)"),
    "argm": (lambda: logits.argm(Z), "CAST(list_position(z, list_max(z)) - 1 AS DOUBLE)"),
    "entropy": (lambda: logits.entropy(Z), f"{s_lse('z')} - list_dot_product({s_soft('z')}, z)"),
    "energy": (lambda: logits.energy(Z), s_lse("z")),
    "energy_t2": (lambda: logits.energy(Z, 2.0), f"2.0 * {s_lse(s_scaled('z', 0.5))}"),
    "odin": (lambda: logits.odin(Z), f"1.0 / list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / 1000.0)))"),
    "doctor": (lambda: logits.doctor(Z), f"list_dot_product({s_soft('z')}, {s_soft('z')}) - 1.0"),
    "gradnorm": (lambda: logits.gradnorm(Z, X), f"{s_sum('x', 'abs(v)')} * list_sum(list_transform({s_soft('z')}, lambda p: abs(p * len(z) - 1.0)))"),
    "l1norm": (lambda: features.l1norm(X), f"-{s_sum('x', 'abs(v)')}"),
    "maxcosine": (lambda: features.maxcosine(X, MUS), "list_max(list_transform(mus, lambda m: list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m)) + 1e-7)))"),
    "projection_single": (lambda: features.projection(X, MUS, vec.softmax(Z)), f"list_sum(list_transform(list_zip(mus, {s_soft('z')}), lambda q: q[2] * list_dot_product(x, q[1]) / sqrt(list_dot_product(q[1], q[1]))))"),
    "dice": (lambda: vec.lse(vec.matvec(features.dice_weights(W), X, B)), s_lse("list_transform(w, lambda c, i: list_dot_product(list_transform(c, lambda v: CASE WHEN v > list_reverse_sort(c)[CAST(floor(len(c) * 0.3 + 1e-9) AS BIGINT)] THEN v ELSE 0.0 END), x) + b[i])")),
}
for _name, (_column, _sql) in SIMPLE.items():
    query(f"score_{_name}", f"WITH {BASE_SQL} SELECT id, domain, {q6(_sql)} FROM lg")(lambda spark, sf_dir, c=_column: _logit_rows(spark, sf_dir).select("id", "domain", r6(c())))


@query("score_random")
def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_rows(spark, sf_dir).select("id", "domain", logits.random_score(0).alias("score"))


def _perturbed(method: str, eps: float, temperature: float, score: Callable[[Column], Column]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _logit_rows(spark, sf_dir).withColumn("x2", logits.perturbed(X, Z, W, method, eps, temperature))
        return rows.withColumn("z2", vec.matvec(W, F.col("x2"), B)).select("id", "domain", r6(score(F.col("z2"))))

    return run


def _perturbed_sql(dz: str, eps: float, score: str) -> str:
    sign = "CASE WHEN g > 0 THEN 1.0 WHEN g < 0 THEN -1.0 ELSE 0.0 END"
    return f"""WITH {BASE_SQL}, g AS (SELECT *, {dz} AS gr FROM lg),
pz AS (SELECT id, domain, w, b, list_transform(list_zip(x, list_transform(gr, lambda g: {sign})), lambda q: q[1] + {eps!r} * q[2]) AS x2 FROM g),
zz AS (SELECT id, domain, {s_logits('x2')} AS z FROM pz) SELECT id, domain, {q6(score)} FROM zz"""


_DIRECTION = "list_transform(range(1, len(x) + 1), lambda j: list_sum(list_transform(w, lambda c, i: c[j] * ({})[i])))"
query("score_odin_eps", _perturbed_sql("w[list_position(z, list_max(z))]", 0.01, "1.0 / list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / 1000.0)))"))(_perturbed("odin", 0.01, 1000.0, logits.odin))
query("score_energy_eps", _perturbed_sql(_DIRECTION.format(s_soft("z")), 0.01, s_lse("z")))(_perturbed("energy", 0.01, 1.0, logits.energy))
_P = s_soft("z")
query("score_doctor_eps", _perturbed_sql(_DIRECTION.format(f"list_transform({_P}, lambda q: 2.0 * (q * q - q * list_dot_product({_P}, {_P})))"), 0.01, f"list_dot_product({_P}, {_P}) - 1.0"))(_perturbed("doctor", 0.01, 1.0, logits.doctor))


@query("score_mcdropout")
def _mcdropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = head_of(class_means(fit_rows(spark, sf_dir)))
    return logits.mcdropout(probe_rows(spark, sf_dir), head=head).select("id", "domain", r6(F.col("score")))


@query(
    "score_igeood_logits",
    f"""WITH {BASE_SQL}, cl AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(z) AS v, generate_subscripts(z, 1) AS pos FROM fitlg) GROUP BY ALL) GROUP BY label),
cs AS (SELECT list({s_soft('c')} ORDER BY label) AS qs FROM cl)
SELECT id, domain, {q6("list_sum(list_transform(qs, lambda q: 2.0 * acos(greatest(-1 + 1e-12, least(1 - 1e-12, list_sum(list_transform(list_zip(p, q), lambda t: sqrt(t[1]) * sqrt(t[2])))))))) / len(qs)")}
FROM (SELECT id, domain, {s_soft('z')} AS p, qs FROM lg, cs)""",
)
def _igeood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_params(_logit_rows(spark, sf_dir), logits.class_logit_means(_fit_logits(spark, sf_dir)))
    return rows.select("id", "domain", r6(logits.igeood_logits(Z, F.col("centroids"))))


@query(
    "score_kl_matching",
    f"""WITH {BASE_SQL}, fp AS (SELECT list_position(z, list_max(z)) - 1 AS pred, {s_soft('z')} AS p FROM fitlg),
ce AS (SELECT pred, list(m ORDER BY pos) AS q FROM (SELECT pred, pos, avg(v) AS m FROM (SELECT pred, unnest(p) AS v, generate_subscripts(p, 1) AS pos FROM fp) GROUP BY ALL) GROUP BY pred),
t AS (SELECT id, domain, list_position(z, list_max(z)) - 1 AS pred, {s_soft('z')} AS p FROM lg)
SELECT id, domain, {q6("-list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[1] / (t[2] + 1e-6))))")} FROM t JOIN ce USING (pred)""",
)
def _kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits.kl_matching(_logit_rows(spark, sf_dir), logits.kl_matching_fit(_fit_logits(spark, sf_dir))).select("id", "domain", r6(F.col("score")))


@query(
    "score_js_divergence",
    f"""WITH {BASE_SQL}, t AS (SELECT id, domain, {s_soft('z')} AS p, list_transform(z, lambda v: 1.0 / len(z)) AS q FROM lg)
SELECT id, domain, {q6("(list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[1] / ((t[1] + t[2]) / 2)))) + list_sum(list_transform(list_zip(p, q), lambda t: t[2] * ln(t[2] / ((t[1] + t[2]) / 2))))) / 2")} FROM t""",
)
def _js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logit_rows(spark, sf_dir).select("id", "domain", r6(logits.js_divergence(vec.softmax(Z), F.transform(Z, lambda v: 1.0 / F.size(Z)))))


@query(
    "metric_topk_accuracy",
    f"""WITH {BASE_SQL}, t AS (SELECT domain, z[list_position(labels, label)] AS own, list_reverse_sort(z) AS s FROM lg WHERE domain <> 1)
SELECT domain, count(*) AS n, {q6("avg(CAST(own >= s[1] AS INTEGER))", "top1")}, {q6("avg(CAST(own >= s[3] AS INTEGER))", "top3")} FROM t GROUP BY domain""",
)
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logit_rows(spark, sf_dir).where("domain <> 1")
    hit = lambda k: logits.in_top_k(Z, F.col("labels"), F.col("label"), k).cast("int")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), r6(F.avg(hit(1)), "top1"), r6(F.avg(hit(3)), "top3"))


# ---------------------------------------------------------------- scores from features

_REF = "ref AS (SELECT id, x, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM fit)"


def _knn_sql(sim: str, value: str, k: int = 10) -> str:
    return f"""WITH {BASE_SQL}, {_REF}, s AS (SELECT p.id, p.domain, {sim} AS s FROM pts p, ref r),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, id ORDER BY s DESC) AS k FROM s) SELECT id, domain, {q6(value)} FROM r WHERE k <= {k} GROUP BY id, domain"""


_COS = "list_dot_product(p.x, r.u) / sqrt(list_dot_product(p.x, p.x))"
for _name, _sql, _options in (
    ("knn_euclides", _knn_sql(_COS, "-(2.0 - 2.0 * min(s))"), {}),
    ("knn_cosine", _knn_sql(_COS, "min(s)"), {}),
    ("knn_projection", _knn_sql("list_dot_product(p.x, r.u)", "min(s)"), {}),
    ("knn_cosine_avg", _knn_sql(_COS, "avg(s)"), {"avg_topk": True}),
    ("csi", _knn_sql("list_dot_product(p.x, r.u)", "min(s)", 1), {}),
):

    def _knn(spark: SparkSession, sf_dir: str, name=_name, options=_options) -> DataFrame:
        df, fit = probe_rows(spark, sf_dir), fit_rows(spark, sf_dir)
        out = features.csi(df, fit) if name == "csi" else features.knn(df, fit, name.removesuffix("_avg"), **options)
        return out.select("id", "domain", r6(F.col("score")))

    query(f"score_{_name}", _sql)(_knn)


@query("score_knn_classify", f"""WITH {BASE_SQL}, rl AS (SELECT id, label, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM fit), s AS (SELECT p.id, p.domain, r.label, {_COS} AS s FROM pts p, rl r),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id, domain ORDER BY s DESC, label DESC) <= 20), w AS (SELECT id, domain, label, sum(exp(s / 0.07)) AS w FROM k GROUP BY ALL) SELECT id, domain, label AS pred FROM w QUALIFY row_number() OVER (PARTITION BY id, domain ORDER BY w DESC, label) = 1""")
def _knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.knn_classify(probe_rows(spark, sf_dir), fit_rows(spark, sf_dir)).select("id", "domain", "pred")


@query("score_react", f"WITH {BASE_SQL}, th AS (SELECT quantile_cont(v, 0.9) AS t FROM (SELECT unnest(x) AS v FROM fit)), c AS (SELECT id, domain, w, b, list_transform(x, lambda v: least(v, t)) AS y FROM lg, th), y AS (SELECT id, domain, {s_logits('y')} AS z FROM c) SELECT id, domain, {q6(s_lse('z'))} FROM y")
def _react(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.react_threshold(fit_rows(spark, sf_dir))
    return _logit_rows(spark, sf_dir).withColumn("z", vec.matvec(W, features.clipped(X, t), B)).select("id", "domain", r6(vec.lse(Z)))


@query("score_react_projection", f"WITH {BASE_SQL}, th AS (SELECT quantile_cont(v, 0.9) AS t FROM (SELECT unnest(x) AS v FROM fit)), c AS (SELECT id, domain, w, b, mus, list_transform(x, lambda v: least(v, t)) AS x FROM lg, th), y AS (SELECT id, domain, x, mus, {s_logits('x')} AS z FROM c) SELECT id, domain, {q6(SIMPLE['projection_single'][1])} FROM y")
def _react_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.react_threshold(fit_rows(spark, sf_dir))
    rows = _logit_rows(spark, sf_dir).withColumn("x", features.clipped(X, t)).withColumn("z", vec.matvec(W, X, B))
    return rows.select("id", "domain", r6(features.projection(X, MUS, vec.softmax(Z))))


@query(
    "score_igeood_features",
    f"""WITH {BASE_SQL}, pp AS (SELECT label, pos, avg(v) AS m, count(*) AS n, var_pop(v) AS s FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM fit) GROUP BY ALL),
sg AS (SELECT list(s ORDER BY pos) AS sigma FROM (SELECT pos, sqrt(sum(s * n) / sum(n)) AS s FROM pp GROUP BY pos)),
d AS (SELECT id, domain, list_transform(mus, lambda m: list_sum(list_transform(list_zip(x, m, sigma), lambda q: pow(sqrt(2.0) * ln((sqrt(pow(q[1] - q[2], 2) + 8 * q[3] * q[3]) + abs(q[1] - q[2]) + 1e-6) / (sqrt(pow(q[1] - q[2], 2) + 8 * q[3] * q[3]) - abs(q[1] - q[2]) + 1e-6)), 2)))) AS ds FROM lg, sg)
SELECT id, domain, {q6("sqrt(list_min(ds))")} FROM d""",
)
def _igeood_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_params(probe_rows(spark, sf_dir), features.igeood_features_fit(fit_rows(spark, sf_dir)))
    return rows.select("id", "domain", r6(features.igeood_features(X, MUS, F.col("sigma"))))


def _matrix_query(name: str, fn: Callable[[DataFrame, DataFrame, SparkSession, str], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: fn(probe_rows(spark, sf_dir), fit_rows(spark, sf_dir), spark, sf_dir).select("id", "domain", r6(F.col("score"))))


def _head_arrays(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    r = head_of(class_means(fit_rows(spark, sf_dir))).first()
    return np.array(r.w), np.array(r.b)


for _method in ("EmpiricalCovariance", "ShrunkCovariance", "OAS", "LedoitWolf", "MinCovDet"):
    _matrix_query(f"score_mahalanobis_{_method.lower()}", lambda df, fit, spark, sf, m=_method: features.mahalanobis(df, fit, m))
_matrix_query("score_mahalanobis", lambda df, fit, spark, sf: features.mahalanobis(df, fit))
_matrix_query("score_mahalanobis_paper", lambda df, fit, spark, sf: features.mahalanobis(df, fit, semantics="paper"))
_matrix_query("score_mahalanobis_graphicallasso", lambda df, fit, spark, sf: features.mahalanobis(df, fit, "GraphicalLasso"))
_matrix_query("score_relative_mahalanobis", lambda df, fit, spark, sf: features.relative_mahalanobis(df, fit))
_matrix_query("score_vim", lambda df, fit, spark, sf: features.vim(df, fit, *_head_arrays(spark, sf), top_k=32))
_matrix_query("score_ssd", lambda df, fit, spark, sf: features.ssd(df, fit, 2))
_matrix_query("score_gmm", lambda df, fit, spark, sf: gmm.gmm(df, fit, 3))
_matrix_query("score_gmm_diag_paper", lambda df, fit, spark, sf: gmm.gmm(df, fit, 3, "diag", semantics="paper"))


# ---------------------------------------------------------------- layers: stacks, aggregations, p-values


def layer_stacks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(test, fit) with `s`: each layer's largest cosine to the class means of its slice."""
    fit = fit_rows(spark, sf_dir)
    long = layer_rows(fit.select("id", "label", "x"))
    means = class_means(long.withColumn("k", F.struct("layer", "label")), "k").select("k.layer", "mu").groupBy("layer").agg(F.collect_list("mu").alias("mus"))

    def stack(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = layer_rows(df.select(*keys, "x")).join(F.broadcast(means), "layer").select(*keys, "layer", features.maxcosine(X, MUS).alias("v"))
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layer", "v"))).alias("r")).select(*keys, F.transform("r", lambda q: q["v"]).alias("s"))

    return stack(probe_rows(spark, sf_dir), ["id", "domain"]), stack(fit, ["id"])


STACK_SQL = f"""{BASE_SQL},
lmu AS (SELECT l AS layer, list(list_slice(mu, l * {WIDTH} + 1, l * {WIDTH} + {WIDTH}) ORDER BY label) AS mus FROM mu, range({LAYERS}) t(l) GROUP BY l),
tl AS (SELECT id, domain, layer, list_slice(x, layer * {WIDTH} + 1, layer * {WIDTH} + {WIDTH}) AS x, mus FROM pts, lmu),
fl AS (SELECT id, layer, list_slice(x, layer * {WIDTH} + 1, layer * {WIDTH} + {WIDTH}) AS x, mus FROM fit, lmu),
ts AS MATERIALIZED (SELECT id, domain, list({SIMPLE['maxcosine'][1]} ORDER BY layer) AS s FROM tl GROUP BY id, domain),
fs AS MATERIALIZED (SELECT id, list({SIMPLE['maxcosine'][1]} ORDER BY layer) AS s FROM fl GROUP BY id),
st AS (SELECT list(a ORDER BY pos) AS la, list(x ORDER BY pos) AS lx, list(n ORDER BY pos) AS ln_ FROM (SELECT pos, avg(v) AS a, max(v) AS x, min(v) AS n FROM (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS pos FROM fs) GROUP BY pos))"""


def _inner_sql(by: str, integral: bool = False) -> str:
    terms = f"list_transform(list_zip(s, la, {by}), lambda q: q[1] / q[3] * (q[2] / q[3]))"
    scale = f"list_sum(list_transform(list_zip(la, {by}), lambda q: pow(q[1] / q[2], 2)))"
    value = f"list_sum({terms})" + (f" - (({terms})[1] + ({terms})[-1]) / 2" if integral else "")
    return f"({value}) / {scale}"


AGG_SQL = {
    "mean": "list_sum(s) / len(s)",
    "median": "list_sort(s)[CAST(floor((len(s) - 1) / 2) AS BIGINT) + 1]",
    "max": "list_max(s)",
    "min": "list_min(s)",
    "avg_topk": "list_sum(list_reverse_sort(s)[1:2]) / 2",
    "layer_idx": "s[-1]",
    "dws": "list_sum(list_transform(s, lambda v, i: v * (i - 1) / len(s)))",
    "cosine": "list_dot_product(s, la) / (sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(la, la)))",
    "innerprod": _inner_sql("lx"),
    "innerprod_integral": _inner_sql("lx", True),
    "innerprod_mean": _inner_sql("la"),
    "innerprod_min": _inner_sql("ln_"),
}
for _name, _sql in AGG_SQL.items():

    def _aggregate(spark: SparkSession, sf_dir: str, name=_name) -> DataFrame:
        test, fit = layer_stacks(spark, sf_dir)
        return agg.aggregate_stack(test, fit, name).select("id", "domain", r6(F.col("score")))

    query(f"agg_{_name}", f"WITH {STACK_SQL} SELECT id, domain, {q6(_sql)} FROM ts, st")(_aggregate)
for _name in ("mahalanobis", "quantile", "power", "lof", "if"):

    def _numeric(spark: SparkSession, sf_dir: str, name=_name) -> DataFrame:
        test, fit = layer_stacks(spark, sf_dir)
        return agg.aggregate_stack(test, fit, name).select("id", "domain", r6(F.col("score")))

    query(f"agg_{_name}")(_numeric)


def _exploded(values: Callable[[Column], Column]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        test, _ = layer_stacks(spark, sf_dir)
        return test.select("id", "domain", F.posexplode(values(F.col("s"))).alias("pos", "v")).select("id", "domain", "pos", r6(F.col("v")))

    return run


query("agg_none", f"WITH {STACK_SQL} SELECT id, domain, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, {q6('unnest(s)')} FROM ts")(_exploded(agg.STATELESS["none"]))
query("agg_topk", f"WITH {STACK_SQL}, t AS (SELECT id, domain, list_reverse_sort(s)[1:2] AS k FROM ts) SELECT id, domain, CAST(generate_subscripts(k, 1) - 1 AS INTEGER) AS pos, {q6('unnest(k)')} FROM t")(_exploded(agg.topk))


@query("score_projection", f"""WITH {STACK_SQL}, pr AS (SELECT {s_soft('z')} AS p, id, domain FROM lg), prf AS (SELECT {s_soft('z')} AS p, id FROM fitlg),
pt AS (SELECT t.id, t.domain, list(list_sum(list_transform(list_zip(mus, p), lambda q: q[2] * list_dot_product(x, q[1]) / sqrt(list_dot_product(q[1], q[1])))) ORDER BY layer) AS s FROM tl t JOIN pr ON pr.id = t.id AND pr.domain = t.domain GROUP BY t.id, t.domain),
pf AS (SELECT t.id, list(list_sum(list_transform(list_zip(mus, p), lambda q: q[2] * list_dot_product(x, q[1]) / sqrt(list_dot_product(q[1], q[1])))) ORDER BY layer) AS s FROM fl t JOIN prf ON prf.id = t.id GROUP BY t.id),
st2 AS (SELECT list(a ORDER BY pos) AS la, list(x ORDER BY pos) AS lx FROM (SELECT pos, avg(v) AS a, max(v) AS x FROM (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS pos FROM pf) GROUP BY pos))
SELECT id, domain, {q6(_inner_sql('lx'))} FROM pt, st2""")  # fmt: skip
def _projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_rows(spark, sf_dir)
    head = head_of(class_means(fit))
    means = head.select(F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"), "mus").select("layer", F.expr(f"transform(mus, m -> slice(m, layer * {WIDTH} + 1, {WIDTH}))").alias("lmus"))

    def stack(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = with_logits(df, head).select(*keys, "x", vec.softmax(Z).alias("p"))
        rows = layer_rows(rows).join(F.broadcast(means), "layer").select(*keys, "layer", features.projection(X, F.col("lmus"), F.col("p")).alias("v"))
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layer", "v"))).alias("r")).select(*keys, F.transform("r", lambda q: q["v"]).alias("s"))

    return agg.aggregate_stack(stack(probe_rows(spark, sf_dir), ["id", "domain"]), stack(fit, ["id"]), "innerprod").select("id", "domain", r6(F.col("score")))


P_SQL = f"""{STACK_SQL},
rf AS (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS layer FROM fs), nn AS (SELECT count(*) AS n FROM fs),
en AS (SELECT layer, min(v) AS lo, max(v) AS hi FROM rf GROUP BY layer),
xs AS (SELECT layer, v FROM rf UNION ALL SELECT layer, lo * CASE WHEN lo > 0 THEN 1.0 / n ELSE n END FROM en, nn UNION ALL SELECT layer, hi * CASE WHEN hi > 0 THEN n ELSE 1.0 / n END FROM en, nn),
gr AS (SELECT layer, v, sum(count(*)) OVER (PARTITION BY layer ORDER BY v) AS j, lead(v) OVER (PARTITION BY layer ORDER BY v) AS hi FROM xs GROUP BY layer, v),
tv AS (SELECT id, domain, unnest(s) AS v, generate_subscripts(s, 1) AS layer FROM ts),
pv AS (SELECT t.id, t.domain, t.layer, greatest(1e-8, CASE WHEN g.v IS NULL THEN 1.0 WHEN g.hi IS NULL THEN n + 2.0 ELSE g.j + (t.v - g.v) / (g.hi - g.v) END / (n + 2.0)) AS p FROM (SELECT t.*, n FROM tv t, nn) t ASOF LEFT JOIN gr g ON t.layer = g.layer AND t.v >= g.v),
ps AS MATERIALIZED (SELECT id, domain, list(p ORDER BY layer) AS p FROM pv GROUP BY id, domain)"""


def p_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, fit = layer_stacks(spark, sf_dir)
    return agg.p_values(test, fit)


query("combine_p_values", f"WITH {P_SQL} SELECT id, domain, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, {q6('unnest(p)')} FROM ps")(lambda spark, sf_dir: p_rows(spark, sf_dir).select("id", "domain", F.posexplode("p").alias("pos", "v")).select("id", "domain", "pos", r6(F.col("v"))))
_PPF = special.normal_ppf_sql("v")
COMBINE_SQL = {
    "fisher": "-2.0 * list_sum(list_transform(p, lambda v: ln(v)))",
    "stouffer": f"list_sum(list_transform(p, lambda v: {_PPF})) / sqrt(len(p))",
    "tippet": "list_min(p)",
    "wilkinson": "list_max(p)",
    "edgington": "list_sum(p)",
    "pearson": "2.0 * list_sum(list_transform(p, lambda v: ln(1 - v + 1e-6)))",
    "simes": "list_min(list_transform(list_sort(p), lambda v, i: v * len(p) / i))",
    "geometric_mean": "pow(list_product(p), 1.0 / len(p))",
    "rho": f"1 - list_sum(list_transform(list_transform(p, lambda v: {_PPF}), lambda f: pow(f - list_sum(list_transform(p, lambda v: {_PPF})) / len(p), 2))) / (len(p) - 1)",
    "hartung": f"list_sum(list_transform(p, lambda v: {_PPF})) / sqrt(0.7 * len(p) + 0.3 * len(p) * len(p))",
    "fisher_group": "1 - exp(list_sum(list_transform(p, lambda v: ln(v)))) * list_sum(list_transform(range(0, 4), lambda i: pow(-list_sum(list_transform(p, lambda v: ln(v))), i) / factorial(CAST(i AS INTEGER))))",
}
_COLUMNS = agg.COMBINERS | {"rho": agg.rho, "hartung": lambda p: agg.hartung(p, 0.3), "fisher_group": lambda p: agg.fisher_group(p, LAYERS), "stouffer_group": agg.stouffer_group}
for _name, _column in _COLUMNS.items():
    query(f"combine_{_name}", f"WITH {P_SQL} SELECT id, domain, {q6(COMBINE_SQL[_name])} FROM ps" if _name in COMBINE_SQL else None)(lambda spark, sf_dir, c=_column: p_rows(spark, sf_dir).select("id", "domain", r6(c(F.col("p")))))


# ---------------------------------------------------------------- metrics

_LABELLED = "src AS (SELECT 'quality' AS method, d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM labels l JOIN documents d USING (doc_id))"


def score_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(F.lit("quality").alias("method"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


def rounded(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(F.col(c), c) for c in columns])


_RES = ", ".join(q6(m, m) for m in metrics.METRICS)


@query("metric_ood_results", f"WITH {_LABELLED}, {metrics.ood_results_sql('src', 'method')} SELECT method, n_in, n_out, {_RES} FROM res")
def _ood_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ood_results(score_label(spark, sf_dir), ["method"]), ["method", "n_in", "n_out"], list(metrics.METRICS))


@query("metric_roc_curve", f"WITH {_LABELLED}, {metrics.ood_results_sql('src', 'method')} SELECT method, score AS thr, {q6('tpr', 'tpr')}, {q6('fpr', 'fpr')} FROM pts_ WHERE kept")
def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.roc_points(score_label(spark, sf_dir), ["method"]).where("kept")
    return p.select("method", F.col("score").alias("thr"), r6(F.col("tps") / F.col("p_total"), "tpr"), r6(F.col("fps") / F.col("n_total"), "fpr"))


@query("metric_fnr_at_tnr", f"WITH {_LABELLED}, {metrics.ood_results_sql('src', 'method')} SELECT method, 1.0::DOUBLE AS fnr, 1.0::DOUBLE AS tnr FROM res")
def _fnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fnr_at_fixed_tnr(score_label(spark, sf_dir), ["method"])


@query("metric_fnr_at_tnr_paper", f"WITH {_LABELLED}, {metrics.ood_results_sql('src', 'method')} SELECT method, {q6('coalesce(arg_min(1 - tpr, score) FILTER (kept AND 1 - fpr >= 0.95), 1.0)', 'fnr')}, {q6('coalesce(arg_min(1 - fpr, score) FILTER (kept AND 1 - fpr >= 0.95), 1.0)', 'tnr')} FROM pts_ GROUP BY method")
def _fnr_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fnr_at_fixed_tnr(score_label(spark, sf_dir), ["method"], semantics="paper"), ["method"], ["fnr", "tnr"])


@query("metric_autc", f"WITH {_LABELLED}, {metrics.ood_results_sql('src', 'method')}, k AS (SELECT method, score, 1 - tpr AS fnr, fpr, score - lag(score) OVER w AS d, lag(1 - tpr) OVER w AS f0, lag(fpr) OVER w AS g0 FROM pts_ WHERE kept WINDOW w AS (PARTITION BY method ORDER BY score)) SELECT method, round(sum(d * (fnr + f0) / 2), 3) AS aufnr, round(sum(d * (fpr + g0) / 2), 3) AS aufpr, round((sum(d * (fnr + f0) / 2) + sum(d * (fpr + g0) / 2)) / 2, 3) AS autc FROM k GROUP BY method")
def _autc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.autc(score_label(spark, sf_dir), ["method"])
    return m.select("method", *[F.round(c, 3).alias(c) for c in ("aufnr", "aufpr", "autc")])


_RISK = f"{_LABELLED}, {metrics.ood_results_sql('src', 'method')}, cv AS (SELECT method, score AS thr, (tp0 + fp0) / (pt + nt) AS coverage, tp0 / nullif(tp0 + fp0, 0) AS risk FROM pts_ WHERE tp0 + fp0 > 0), pk AS (SELECT method, score AS thr, id FROM src QUALIFY row_number() OVER (PARTITION BY method ORDER BY md5('rc:' || id), id) <= 1001), rc AS (SELECT cv.* FROM pk JOIN cv USING (method, thr))"


@query("metric_risk_coverage", f"WITH {_RISK} SELECT method, thr, {q6('coverage', 'coverage')}, {q6('risk', 'risk')} FROM rc")
def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_coverage(score_label(spark, sf_dir), ["method"]).select("method", "thr", r6(F.col("coverage"), "coverage"), r6(F.col("risk"), "risk"))


@query("metric_aurc", f"WITH {_RISK}, t AS (SELECT method, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS a, (risk - lag(risk) OVER w) * (coverage + lag(coverage) OVER w) / 2 AS s FROM rc WINDOW w AS (PARTITION BY method ORDER BY coverage, thr)) SELECT method, {q6('sum(a)', 'aurc')}, {q6('sum(s)', 'aurc_swapped')} FROM t GROUP BY method")
def _aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.risk_coverage(score_label(spark, sf_dir), ["method"])
    both = metrics.aurc(curve, ["method"]).join(metrics.aurc(curve, ["method"], swapped=True).withColumnRenamed("aurc", "aurc_swapped"), "method")
    return rounded(both, ["method"], ["aurc", "aurc_swapped"])


def sc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sc, ood, label): softmax and cosine confidence of in-distribution and held-out rows; label: misclassified or held out."""
    rows = _logit_rows(spark, sf_dir).where("domain <= 1")
    wrong = F.element_at("labels", vec.argmax(Z) + 1) != F.col("label")
    return rows.select("id", "domain", r6(logits.msp(Z), "sc"), r6(features.maxcosine(X, MUS) + 2.0, "ood"), F.when(wrong | (F.col("domain") == 1), 1).otherwise(0).alias("label"))


SC_SQL = f"{BASE_SQL}, scr AS MATERIALIZED (SELECT id, domain, {q6(SIMPLE['msp'][1], 'sc')}, {q6(SIMPLE['maxcosine'][1] + ' + 2.0', 'ood')}, CASE WHEN labels[list_position(z, list_max(z))] <> label OR domain = 1 THEN 1 ELSE 0 END AS label FROM lg WHERE domain <= 1)"
PLUGIN_SQL = f"""{SC_SQL}, pa AS (SELECT avg(1 - label) AS pi, count(*) AS n, sign(arg_min(ood, id)) AS sg FROM scr),
bo AS (SELECT *, least(0, 0.75 / (1 - pi), -0.25 / (1 - pi), 1 / pi) - 1 AS low FROM pa), b2 AS (SELECT *, greatest(-0.25 / (1 - pi), 1 / pi, low, 0.75 / (1 - pi)) + 1 AS high FROM bo),
lam AS (SELECT i, low + i * ((high - low) / 999) AS lbd FROM b2, range(1000) t(i)),
rl AS (SELECT i, lbd, c, bad, (1 - lbd * pi - (0.75 - lbd * (1 - pi))) * sc + (0.75 - lbd * (1 - pi)) * (sg / (ood + 1e-7)) < 1 - 2 * lbd * pi - (0.75 - lbd * (1 - pi)) AS rej, n FROM (SELECT sc, ood, count(*) AS c, sum(label) AS bad FROM scr GROUP BY ALL), b2, lam),
ra AS (SELECT i, lbd, sum(CASE WHEN rej THEN c ELSE 0 END) / any_value(n) AS rate, sum(CASE WHEN rej THEN 0 ELSE c END) AS cov, sum(CASE WHEN rej THEN 0 ELSE bad END) AS bad, any_value(n) AS n FROM rl GROUP BY i, lbd),
be AS (SELECT k / 100.0 AS brej, lbd, cov, bad, n FROM ra, range(101) t(k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY pow(rate - k / 100.0, 2), i) = 1)"""  # fmt: skip


@query("metric_plugin_bb", f"WITH {PLUGIN_SQL} SELECT round(brej, 6) AS brej, {q6('cov / n', 'coverage')}, {q6('bad / (cov + 1e-7)', 'risk')} FROM be")
def _plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.plugin_bb(sc_rows(spark, sf_dir)).select(F.round("brej", 6).alias("brej"), r6(F.col("coverage"), "coverage"), r6(F.col("risk"), "risk"))


# ---------------------------------------------------------------- drift

SEQ_SQL = "sq AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, value AS score, CAST(event_type = 'error' AS INTEGER) AS mistake, event_id AS id FROM events), nw AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS wu FROM sq), wm AS (SELECT avg(score) AS warm FROM sq, nw WHERE seq < wu)"
WIN = 200


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("mistake"))
    return drift.numbered(e, ["ts", "id"]).drop("ts")


MA_SQL = f"{SEQ_SQL}, ma AS (SELECT seq, score, mistake, (sum(score) OVER w + greatest({WIN - 1} - seq, 0) * warm) / {WIN}.0 AS ma, 1 - sum(mistake) OVER w / {WIN}.0 AS moving_accuracy, n FROM sq, wm, nw WINDOW w AS (ORDER BY seq ROWS {WIN - 1} PRECEDING)), rf AS (SELECT avg(moving_accuracy) * 0.9 AS ref_accuracy FROM ma WHERE seq >= CAST(floor(n * 0.2) AS BIGINT) AND seq < CAST(floor(n * 0.2) AS BIGINT) + (CAST(floor(n * 0.6) AS BIGINT) - CAST(floor(n * 0.2) AS BIGINT)) // 2), dr AS (SELECT ma.*, ref_accuracy, CAST(moving_accuracy < ref_accuracy AS INTEGER) AS drift FROM ma, rf)"


def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence(spark, sf_dir)
    n = rows.count()
    return drift.covariate_drift(rows, WIN, int(n * 0.2), [0, int(n * 0.2), int(n * 0.6), n])


@query("drift_moving", f"WITH {MA_SQL} SELECT seq, round(ma, 9) AS ma, {q6('moving_accuracy', 'moving_accuracy')}, drift FROM dr")
def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_rows(spark, sf_dir).select("seq", F.round("ma", 9).alias("ma"), r6(F.col("moving_accuracy"), "moving_accuracy"), "drift")


@query("drift_ema", f"WITH RECURSIVE {SEQ_SQL}, bl AS (SELECT seq, seq // 10000 AS b, seq % 10000 AS i, CASE WHEN seq = 0 THEN warm ELSE 0.01 * score END AS v FROM sq, wm), ps AS (SELECT *, sum(v * pow(0.99, -i)) OVER (PARTITION BY b ORDER BY i) AS p FROM bl), en AS (SELECT b, pow(0.99, max(i)) * max_by(p, i) AS e, max(i) + 1 AS n FROM ps GROUP BY b), cr AS (SELECT 0 AS b, CAST(0 AS DOUBLE) AS c UNION ALL SELECT en.b + 1, e + c * pow(0.99, n) FROM cr JOIN en ON en.b = cr.b) SELECT seq, {q6('pow(0.99, i) * p + c * pow(0.99, i + 1)', 'ema')} FROM ps JOIN cr USING (b)")
def _ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence(spark, sf_dir)
    n = rows.count()
    warm = rows.where(F.col("seq") < int(n * 0.2)).agg(F.avg("score")).first()[0]
    return drift.ema(rows, warm).select("seq", r6(F.col("ema"), "ema"))


_DRIFT_RES = f"WITH {MA_SQL}, src AS (SELECT 'drift' AS what, -ma AS score, drift AS label FROM dr UNION ALL SELECT 'mistakes', -score, mistake FROM dr), {metrics.ood_results_sql('src', 'what')} SELECT {q6('corr(-ma, drift)', 'corr_drift')}, {q6('corr(ma, moving_accuracy)', 'corr_acc')}, coalesce(min(seq) FILTER (drift = 1), 0) AS first_drift, {q6('max(ref_accuracy)', 'ref_accuracy')}, " + ", ".join(f"round((SELECT {c} FROM res WHERE what = '{k}'), 6) AS {a}_{k}" for k in ("drift", "mistakes") for a, c in (("auroc", "coalesce(auroc, 1.0)"), ("fpr", "fpr_at_tpr"))) + " FROM dr"


@query("drift_summary", _DRIFT_RES)
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = drift.drift_summary(drift_rows(spark, sf_dir))
    return rounded(s, ["first_drift"], [c for c in s.columns if c != "first_drift"])


@query("drift_split_chunks", f"WITH {SEQ_SQL} SELECT CAST(least(seq // CAST(ceil(n / 5.0) AS BIGINT), 4) AS INTEGER) AS chunk, count(*) AS n, {q6('avg(score)', 'score')} FROM sq, nw GROUP BY ALL")
def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence(spark, sf_dir)
    return drift.split_chunks(rows, 5, rows.count()).groupBy("chunk").agg(F.count("*").alias("n"), r6(F.avg("score")))


_LI = "li AS (SELECT l_orderkey * 10 + l_linenumber AS id, round(l_extendedprice / 1000.0, 3) AS score, l_shipdate < (SELECT quantile_disc(l_shipdate, 0.5) FROM lineitem) AS early FROM lineitem)"
SIZES, SAMPLES = [10, 50, 100], 300


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(F.col("l_extendedprice") / 1000.0, 3).alias("score"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"))
    mid = int(li.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY at)")).first()[0])
    return li.where(F.col("at") < mid).select("id", "score"), li.where(F.col("at") >= mid).select("id", "score")


_PLAN = " UNION ALL ".join(f"SELECT {ws} AS ws, w FROM range({SAMPLES // ws}) t(w)" for ws in SIZES)
WIN_SQL = f"""{_LI}, rk AS MATERIALIZED (SELECT id, score, row_number() OVER (ORDER BY md5('ref:' || id), id, score) AS r FROM li WHERE early), vl AS MATERIALIZED (SELECT id, score FROM rk WHERE r > 200 AND r <= 400), ins AS MATERIALIZED (SELECT id, score FROM rk WHERE r > 400), ous AS MATERIALIZED (SELECT id, score FROM li WHERE NOT early),
rf AS MATERIALIZED (SELECT id, score FROM rk WHERE r <= 200), pl AS ({_PLAN}),
wi AS MATERIALIZED (SELECT ws, w, id, score FROM ins, pl QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('in:' || ws || ':' || w || ':' || id), id, score) <= ws),
wv AS MATERIALIZED (SELECT ws, w, id, score FROM vl, pl QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('val:' || ws || ':' || w || ':' || id), id, score) <= ws),
wo AS MATERIALIZED (SELECT ws, w, id, score FROM ous, pl QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('out:' || ws || ':' || w || ':' || id), id, score) <= ws)"""  # fmt: skip


@query("drift_partition_scores", f"WITH {WIN_SQL} SELECT CAST(ws AS INTEGER) AS ws, CAST(w AS INTEGER) AS w, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM wi GROUP BY ws, w")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, _ = drift_sides(spark, sf_dir)
    return drift.partition_scores(drift.split_reference(inside, 2 * max(SIZES))[2], SIZES, SAMPLES, "in").groupBy("ws", "w").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_MIX = """ma_ AS (SELECT ws, w, id, score, 0 AS side FROM wi QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('mix:0:' || ws || ':' || w || ':' || id), id, score) <= ceil(0.5 * ws)
 UNION ALL SELECT ws, w, id, score, 1 FROM wo QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('mix:1:' || ws || ':' || w || ':' || id), id, score) <= ceil(0.5 * ws)),
mx AS MATERIALIZED (SELECT ws, w, id, score FROM ma_ QUALIFY row_number() OVER (PARTITION BY ws, w ORDER BY md5('mix:' || side || ':' || ws || ':' || w || ':' || id), side, id, score) <= ws)"""


def drift_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(validation windows, mixed windows, reference): reference, validation rows and what windows are mixed of are disjoint."""
    inside, outside = drift_sides(spark, sf_dir)
    reference, validation, rest = drift.split_reference(inside, 2 * max(SIZES))
    a, b = drift.partition_scores(rest, SIZES, SAMPLES, "in"), drift.partition_scores(outside, SIZES, SAMPLES, "out")
    return drift.partition_scores(validation, SIZES, SAMPLES, "val"), drift.mixture(a, b, 0.5), reference


@query("drift_mixture", f"WITH {WIN_SQL}, {_MIX} SELECT CAST(ws AS INTEGER) AS ws, CAST(w AS INTEGER) AS w, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM mx GROUP BY ws, w")
def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_windows(spark, sf_dir)[1].groupBy("ws", "w").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _ks_sql(source: str) -> str:
    return f"(SELECT CAST(ws AS INTEGER) AS ws, CAST(w AS INTEGER) AS w, max(abs(f - g)) AS ks FROM (SELECT v.ws, v.w, (SELECT count(*) FROM {source} x WHERE x.ws = v.ws AND x.w = v.w AND x.score <= v.v) / CAST(v.ws AS DOUBLE) AS f, (SELECT count(*) FROM rf WHERE rf.score <= v.v) / 200.0 AS g FROM (SELECT DISTINCT ws, w, score AS v FROM {source} UNION SELECT DISTINCT p.ws, p.w, rf.score FROM rf, pl p) v) GROUP BY ws, w)"


@query("drift_ks_windows", f"WITH {WIN_SQL}, {_MIX}, k AS ({_ks_sql('mx')}) SELECT ws, w, {q6('ks', 'ks')} FROM k")
def _ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mixed, ref = drift_windows(spark, sf_dir)
    return drift.ks_2samp(mixed, ref).select("ws", "w", r6(F.col("ks"), "ks"))


@query("drift_mmd", f"WITH {WIN_SQL}, {_MIX}, xx AS (SELECT avg(exp(-pow(a.score - b.score, 2))) AS v FROM rf a, rf b), xy AS (SELECT ws, w, avg(exp(-pow(m.score - rf.score, 2))) AS v FROM mx m, rf GROUP BY ws, w), yy AS (SELECT a.ws, a.w, avg(exp(-pow(a.score - b.score, 2))) AS v FROM mx a JOIN mx b ON a.ws = b.ws AND a.w = b.w GROUP BY ALL) SELECT CAST(ws AS INTEGER) AS ws, CAST(w AS INTEGER) AS w, {q6('xx.v + yy.v - 2 * xy.v', 'mmd')} FROM yy JOIN xy USING (ws, w), xx")
def _mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mixed, ref = drift_windows(spark, sf_dir)
    return drift.mmd_rbf(mixed, ref).select("ws", "w", r6(F.col("mmd"), "mmd"))


# ---------------------------------------------------------------- preprocessors and reductions

PRE_SQL = {
    "minmax": "(v - n) / CASE WHEN x = n THEN 1 ELSE x - n END",
    "standard": "(v - a) / CASE WHEN d = 0 THEN 1 ELSE d END",
    "robust": "(v - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END",
    "maxabs": "v / CASE WHEN m = 0 THEN 1 ELSE m END",
    "normalizer_l2": "v / norm",
    "none": "v",
}
_PRE_STATS = "pst AS (SELECT pos, min(v) AS n, max(v) AS x, avg(v) AS a, stddev_pop(v) AS d, max(abs(v)) AS m, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM (SELECT unnest(s) AS v, generate_subscripts(s, 1) AS pos FROM fs) GROUP BY pos), pt2 AS (SELECT id, domain, unnest(s) AS v, generate_subscripts(s, 1) AS pos, sqrt(list_dot_product(s, s)) AS norm FROM ts)"
for _name, _fn in preprocess.PREPROCESSORS.items():

    def _pre(spark: SparkSession, sf_dir: str, fn=_fn) -> DataFrame:
        test, fit = layer_stacks(spark, sf_dir)
        return fn(test, fit).select("id", "domain", F.posexplode("s").alias("pos", "v")).select("id", "domain", "pos", r6(F.col("v")))

    query(f"pre_{_name}", f"WITH {STACK_SQL}, {_PRE_STATS} SELECT id, domain, CAST(pos - 1 AS INTEGER) AS pos, {q6(PRE_SQL[_name])} FROM pt2 JOIN pst USING (pos)" if _name in PRE_SQL else None)(_pre)

_REDUCE_SQL = {
    "avg": f"list_transform(range({LAYERS}), lambda l: list_sum(list_slice(x, l * {WIDTH} + 1, l * {WIDTH} + {WIDTH})) / {WIDTH})",
    "max": f"list_transform(range({LAYERS}), lambda l: list_max(list_slice(x, l * {WIDTH} + 1, l * {WIDTH} + {WIDTH})))",
    "getitem": f"list_slice(x, 1, {WIDTH})",
    "flatten": "x",
}
for _name, _sql in _REDUCE_SQL.items():

    def _reduce(spark: SparkSession, sf_dir: str, how=_name) -> DataFrame:
        maps = vectors(spark, sf_dir).select("id", F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), lambda layer: F.slice("x", layer * WIDTH + 1, WIDTH)).alias("m"))
        return maps.select("id", F.posexplode(preprocess.reduce_map(F.col("m"), how, 2)).alias("pos", "v")).select("id", "pos", r6(F.col("v")))

    query(f"reduce_{_name}", f"WITH {BASE_SQL}, t AS (SELECT id, {_sql} AS y FROM e) SELECT id, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS pos, {q6('unnest(y)')} FROM t")(_reduce)

# ---------------------------------------------------------------- sources


def _unit_sql(kind: str, purpose: str) -> str:
    return f"(CAST('0x' || substr(md5('noise:{kind}:{purpose}:' || id || ':' || j), 1, 8) AS BIGINT) / 4294967296.0)"


_NOISE_SQL = {
    "uniform": f"{_unit_sql('uniform', 'a')} * 255.0",
    "rademacher": f"CASE WHEN {_unit_sql('rademacher', 'a')} < 0.5 THEN 0.0 ELSE 255.0 END",
    "gaussian": f"greatest(0.0, least(1.0, sqrt(-2 * ln(1 - {_unit_sql('gaussian', 'a')})) * cos(2 * 3.141592653589793 * {_unit_sql('gaussian', 'b')}) + 0.5)) * 255.0",
}
for _name in tables.NOISES:
    query(f"src_noise_{_name}", f"SELECT id, label, CAST(j AS INTEGER) AS pos, round(v, 4) + 0.0 AS score FROM (SELECT id, -1 AS label, j, {_NOISE_SQL[_name]} AS v FROM range(500) a(id), range(16) b(j))" if _name in _NOISE_SQL else None)(
        lambda spark, sf_dir, kind=_name: tables.noise(spark, kind, 500).select("id", "label", F.posexplode("features").alias("pos", "v")).select("id", "label", "pos", (F.round("v", 4) + F.lit(0.0)).alias("score"))
    )


@query("src_long_tail", f"WITH {BASE_SQL}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label), m AS (SELECT max(n) AS m, count(*) AS c FROM n), k AS (SELECT label, CAST(floor(m * pow(0.1, (row_number() OVER (ORDER BY label) - 1) / (c - 1.0))) AS BIGINT) AS k FROM n, m) SELECT id, e.label FROM e JOIN k ON e.label = k.label QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY id) <= any_value(k) OVER (PARTITION BY e.label)")
def _long_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_tail(vectors(spark, sf_dir).select("id", "label"), 0.1, "exp")


@query("src_long_tail_step", f"WITH {BASE_SQL}, n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c FROM e GROUP BY label), m AS (SELECT max(n) AS m, count(*) AS cs FROM n), k AS (SELECT label, CASE WHEN c < cs // 2 THEN m ELSE CAST(floor(m * 0.1) AS BIGINT) END AS k FROM n, m) SELECT id, e.label FROM e JOIN k ON e.label = k.label QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY id) <= any_value(k) OVER (PARTITION BY e.label)")
def _long_tail_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.long_tail(vectors(spark, sf_dir).select("id", "label"), 0.1, "step")


@query("src_subset_logits", f"WITH {BASE_SQL}, t AS (SELECT id, domain, [z[1], z[3], z[5], z[7]] AS y FROM lg) SELECT id, domain, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS pos, {q6('unnest(y)')} FROM t")
def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array(*[F.lit(i % 2 == 0) for i in range(7)])
    return _logit_rows(spark, sf_dir).select("id", "domain", F.posexplode(tables.subset_logits(F.col(Z), mask)).alias("pos", "v")).select("id", "domain", "pos", r6(F.col("v")))


# ---------------------------------------------------------------- experiment logs: the relational operators


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, method, seed, ord, metrics as dict text, value): a log with repeated runs, from nations and their customers."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.round(F.col("c_acctbal") / 1000.0, 3)
    text = F.concat(F.lit("{'auroc': "), value.cast("string"), F.lit(", 'fpr': "), F.round(F.lit(1.0) - value / 10.0, 4).cast("string"), F.lit("}"))
    return c.select(F.col("n_name").alias("model"), F.col("c_mktsegment").alias("method"), (F.col("c_custkey") % 3).alias("seed"), F.col("c_custkey").alias("ord"), text.alias("metrics"), F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(value).alias("value"))


LOG_SQL = "log AS (SELECT n_name AS model, c_mktsegment AS method, c_custkey % 3 AS seed, c_custkey AS ord, round(c_acctbal / 1000.0, 3) AS auroc, round(1.0 - round(c_acctbal / 1000.0, 3) / 10.0, 4) AS fpr, CASE WHEN c_custkey % 7 = 0 THEN 'nan'::DOUBLE ELSE round(c_acctbal / 1000.0, 3) END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def relational(name: str, sql: str) -> Callable:
    return query(f"rel_{name}", f"WITH {LOG_SQL} {sql}")


@relational("filter", "SELECT ord, model, method FROM log WHERE method IN ('BUILDING', 'MACHINERY') AND seed <> 1 AND model NOT IN ('FRANCE')")
def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).where(F.col("method").isin("BUILDING", "MACHINERY") & (F.col("seed") != 1) & ~F.col("model").isin("FRANCE")).select("ord", "model", "method")


@relational("distinct", "SELECT DISTINCT model, method, seed FROM log")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).select("model", "method", "seed").distinct()


@relational("distinct_keep_last", "SELECT model, method, max(ord) AS ord FROM log GROUP BY ALL")
def _keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_by in place of a window: the last row of a key needs no sort, and is combined before the shuffle."""
    log = run_log(spark, sf_dir)
    return log.groupBy("model", "method").agg(F.max_by(F.struct(*log.columns), "ord").alias("r")).select("model", "method", "r.ord")


@relational("dropna", "SELECT ord, value FROM log WHERE NOT isnan(value)")
def _dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).select("ord", "value").na.drop()


@relational("groupby_mean", f"SELECT model, method, count(*) AS n, {q6('avg(value)', 'value')} FROM log WHERE NOT isnan(value) GROUP BY ALL")
def _groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).na.drop(subset=["value"]).groupBy("model", "method").agg(F.count("*").alias("n"), r6(F.avg("value"), "value"))


@relational("join", "SELECT a.ord, b.ord AS other FROM log a JOIN log b ON a.model = b.model AND a.method = b.method AND a.seed = b.seed AND a.auroc = b.auroc AND a.fpr = b.fpr WHERE a.ord < b.ord OR a.ord % 100 = 0 AND a.ord = b.ord")
def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = run_log(spark, sf_dir).select("model", "method", "seed", "metrics", "ord")
    b = a.withColumnRenamed("ord", "other")
    return a.join(b, ["model", "method", "seed", "metrics"], "inner").where("ord < other OR ord % 100 = 0 AND ord = other").select("ord", "other")


@relational("union", "SELECT ord, seed FROM log WHERE seed = 0 UNION ALL SELECT ord, seed FROM log WHERE seed < 2")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir).select("ord", "seed")
    return log.where("seed = 0").unionByName(log.where("seed < 2"))


@relational("group_to_array", "SELECT model, method, len(list(ord ORDER BY ord)) AS n, list_sum(list_transform(list(ord ORDER BY ord), lambda v, i: v * i))::BIGINT AS checksum FROM log GROUP BY ALL")
def _to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = run_log(spark, sf_dir).groupBy("model", "method").agg(F.array_sort(F.collect_list("ord")).alias("a"))
    return g.select("model", "method", F.size("a").cast("long").alias("n"), F.aggregate(F.transform("a", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v).alias("checksum"))


@relational("sort", f"SELECT model, {q6('avg(auroc)', 'auroc')}, row_number() OVER (ORDER BY avg(auroc) DESC, model)::INTEGER AS place FROM log GROUP BY model")
def _sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = run_log(spark, sf_dir).withColumn("m", tables.dict_literal(F.col("metrics"))).groupBy("model").agg(F.avg("m.auroc").alias("a"))
    return g.select("model", r6(F.col("a"), "auroc"), F.row_number().over(Window.orderBy(F.desc("a"), "model")).alias("place"))


@relational("json_columns", "SELECT ord, auroc, fpr FROM log")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.dict_literal(F.col("metrics"))
    return run_log(spark, sf_dir).select("ord", m["auroc"].alias("auroc"), m["fpr"].alias("fpr"))


@relational("row_mean", f"SELECT ord, {q6('(auroc + fpr) / 2', 'mean')} FROM log")
def _row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.dict_literal(F.col("metrics"))
    return run_log(spark, sf_dir).select("ord", r6(vec.total(F.array(m["auroc"], m["fpr"])) / 2, "mean"))


@relational("highlight_best", "SELECT model, method, CAST(v = max(v) OVER (PARTITION BY model) AS INTEGER) AS best, printf('%.1f', floor(1000 * v + 1e-6) / 10) AS shown FROM (SELECT model, method, round(avg(auroc), 9) AS v FROM log GROUP BY ALL)")
def _highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tables.dict_literal(F.col("metrics"))
    g = run_log(spark, sf_dir).groupBy("model", "method").agg(F.round(F.avg(m["auroc"]), 9).alias("v"))
    return g.select("model", "method", (F.col("v") == F.max("v").over(Window.partitionBy("model"))).cast("int").alias("best"), F.format_string("%.1f", F.floor(F.col("v") * 1000 + 1e-6) / 10).alias("shown"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@relational("pivot", "SELECT model, " + ", ".join(f"count(*) FILTER (method = '{s}') AS {s.lower()}" for s in SEGMENTS) + " FROM log GROUP BY model")
def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = run_log(spark, sf_dir).groupBy("model").pivot("method", list(SEGMENTS)).agg(F.count(F.lit(1)))
    return p.select("model", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in SEGMENTS])


@relational("already_done", "SELECT ord FROM log a WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.model = a.model AND b.method = a.method AND b.seed = 0)")
def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    return log.join(log.where("seed = 0").select("model", "method").distinct(), ["model", "method"], "left_anti").select("ord")


@relational("rename_replace", "SELECT ord AS run, CASE method WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE lower(method) END AS short FROM log")
def _rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("BUILDING"), F.lit("b"), F.lit("MACHINERY"), F.lit("m"))
    return run_log(spark, sf_dir).withColumnsRenamed({"ord": "run"}).select("run", F.coalesce(names[F.col("method")], F.lower("method")).alias("short"))
