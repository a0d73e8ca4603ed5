"""The canonical inputs: fit and test vectors with their domains, a linear head, layers and score sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vec

#: Labels up to this one are in distribution.
LAST_ID_LABEL = 6
LAYERS, WIDTH = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where((F.col("label") <= LAST_ID_LABEL) & (F.col("id") % 2 == 0))


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, x, label): 0 in distribution, 1 held-out classes, 2 scaled by 1.5, 3 shifted by 0.25 on even positions."""
    v = vectors(spark, sf_dir)
    inside = v.where((F.col("label") <= LAST_ID_LABEL) & (F.col("id") % 2 == 1))
    parts = [
        inside.select("id", F.lit(0).alias("domain"), "x", "label"),
        v.where(F.col("label") > LAST_ID_LABEL).select("id", F.lit(1).alias("domain"), "x", "label"),
        inside.select((F.col("id") + 1_000_000).alias("id"), F.lit(2).alias("domain"), vec.scaled(F.col("x"), 1.5).alias("x"), "label"),
        inside.select((F.col("id") + 2_000_000).alias("id"), F.lit(3).alias("domain"), F.transform("x", lambda e, i: e + F.when(i % 2 == 0, 0.25).otherwise(0.0)).alias("x"), "label"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_means(fit: DataFrame, by: str = "label", x: str = "x") -> DataFrame:
    """(by, mu, n): element-wise means of each class, pre-aggregated by position."""
    long = fit.select(by, F.posexplode(x).alias("pos", "v")).groupBy(by, "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    pairs = long.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm"), F.max("n").alias("n"))
    return pairs.select(by, F.transform("pm", lambda s: s["m"]).alias("mu"), "n")


def head_of(means: DataFrame) -> DataFrame:
    """One row (w, b, mus, labels): the linear head w = 10 mu, b = -5 |mu|^2, in the order of the labels."""
    rows = means.select(F.struct("label", "mu").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(F.transform("s", lambda r: vec.scaled(r["mu"], 10.0)).alias("w"), F.transform("s", lambda r: vec.dot(r["mu"], r["mu"]) * -5.0).alias("b"), F.transform("s", lambda r: r["mu"]).alias("mus"), F.transform("s", lambda r: r["label"]).alias("labels"))


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """df with the columns of a one-row parameter table, which is what is broadcast."""
    return df.crossJoin(F.broadcast(params.limit(1)))


def with_logits(df: DataFrame, head: DataFrame) -> DataFrame:
    """df with w, b, mus, labels and the logits z."""
    return with_params(df, head).withColumn("z", vec.matvec(F.col("w"), F.col("x"), F.col("b")))


def layer_rows(df: DataFrame) -> DataFrame:
    """The vectors' slices in long form: (..., layer, x)."""
    others = [c for c in df.columns if c != "x"]
    return df.select(*others, F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"), "x").withColumn("x", F.expr(f"slice(x, layer * {WIDTH} + 1, {WIDTH})"))


# ---------------------------------------------------------------- the same inputs as SQL for the oracle

BASE_SQL = f"""e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label FROM embeddings),
fit AS (SELECT * FROM e WHERE label <= {LAST_ID_LABEL} AND id % 2 = 0),
inside AS (SELECT * FROM e WHERE label <= {LAST_ID_LABEL} AND id % 2 = 1),
pts AS (SELECT id, 0 AS domain, x, label FROM inside UNION ALL SELECT id, 1, x, label FROM e WHERE label > {LAST_ID_LABEL}
 UNION ALL SELECT id + 1000000, 2, list_transform(x, lambda v: v * 1.5), label FROM inside
 UNION ALL SELECT id + 2000000, 3, list_transform(x, lambda v, i: v + CASE WHEN i % 2 = 1 THEN 0.25 ELSE 0.0 END), label FROM inside),
mu AS (SELECT label, list(m ORDER BY pos) AS mu FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM fit) GROUP BY label, pos) GROUP BY label),
head AS (SELECT list(list_transform(mu, lambda v: 10 * v) ORDER BY label) AS w, list(-5 * list_dot_product(mu, mu) ORDER BY label) AS b, list(mu ORDER BY label) AS mus, list(label ORDER BY label) AS labels FROM mu),
lg AS (SELECT p.id, p.domain, p.x, p.label, list_transform(w, lambda c, i: list_dot_product(c, p.x) + b[i]) AS z, w, b, mus, labels FROM pts p, head),
fitlg AS (SELECT p.id, p.x, p.label, list_transform(w, lambda c, i: list_dot_product(c, p.x) + b[i]) AS z, w, b, mus, labels FROM fit p, head)"""
