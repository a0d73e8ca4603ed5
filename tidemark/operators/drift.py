"""Drift operators: moving averages and accuracy over ordered sequences, and two-sample windows.

A sequence is a DataFrame with a gapless `seq` from 0 in each series. Row frames need neighbours, not whole series: the
sequence is cut in blocks of bounded length, each block also gets the rows that its frames reach back to, and windows
are partitioned by (series, block). So one long series is as parallel as many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None, runs: int = 64) -> DataFrame:
    """df with `seq`: its place in the order, from 0, in each series. Ties beyond `order` are broken by nothing: it must be total.

    The first order column is cut at approximate quantiles; places inside a run come from a window, those before it from run counts.
    """
    keys = keys or []
    first = order[0]
    as_long = F.unix_micros(F.col(first).cast("timestamp")).cast("double") if dict(df.dtypes)[first].startswith("timestamp") else F.col(first).cast("double")
    df = df.withColumn("_o", as_long)
    cuts = df.groupBy(*keys).agg(F.percentile_approx("_o", F.array(*[F.lit(i / runs) for i in range(1, runs)]), 1000).alias("_cuts"))
    df = (df.join(F.broadcast(cuts), keys) if keys else df.crossJoin(F.broadcast(cuts))).withColumn("_run", F.size(F.filter("_cuts", lambda c: c <= F.col("_o")))).drop("_cuts", "_o")
    base = df.groupBy(*keys, "_run").count()
    base = base.withColumn("_base", F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    df = df.join(F.broadcast(base), [*keys, "_run"])
    return df.withColumn("seq", (F.col("_base") + F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1).cast("long")).drop("_base", "_run")


def _blocks(df: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows with their block, and copies (halo) of the rows that the next blocks' frames reach back to."""
    block = max(block, reach)
    own = (F.col("seq") / block).cast("long")
    copies = F.when(F.col("seq") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_own", own).withColumn("_block", F.explode(copies))


def moving(df: DataFrame, win: int, keys: list[str] | None = None, warm: Column | float = 0.0, value: str = "score", out: str = "ma", block: int = BLOCK) -> DataFrame:
    """df with the mean of the last `win` values, padded with `warm` before the start."""
    keys = keys or []
    w = Window.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(-(win - 1), 0)
    padded = F.greatest(F.lit(win - 1) - F.col("seq"), F.lit(0))
    rows = _blocks(df, win - 1, block) if win > 1 else _blocks(df, 0, block)
    return rows.withColumn(out, (F.sum(value).over(w) + padded * warm) / F.lit(float(win))).where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def ema(df: DataFrame, warm: float, alpha: float = 0.99, keys: list[str] | None = None, value: str = "score", block: int = 4096) -> DataFrame:
    """df with `ema`: e_0 = warm, e_i = alpha e_(i-1) + (1 - alpha) s_i.

    Block by block: each block's own average from 0, then a carry chain over the blocks, then carry * alpha^place.
    """
    keys = keys or []
    rows = df.withColumn("_block", (F.col("seq") / block).cast("long"))
    packed = rows.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("q"), F.col(value).cast("double").alias("v")))).alias("r"))
    # a step of the fold gives the running value of each place; the first row of all counts the warm-up only
    start = F.struct(F.lit(0.0).alias("e"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, r: Column) -> Column:
        e = F.when(r["q"] == 0, F.lit(float(warm))).otherwise(acc["e"] * alpha + r["v"] * (1 - alpha))
        return F.struct(e.alias("e"), F.concat(acc["all"], F.array(e)).alias("all"))

    packed = packed.withColumn("f", F.aggregate("r", start, step)).withColumn("n", F.size("r"))
    carry = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = packed.select(*keys, "_block", F.struct(F.col("f.e").alias("e"), F.when(F.col("_block") == 0, 0.0).otherwise(F.pow(F.lit(alpha), F.col("n"))).alias("k")).alias("s"))
    ends = ends.withColumn("carry", F.aggregate(F.collect_list("s").over(carry), F.lit(0.0), lambda a, s: a * s["k"] + s["e"])).drop("s")
    joined = packed.join(ends, [*keys, "_block"])
    out = joined.select(*keys, F.explode(F.arrays_zip(F.transform("r", lambda r: r["q"]).alias("q"), F.col("f.all").alias("e"), F.transform("r", lambda r, i: F.when(F.col("_block") == 0, 0.0).otherwise(F.col("carry") * F.pow(F.lit(alpha), i + 1))).alias("c"))).alias("z"))
    return df.join(out.select(*keys, F.col("z.q").alias("seq"), (F.col("z.e") + F.col("z.c")).alias("ema")), [*keys, "seq"])


def covariate_drift(df: DataFrame, win: int, warmup: int, splits: list[int], acc_threshold: float = 0.9, alpha: float = 0.99) -> DataFrame:
    """Rows (seq, score, mistake, ma, moving_accuracy, drift, ref_accuracy) of one series; drift: moving accuracy below the reference.

    df: seq, score, mistake (0/1). The reference is acc_threshold times the mean moving accuracy over the first half of
    the second split.
    """
    warm = df.where(F.col("seq") < warmup).agg(F.avg("score")).first()[0] or 0.0
    rows = moving(df, win, warm=float(warm))
    rows = moving(rows, win, value="mistake", out="_m").withColumn("moving_accuracy", 1 - F.col("_m")).drop("_m")
    half = splits[1] + (splits[2] - splits[1]) // 2
    ref = rows.where((F.col("seq") >= splits[1]) & (F.col("seq") < half)).agg((F.avg("moving_accuracy") * acc_threshold).alias("ref_accuracy"))
    return rows.crossJoin(F.broadcast(ref)).withColumn("drift", (F.col("moving_accuracy") < F.col("ref_accuracy")).cast("int"))


def _corr(a: Column, b: Column) -> Column:
    """Pearson's correlation; null for a constant side."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def drift_summary(rows: DataFrame) -> DataFrame:
    """One row of covariate_drift()'s result: corr_drift, corr_acc, auroc_drift, auroc_mistakes, fpr_drift, fpr_mistakes, first_drift, ref_accuracy.

    A constant label has AUROC 1 and no FPR.
    """
    from tidemark.operators.metrics import ood_results

    both = rows.select(F.lit("drift").alias("what"), (-F.col("ma")).alias("score"), F.col("drift").alias("label")).unionByName(rows.select(F.lit("mistakes").alias("what"), (-F.col("score")).alias("score"), F.col("mistake").cast("int").alias("label")))
    m = ood_results(both, ["what"]).select("what", F.coalesce("auroc", F.lit(1.0)).alias("auroc"), "fpr_at_tpr").groupBy().agg(*[F.max(F.when(F.col("what") == k, F.col(c))).alias(f"{c.split('_')[0]}_{k}") for k in ("drift", "mistakes") for c in ("auroc", "fpr_at_tpr")])
    s = rows.agg(_corr(-F.col("ma"), F.col("drift")).alias("corr_drift"), _corr(F.col("ma"), F.col("moving_accuracy")).alias("corr_acc"), F.coalesce(F.min(F.when(F.col("drift") == 1, F.col("seq"))), F.lit(0)).alias("first_drift"), F.max("ref_accuracy").alias("ref_accuracy"))
    return s.crossJoin(m)


def split_chunks(df: DataFrame, chunks: int, total: int) -> DataFrame:
    """df with `chunk`: equal parts of the sequence by integer division."""
    return df.withColumn("chunk", F.least((F.col("seq") / F.lit(-(-total // chunks))).cast("int"), F.lit(chunks - 1)))


# ---------------------------------------------------------------- windows of draws


def draw_key(seed: str, *cols: str | Column) -> Column:
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in parts]).cast("binary"))


def partition_scores(df: DataFrame, sizes: list[int], samples: int, seed: str = "win") -> DataFrame:
    """(ws, w, id, score): for each size ws, samples // ws windows of ws rows drawn without replacement, afresh for each window.

    A draw is the ws rows with the least md5 of (seed, ws, w, id). Keys are uniform, so only those below a bound that some
    2 ws + 40 rows of a window pass are ranked; a window that fewer than ws rows pass is ranked over all its rows.
    """
    spark = df.sparkSession
    windows = [(ws, w) for ws in sizes for w in range(samples // ws)]
    total = df.count()
    bounds = {ws: f"{min((1 << 32) - 1, int((2 * ws + 40) / max(1, total) * (1 << 32))):08x}" for ws in sizes}

    def keyed(which: list[tuple[int, int, str]]) -> DataFrame:
        plan = spark.createDataFrame(which, "ws int, w int, bound string")
        return df.crossJoin(F.broadcast(plan)).withColumn("key", draw_key(seed, "ws", "w", "id")).where(F.col("key") < F.col("bound"))

    low = keyed([(ws, w, bounds[ws]) for ws, w in windows])
    passed = {(r.ws, r.w): r["count"] for r in low.groupBy("ws", "w").count().collect()}
    # "g" follows every hexadecimal digit: no bound
    low = keyed([(ws, w, bounds[ws] if passed.get((ws, w), 0) >= ws else "g") for ws, w in windows])
    pick = Window.partitionBy("ws", "w").orderBy("key", "id", "score")
    return low.withColumn("r", F.row_number().over(pick)).where((F.col("r") <= F.lit(max(sizes))) & (F.col("r") <= F.col("ws"))).drop("r", "key", "bound")


def split_reference(df: DataFrame, n: int, seed: str = "ref") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reference, validation, rest): disjoint; n rows each of the first two, by the md5 of (seed, id)."""
    order = ["key", "id", "score"]
    keyed = df.withColumn("key", draw_key(seed, "id"))
    first = keyed.orderBy(*order).limit(2 * n).withColumn("r", F.row_number().over(Window.orderBy(*order)))  # 2 n rows
    last = first.orderBy(F.desc("r")).select(*order).first()
    after = F.lit(False) if last is None else F.struct(*order) > F.struct(*[F.lit(last[c]).alias(c) for c in order])
    return (*[first.where(c).drop("key", "r") for c in (F.col("r") <= n, F.col("r") > n)], keyed.where(after).drop("key"))


def mixture(inside: DataFrame, outside: DataFrame, share: float, seed: str = "mix") -> DataFrame:
    """(ws, w, id, score): of each window, ceil((1 - share) ws) rows of inside and ceil(share ws) of outside, the first ws by md5."""
    a = inside.withColumn("side", F.lit(0)).withColumn("n", F.ceil((1 - F.lit(share)) * F.col("ws")))
    b = outside.withColumn("side", F.lit(1)).withColumn("n", F.ceil(F.lit(share) * F.col("ws")))
    w1 = Window.partitionBy("ws", "w", "side").orderBy("key", "id", "score")
    both = a.unionByName(b).withColumn("key", draw_key(seed, "side", "ws", "w", "id"))
    both = both.withColumn("r", F.row_number().over(w1)).where("r <= n")
    w2 = Window.partitionBy("ws", "w").orderBy("key", "side", "id", "score")
    return both.withColumn("r", F.row_number().over(w2)).where("r <= ws").select("ws", "w", "id", "score")


def ks_2samp(windows: DataFrame, ref: DataFrame) -> DataFrame:
    """(ws, w, n, ks): the largest difference of the two empirical distributions, at every distinct value of either.

    Each window's values are few; the reference's counts at them come from one sorted merge of the reference with all windows' values.
    """
    values = windows.groupBy("ws", "w", F.col("score").alias("v")).agg(F.count("*").alias("c"))
    n_ref = ref.count()
    grid = ref.groupBy(F.col("score").alias("v")).agg(F.count("*").alias("rc"))
    each = values.select("ws", "w").distinct()
    merged = values.select("ws", "w", "v", "c", F.lit(0).cast("long").alias("rc")).unionByName(F.broadcast(each).crossJoin(grid).select("ws", "w", "v", F.lit(0).cast("long").alias("c"), "rc"))
    merged = merged.groupBy("ws", "w", "v").agg(F.sum("c").alias("c"), F.sum("rc").alias("rc"))
    up = Window.partitionBy("ws", "w").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("ws", "w")
    d = merged.withColumn("f", F.sum("c").over(up) / F.sum("c").over(every)).withColumn("g", F.sum("rc").over(up) / F.lit(float(n_ref)))
    return d.groupBy("ws", "w").agg(F.sum("c").alias("n"), F.max(F.abs(F.col("f") - F.col("g"))).alias("ks"))


def mmd_rbf(windows: DataFrame, ref: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(ws, w, n, mmd): mean K(X, X) + mean K(Y, Y) - 2 mean K(X, Y), K = exp(-gamma d^2); K(X, X) is computed once.

    The reference of the definition is a bounded draw (twice the largest window); it is merged by equal values, so that
    the pair sums run over distinct values with weights.
    """
    def kernel(a: str, b: str) -> Column:
        return F.exp(-gamma * F.pow(F.col(a) - F.col(b), 2))

    x = ref.groupBy(F.col("score").alias("x")).agg(F.count("*").alias("xc"))
    n = ref.count()
    xx = x.crossJoin(F.broadcast(x.select(F.col("x").alias("x2"), F.col("xc").alias("xc2")))).agg((F.sum(kernel("x", "x2") * F.col("xc") * F.col("xc2")) / float(n) ** 2).alias("xx"))
    y = windows.groupBy("ws", "w", F.col("score").alias("y")).agg(F.count("*").alias("yc"))
    xy = y.crossJoin(F.broadcast(x)).groupBy("ws", "w").agg(F.sum(kernel("x", "y") * F.col("xc") * F.col("yc")).alias("xy"))
    yy = y.join(y.select("ws", "w", F.col("y").alias("y2"), F.col("yc").alias("yc2")), ["ws", "w"]).groupBy("ws", "w").agg(F.sum(kernel("y", "y2") * F.col("yc") * F.col("yc2")).alias("yy"))
    counts = y.groupBy("ws", "w").agg(F.sum("yc").alias("n"))
    m = F.col("n").cast("double")
    return counts.join(xy, ["ws", "w"]).join(yy, ["ws", "w"]).crossJoin(F.broadcast(xx)).select("ws", "w", "n", (F.col("xx") + F.col("yy") / (m * m) - 2 * F.col("xy") / (m * float(n))).alias("mmd"))
