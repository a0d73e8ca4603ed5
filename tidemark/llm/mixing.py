"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only.

Documents are counted in cells of (source, language, topic), by tokens. The cells' token weights are raked: each sweep
scales them to the targets of one margin after the other, until all margins hold within a tolerance. Targets are given
({dimension: {value: share}}), or flatten the found shares. A cell's weight over its tokens is its ratio. A document is
kept with probability rate * ratio, where the rate is the wanted share of all tokens or, if it is less, that at which the largest ratio
makes probability 1: no probability is clipped, so the expected sample has the raked margins.
With `bounded` (the pipeline) the sample keeps the wanted share instead: weights are raked under the bound that no
probability exceeds 1. The expected sample has
the target margins, where the found tokens suffice; a value with too few is kept whole, its remainder is dealt to the
other values in proportion, and a warning gives its size. The draw is a hash of the id and a seed: it can be repeated, and copies of a row
share their fate.

Only cells, never documents, are iterated on; sums are pre-aggregated, so a source that holds a third of all rows is
one row of the cell table. Where the counted cells are few, sweeps run in one partition without a shuffle and cells are broadcast to
the documents; beyond that margins are aggregated and joined. Both ways give the same weights.

Defined results: null source or language is a class of its own, `(none)`; null and empty texts have 0 tokens and the
topic `empty`; a cell without tokens has ratio 1. A null id is drawn as the text `null`. Repeated rows are weighed each.
A value without a given target loses its weight. Names of other columns may clash with nothing but those that start with `_mix_`. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, stored, table

DIMS = ("source", "lang", "topic")
#: Targets flatten the found shares: share ** power, brought to sum 1.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
KEEP, SEED = 0.75, "mix-1"
#: The largest relative margin error that counts as met, and the sweeps after which contradicting targets are given up, with a warning.
TOLERANCE, BOUNDED_TOLERANCE, MOST_SWEEPS = 1e-9, 1e-5, 60
#: Sweeps between two looks at the error, where the cells are few.
CHAIN = 5
#: Cells that are raked in one partition and broadcast at most; some 100 bytes each.
BROADCAST_CELLS = 50_000


def tokens_of(text: Column) -> Column:
    """Runs outside \\x20 \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by the text's form: empty, table, list (many lines for its length), brief, long or prose."""
    size = F.length(text)
    lines = size - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(text.isNull() | (size == 0), "empty").when(F.instr(text, " | ") > 0, "table").when(lines * 120 > size, "list").when(size < 600, "brief").when(size >= 6000, "long").otherwise("prose")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def default_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): shares that sum to 1."""
    shares = cells.groupBy(dim).agg(F.sum("base").alias("n")).where("n > 0").select(dim, F.pow(F.col("n").cast("double"), F.lit(power)).alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 1.0
    return shares.select(dim, (F.col("n") / F.lit(total)).alias("target"))


def reachable(cells: DataFrame, dim: str, target: DataFrame, keep: float) -> tuple[DataFrame, float]:
    """(dim, target) that a sample of the share `keep` can have, sum 1, and the share that moved.

    A value with fewer tokens than its target asks for gets what all of them make; the others share the rest in proportion.
    """
    total = float(cells.agg(F.sum("base")).first()[0] or 0)
    values = cells.groupBy(dim).agg((F.sum("base") / F.lit(keep * total)).alias("most")).join(target, dim).checkpoint()
    rate, moved = 1.0, values.agg(F.sum(F.greatest(F.col("target") - F.col("most"), F.lit(0.0)))).first()[0] or 0.0
    while True:  # each round that goes on has one more value at its most
        full = F.col("target") * F.lit(rate) >= F.col("most")
        taken, loose = values.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("target")))).first()
        if not loose or (1 - taken) / loose <= rate * (1 + 1e-12):
            break
        rate = (1 - taken) / loose
    return values.select(dim, F.least("most", F.col("target") * F.lit(rate)).alias("target")), moved


def margin_error(raked: DataFrame, dims: list[str], total: float) -> float:
    """The largest relative distance of a margin of `weight` from its target, over all values with one; raked has target_<dim>."""
    margins = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.col(f"target_{d}").alias("target")) for d in dims]))
    margins = raked.select("weight", margins.alias("m")).where("m.target > 0").groupBy("m.dim", "m.value").agg(F.sum("weight").alias("weight"), F.max("m.target").alias("target"))
    return margins.agg(F.max(F.abs(F.col("weight") / (F.col("target") * F.lit(total)) - 1))).first()[0] or 0.0


def _bounded(cells: DataFrame, keep: float | None) -> DataFrame:
    return cells if keep is None else cells.withColumn("weight", F.least("weight", F.col("base") / F.lit(keep)))


def _step(cells: DataFrame, dim: str, total: float, keep: float | None, few: bool) -> DataFrame:
    """cells with `weight` scaled to the targets of one dimension; with keep so that what is under its bound fills up what capped cells leave of the margin."""
    aim, bound = f"coalesce(target_{dim}, 0D) * {total!r}D", f"base / {keep!r}D"
    sums = {"margin": "weight"}
    if keep is not None:
        sums = {"margin": f"least(weight, {bound})", "full": f"CASE WHEN weight >= {bound} THEN {bound} ELSE 0D END", "loose": f"CASE WHEN weight >= {bound} THEN 0D ELSE weight END"}
    if few:  # one partition: no shuffle
        sums = {n: f"sum({c}) OVER (PARTITION BY {dim})" for n, c in sums.items()}
    else:
        cells = cells.join(cells.groupBy(dim).agg(*[F.expr(f"sum({c})").alias(n) for n, c in sums.items()]), dim)
        sums = {n: n for n in sums}
    rest = "" if keep is None else f"WHEN {sums['loose']} > 0 AND {aim} > {sums['full']} THEN ({aim} - {sums['full']}) / {sums['loose']} "
    factor = f"CASE WHEN {sums['margin']} <= 0 OR {aim} <= 0 THEN 0D {rest}ELSE {aim} / {sums['margin']} END"
    return cells.selectExpr(*[c for c in cells.columns if c not in ("weight", "margin", "full", "loose")], f"weight * {factor} AS weight")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, keep: float | None = None, few: bool | None = None) -> DataFrame:
    """cells (dims, base) with `weight`: raked to the targets of each dimension until the largest relative margin error is below the tolerance, the total unchanged.

    A value without a target loses its weight; a target without tokens is left out. Targets that contradict each other
    cannot be met: then raking ends after MOST_SWEEPS and warns with the error that is left. With keep no weight exceeds
    base / keep, so that keep * weight / base is a probability. few: by default whether the counted cells are.
    """
    shared_dir(cells.sparkSession)
    total = float(cells.agg(F.sum("base")).first()[0] or 0)
    out = cells.withColumn("weight", F.col("base").cast("double"))
    for dim, target in targets.items():
        out = out.join(target.withColumnRenamed("target", f"target_{dim}"), dim, "left")
    out = out.checkpoint()
    count = out.count()
    few = count <= BROADCAST_CELLS if few is None else few
    parts = 1 + count // BROADCAST_CELLS
    error, sweeps = 0.0, 0
    while sweeps < MOST_SWEEPS:
        out = out.coalesce(1 if few else parts)
        for _ in range(CHAIN if few else 1):
            for dim in targets:
                out = _step(out, dim, total, keep, few)
                if not few:  # each step reads the one before twice: without a cut the reads would double at every step
                    out = out.coalesce(parts).checkpoint()
            sweeps += 1
        out = out.checkpoint()
        error = margin_error(_bounded(out, keep), list(targets), total)
        if error < tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {sweeps} sweeps with a margin error of {error:.2g}, tolerance {tolerance:.2g}: the targets may contradict each other", stacklevel=2)
    return _bounded(out, keep).drop(*[f"target_{d}" for d in targets])


def with_rate(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells with `ratio` and `probability`: rate * ratio, with the largest rate up to keep that leaves every probability at 1 or below."""
    cells = cells.withColumn("ratio", F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(1.0))
    most = cells.where("base > 0").agg(F.max("ratio")).first()[0] or 0.0
    rate = keep if keep * most <= 1 else 1 / most
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("ratio")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _mix_source, _mix_lang, _mix_topic and _mix_tokens."""
    return docs.withColumns({"_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("(none)")), "_mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("(none)")), "_mix_topic": topic_of(F.col("text")), "_mix_tokens": tokens_of(F.col("text"))})


def cell_probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, bounded: bool = False) -> DataFrame:
    """(_mix_source, _mix_lang, _mix_topic, ratio, probability). targets: shares of the values of any dimensions; the others flatten the found shares."""
    spark = rows.sparkSession
    cells = rows.groupBy(*[F.col(f"_mix_{d}").alias(d) for d in DIMS]).agg(F.sum("_mix_tokens").alias("base")).checkpoint()
    aims = {}
    for d in DIMS:
        given = (targets or {}).get(d)
        if given is None:
            aims[d] = default_targets(cells, d, POWERS[d])
        else:
            whole = sum(given.values())
            found = spark.createDataFrame([(k, float(v) / whole) for k, v in given.items()], f"{d} string, target double").join(cells.where("base > 0").select(d).distinct(), d, "left_semi")
            there = found.agg(F.sum("target")).first()[0] or 1.0
            aims[d] = found.withColumn("target", F.col("target") / F.lit(there))
        if bounded:
            aims[d], moved = reachable(cells, d, aims[d], keep)
            if moved > 0:
                warnings.warn(f"{moved:.2%} of the tokens wanted by {d} are not there at a share of {keep} and go to its other values", stacklevel=2)
    # under the bound keep * ratio is a probability
    cells = with_rate(rake(cells, aims, BOUNDED_TOLERANCE if bounded else TOLERANCE, keep if bounded else None), keep)
    return cells.select(*[F.col(d).alias(f"_mix_{d}") for d in DIMS], F.col("ratio").alias("_mix_ratio"), F.col("probability").alias("_mix_probability"))


def _small(cells: DataFrame) -> DataFrame:
    """cells, to be broadcast where their counted number bounds the size; joined by a shuffle beyond it. Either way all cells take part."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: str = SEED, bounded: bool = False) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, ratio, probability, sampled) for every row."""
    shared_dir(docs.sparkSession)
    rows = stored(keyed(docs).select("doc_id", *[f"_mix_{d}" for d in DIMS], "_mix_tokens"))
    cells = cell_probabilities(rows, targets, keep, bounded)
    out = rows.join(_small(cells), [f"_mix_{d}" for d in DIMS])
    return out.select("doc_id", *[F.col(f"_mix_{d}").alias(d) for d in DIMS], F.col("_mix_tokens").alias("tokens"), F.round("_mix_ratio", 6).alias("ratio"), F.round("_mix_probability", 6).alias("probability"), (draw(F.col("doc_id"), seed) < F.col("_mix_probability")).cast("int").alias("sampled"))


def sample_mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: str = SEED, bounded: bool = False) -> DataFrame:
    """The sampled rows of docs; all columns stay as they are."""
    shared_dir(docs.sparkSession)
    rows = keyed(docs)
    cells = cell_probabilities(rows, targets, keep, bounded)
    out = rows.drop("_mix_tokens").join(_small(cells.drop("_mix_ratio")), [f"_mix_{d}" for d in DIMS]).where(draw(F.col("doc_id"), seed) < F.col("_mix_probability"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(table(spark, sf_dir, "documents"))


def mixing_sql(documents: str = "documents") -> str:
    """The same in SQL: sweeps by recursion, as many as are made at most (raking that has converged changes nothing more)."""
    lines = "length(text) - length(replace(text, chr(10), '')) + 1"
    ctes = [f"""rows_ AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
 CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN ({lines}) * 120 > length(text) THEN 'list'
 WHEN length(text) < 600 THEN 'brief' WHEN length(text) >= 6000 THEN 'long' ELSE 'prose' END AS topic,
 CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM {documents})""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS base, CAST(sum(tokens) AS DOUBLE) AS weight FROM rows_ GROUP BY ALL)",
        "total AS (SELECT CAST(sum(base) AS DOUBLE) AS n FROM c0)"]
    for d in DIMS:
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, n / sum(n) OVER () AS target FROM (SELECT {d}, pow(CAST(sum(base) AS DOUBLE), {POWERS[d]}) AS n FROM c0 GROUP BY {d} HAVING sum(base) > 0))")
    aims = ", ".join(f"coalesce({d}_.target, 0) * (SELECT n FROM total) AS aim_{d}" for d in DIMS)
    joins = " ".join(f"LEFT JOIN t_{d} {d}_ ON c0.{d} = {d}_.{d}" for d in DIMS)
    ctes.append(f"aimed AS MATERIALIZED (SELECT c0.source, c0.lang, c0.topic, c0.base, c0.weight, {aims} FROM c0 {joins})")
    step = " ".join(f"WHEN {k} THEN CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN aim_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END" for k, d in enumerate(DIMS))
    ctes.append(f"raked AS (SELECT 0 AS k, * FROM aimed UNION ALL SELECT k + 1, source, lang, topic, base, weight * CASE k % {len(DIMS)} {step} END, {', '.join(f'aim_{d}' for d in DIMS)} FROM raked WHERE k < {len(DIMS) * MOST_SWEEPS})")
    ctes.append(f"r AS MATERIALIZED (SELECT *, CASE WHEN base > 0 THEN weight / base ELSE 1 END AS ratio FROM raked WHERE k = {len(DIMS) * MOST_SWEEPS})")
    ctes.append("most AS (SELECT coalesce(max(ratio), 0) AS m FROM r WHERE base > 0)")
    ctes.append(f"p AS (SELECT *, least(1.0, CASE WHEN {KEEP} * (SELECT m FROM most) <= 1 THEN {KEEP} ELSE 1 / (SELECT m FROM most) END * ratio) AS probability FROM r)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.ratio, 6) AS ratio, round(p.probability, 6) AS probability,
 CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < p.probability AS INTEGER) AS sampled
FROM rows_ d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""  # fmt: skip


OP9_SQL = mixing_sql()
