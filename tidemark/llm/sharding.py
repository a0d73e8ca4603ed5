"""Sharding in Hilbert-curve order.

Source, language and text size (by its logarithm) are quantised to a few bits each, by the share of rows below a value: equi-depth
bins that keep the order, so that each dimension spans the whole range of the curve however few values it has. They are interleaved to a Hilbert index, and the rows are put in the order of the index; runs of equal
length become shards. Rows that are near in all dimensions are near on the curve, so a file's minima and maxima prune
on each of them: write_shards() writes whole rows as files of runs and gives the ranges of each.

Law `rows`: shard counts are at most one apart. Row r of n goes to shard floor(r * shards / n); its slot is its place
there. The order is total: curve index, salt, id, checksum, size. Counts by (cell, salt) are pre-aggregated and summed
along the curve; ranks within a (cell, salt) come from a window. The salt is a hash of id, checksum and size and splits a cell
into runs of about 100 rows (more only beyond 6.5 million rows, so that runs stay countable), so that no cell lands in one task, nor
all rows of a null or repeated id with different texts; only rows equal in all three share a run.

Defined results: a null source or language is quantised below all others; a null text has 16 bytes, no checksum and size
class 0; a null id sorts first. Repeated rows get slots of their own. Other columns are ignored, whatever their names, unless
`carry` is set: then all columns of the row stand in one struct column `row`. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

SHARDS, BITS = 40, 6
#: Rows of a (cell, salt): no fewer than the first, no more of them than the second on top of the cells.
RUN_ROWS, RUNS = 100, 1 << 16
#: Distinct values of a dimension that one task sums up in order.
RANGE_VALUES = 100_000


def hilbert_index(dims: list, bits: int):
    """Index on the Hilbert curve of integer coordinates below 2**bits (numpy arrays), after Skilling's transform."""
    x = [d.astype("int64").copy() for d in dims]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = x[0] ^ (high * p) ^ (~high * swap)
            x[i] = x[i] ^ (~high * swap)
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = x[0] * 0, 1 << (bits - 1)
    while q > 1:
        t = t ^ (((x[n - 1] & q) != 0) * (q - 1))
        q >>= 1
    out = t * 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def boundaries(counts: DataFrame, col: str, bits: int, range_values: int = RANGE_VALUES) -> list[tuple]:
    """(value, bin) of the least value of each bin, in order: bin b, from 1 to 2**bits - 1, begins where b / 2**bits of the rows of `counts` (col, count) lie below.

    Distinct values are dealt by ranges over tasks and summed in each; what lies before a range comes from the totals of the
    ranges, of which there is one for each range_values distinct values. Only those and the boundaries reach the driver.
    """
    counts = stored(counts)
    distinct, total = counts.agg(F.count("*"), F.sum("count")).first()
    if not total:
        return []
    known = counts.where(F.col(col).isNotNull()).repartitionByRange(-(-distinct // range_values), col)
    known = stored(known.withColumn("part", F.spark_partition_id()))
    sums = sorted((r.part, r.s) for r in known.groupBy("part").agg(F.sum("count").alias("s")).collect())
    if not sums:
        return []
    before = dict(zip([p for p, _ in sums], accumulate((s for _, s in sums), initial=total - sum(s for _, s in sums))))  # nulls come first
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[F.col("part").cast("long")]
    summed = Window.partitionBy("part").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = known.withColumn("before", F.sum("count").over(summed) - F.col("count") + offset)
    cell = cell.withColumn("bin", F.greatest(F.lit(1), F.expr(f"before * {1 << bits} div {total}").cast("int"))).groupBy("bin").agg(F.min(col).alias("low"))
    return sorted((r.low, r.bin) for r in cell.select("low", "bin").collect())


def _bin(value: Column, bounds: list[tuple]) -> Column:
    """The bin of a value; 0 for null."""
    if not bounds:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(b) for b, _ in bounds]), lambda b: b <= value))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.element_at(F.array(F.lit(0), *[F.lit(k) for _, k in bounds]), below + 1))


def shard_by_curve(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("source", "lang"), bits: int = BITS, target_rows: int | None = None, carry: bool = False) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row, and with `carry` its columns as struct `row`."""

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    level = F.when(text.isNotNull(), F.floor(F.log2(size.cast("double")) * 16).cast("int"))
    values = [*[F.col(d).cast("string") for d in dims], level]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    kept = [c for c in ("row",) if carry]
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[v.alias(f"value_{i}") for i, v in enumerate(values)], *whole)
    rows = stored(rows)
    places = [f"dim_{i}" for i in range(len(values))]
    for i, p in enumerate(places):
        rows = rows.withColumn(p, _bin(F.col(f"value_{i}"), boundaries(rows.groupBy(f"value_{i}").count(), f"value_{i}", bits)))
    total = rows.count()
    target_rows = target_rows or max(RUN_ROWS, -(-total // RUNS))
    cells = rows.groupBy(*places).count()
    cells = cells.withColumn("curve", curve(*places)).withColumn("parts", F.ceil(F.col("count") / target_rows).cast("int"))
    keyed = rows.join(F.broadcast(cells.drop("count")), places)  # at most 2 ** (3 * bits) rows
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.col("parts")).cast("int"))
    keyed = keyed.select(id_col, "size", "text_crc32", "curve", "salt", *kept)
    along = Window.orderBy("curve", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = keyed.groupBy("curve", "salt").count().withColumn("start", F.sum("count").over(along) - F.col("count")).drop("count")
    inside = Window.partitionBy("curve", "salt").orderBy(id_col, "text_crc32", "size")
    ranked = keyed.join(F.broadcast(starts), ["curve", "salt"])  # as many as cells, and RUNS more
    ranked = ranked.withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("shard", F.floor(F.col("rank") * shards / F.lit(total)).cast("int")) if total == 0 else ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {total} as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *kept)


def write_shards(docs: DataFrame, path: str, files: int = 400, **options) -> DataFrame:
    """Writes whole rows to path/shard=N in the order of their slots, and gives the ranges of each file for pruning.

    Each file is a run of about 1/files of all rows along the curve. Returns (file, shard, rows, and least and greatest source,
    lang and size) of every file; by these, or by the Parquet statistics of the same columns, readers skip files.
    """
    dims = options.get("dims", ("source", "lang"))
    sharded = shard_by_curve(docs, carry=True, **options).select("row", "shard", "slot", "size")
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), "shard", "size", *[F.col(f"row.{d}").alias(f"dim_{d}") for d in dims])
    ranges = [f(c).alias(f"{n}_{c.removeprefix('dim_')}") for c in (*[f"dim_{d}" for d in dims], "size") for n, f in (("least", F.min), ("greatest", F.max))]
    return written.groupBy("file", "shard").agg(F.count("*").alias("rows"), *ranges)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_curve(table(spark, sf_dir, "documents"))
