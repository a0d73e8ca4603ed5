"""Exact top-k search by an impact-ordered, score-at-a-time index.

Every row's quantised components become postings. A block of rows keeps them in segments by impact, the bit length of
the absolute value, the largest first. A search takes the segments of a block score by score for a block of queries,
adds their products to accumulators and, after each impact level, bounds what the rest can still add by the
Cauchy-Schwarz inequality over the components not yet read. It stops only when that bound proves that all rows but the
possible members are below the query's k-th best score; possible members are rescored exactly in integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part. Shorter vectors are padded
with zeros; an empty vector scores 0 with every other. Rows with a null id take no part. Candidates of a query are all
rows whose id isn't its own; rows that repeat both id and vector count once, as one row. Ties go to the smaller id.
Other columns are ignored, whatever their names. Empty tables give empty results. Where products may exceed 64 bits, scores are
taken in unbounded integers; a score among the best that fits no long raises an error instead of wrapping.
Every row is indexed, so recall is 1 by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Rows of a posting block and queries of a query block; both bound a task's memory, neither bounds the result.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Queries whose accumulators a task holds at once, and query blocks of a group.
STEP_QUERIES, GROUP_BLOCKS = 256, 16
_BYTES = ("ids", "levels", "slots", "dims", "impacts", "rest")
_BLOCK = ", ".join(["dim int", *(f"{c} binary" for c in _BYTES)])


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v array<long>): floor(scale * component), of the vectors that take part; repeated rows once."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.col(vec_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    out = df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))
    return out.distinct()


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of an array<long> column as a matrix, padded with zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(column.flatten(), np.int64)
    if not len(sizes):
        return np.zeros((0, 0), np.int64)
    if sizes.min() == sizes.max():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max()), np.int64)
    out[np.arange(sizes.max()) < sizes[:, None]] = values
    return out


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, rows - count)
            held.append(take)
            count += take.num_rows
            batch = batch.slice(take.num_rows)
            if count == rows:
                t = pa.Table.from_batches(held).combine_chunks()
                yield np.asarray(t["id"].chunk(0), np.int64), _matrix(t["v"].chunk(0))
                held, count = [], 0
    if count:
        t = pa.Table.from_batches(held).combine_chunks()
        yield np.asarray(t["id"].chunk(0), np.int64), _matrix(t["v"].chunk(0))


def impact_level(v: np.ndarray) -> np.ndarray:
    """The quantised impact of components: the bit length of their absolute value (0 for 0)."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int8)


def segments(ids: np.ndarray, m: np.ndarray) -> dict:
    """A block's postings, by descending impact level and then dimension, and the norm that is left after each level."""
    level = impact_level(m)
    present = np.unique(level[level > 0])[::-1]
    slots, dims = np.nonzero(level)
    order = np.lexsort((dims, -level[slots, dims]))
    slots, dims = slots[order], dims[order]
    squares = m.astype(np.float64) ** 2
    rest = np.stack([np.sqrt(np.where(level < x, squares, 0).sum(1)) for x in present]) if len(present) else np.zeros((0, len(m)))
    bounds = np.array([(level >= x).sum() for x in present], np.int64)
    return {"ids": ids.tobytes(), "dim": m.shape[1], "levels": bounds.tobytes(), "slots": slots.astype(np.int32).tobytes(), "dims": dims.astype(np.int32).tobytes(), "impacts": m[slots, dims].astype(np.int64).tobytes(), "rest": rest.tobytes()}


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of postings; every row of `vectors` (from quantised()) is in one block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _chunks(batches, block_rows):
            yield pa.RecordBatch.from_pylist([segments(ids, m)], schema=pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in _BYTES)]))

    return vectors.mapInArrow(build, _BLOCK)


def query_blocks(vectors: DataFrame, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(q_ids, q_dim, q_exact): the queries in blocks of bounded size."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _chunks(batches, block_queries):
            yield pa.RecordBatch.from_pydict({"q_ids": [ids.tobytes()], "q_dim": pa.array([m.shape[1]], pa.int32()), "q_exact": [m.tobytes()]})

    return vectors.mapInArrow(build, "q_ids binary, q_dim int, q_exact binary")


def block_search(q_ids: np.ndarray, q: np.ndarray, block: dict, k: int, floor: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of every possible member of a query's top k in the block, scores exact.

    floor: by query id, a score that k rows other than the query already reach; it is raised on the way.
    """
    ids = np.frombuffer(block["ids"], np.int64)
    dim = max(q.shape[1], block["dim"])
    if q.shape[1] < dim:
        q = np.pad(q, ((0, 0), (0, dim - q.shape[1])))
    levels, rest = np.frombuffer(block["levels"], np.int64), np.frombuffer(block["rest"], np.float64).reshape(-1, len(ids))
    slots, dims, impacts = (np.frombuffer(block[c], t) for c, t in (("slots", np.int32), ("dims", np.int32), ("impacts", np.int64)))
    wide = np.zeros((len(ids), dim), np.int64)
    wide[slots, dims] = impacts  # the block's rows, exactly
    qf = q.astype(np.float64)
    norms = np.sqrt((qf**2).sum(1))
    own = q_ids[:, None] == ids[None, :] if len(np.intersect1d(q_ids, ids)) else None
    acc = np.zeros((len(q), len(ids)))
    best = np.array([floor.get(int(i), -(1 << 62)) for i in q_ids], np.float64) if floor is not None else np.full(len(q), -float(1 << 62))
    # what rounding in the accumulators can amount to, also where large products cancel
    rounding = (dim + 16) * np.finfo(np.float64).eps * norms[:, None] * np.sqrt((wide.astype(np.float64) ** 2).sum(1))[None, :]
    at, possible = 0, None
    for level, end in enumerate(levels):
        segment = np.zeros((len(ids), dim))
        segment[slots[at:end], dims[at:end]] = impacts[at:end]
        acc += qf @ segment.T
        at = end
        left = norms[:, None] * rest[level][None, :]
        left += 1e-9 * (1 + left + np.abs(acc)) + rounding
        if level < len(levels) - 1 and left.max() > 0.2 * norms.max() * (rest[0].max() + 1):
            continue
        lower, upper = acc - left, acc + left
        if own is not None:
            lower[own] = upper[own] = -np.inf
        if lower.shape[1] > k:
            best = np.maximum(best, np.partition(lower, -k, axis=1)[:, -k])
        possible = upper >= best[:, None]
        if own is not None:
            possible &= ~own
        if possible.sum() <= 16 * k * len(q):  # the rest is proven to be below: rescoring is cheaper than further segments
            break
    if possible is None:  # all components are 0
        possible = np.ones(acc.shape, bool) if own is None else ~own
    row, col = np.nonzero(possible)
    scores = np.empty(len(row), np.int64)
    # by the Cauchy-Schwarz inequality no sum, nor part of one, leaves 64 bits
    narrow = norms.max(initial=0) * np.sqrt((wide.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**62
    if not narrow:
        scores = np.array([sum(x * y for x, y in zip(q[r].tolist(), wide[c].tolist())) for r, c in zip(row, col)], object)
    for a in range(0, len(row) if narrow else 0, 1 << 16):
        scores[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[row[a : a + (1 << 16)]], wide[col[a : a + (1 << 16)]])
    order = np.lexsort((ids[col], -scores, row))
    row, col, scores = row[order], col[order], scores[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    if not narrow:
        if any(abs(x) >> 63 for x in scores[keep]):
            raise OverflowError("a score does not fit a long: scale the vectors down")
        keep_scores = scores[keep].astype(np.int64)
        return row[keep], ids[col[keep]], keep_scores
    if floor is not None:
        for r, s in zip(row[place == k - 1], scores[place == k - 1]):
            floor[int(q_ids[r])] = max(int(s), floor.get(int(q_ids[r]), -(1 << 62)))
    return row[keep], ids[col[keep]], scores[keep]


def search(index: DataFrame, queries: DataFrame, k: int = 5, shards: int = 64, groups: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for every query, exactly.

    Posting blocks are dealt over shards and query blocks over groups; each group meets each shard in a cell of its own,
    by a cogroup, which is never broadcast. A task holds one cell, so top_k() lets both numbers grow with the rows.
    Ranks come from the blocks' winners alone.
    """

    def cells(df: DataFrame, own: str, key: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    blocks = cells(index, "shard", "ids", shards, "group", groups)
    asked = cells(queries, "group", "q_ids", groups, "shard", shards)

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        floors: dict[int, int] = {}
        out = []
        for r in range(postings.num_rows):
            block = {c: postings[c][r].as_py() for c in ("dim", *_BYTES)}
            for s in range(asked.num_rows):
                ids = np.frombuffer(asked["q_ids"][s].as_py(), np.int64)
                q = np.frombuffer(asked["q_exact"][s].as_py(), np.int64).reshape(len(ids), -1)
                for a in range(0, len(ids), STEP_QUERIES):
                    at, found, scores = block_search(ids[a : a + STEP_QUERIES], q[a : a + STEP_QUERIES], block, k, floors)
                    out.append((ids[a + at], found, scores))
        columns = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    found = blocks.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    vectors = quantised(df, id_col, vec_col)
    asked = quantised(df.where(is_query), id_col, vec_col)
    blocks = -(-asked.count() // BLOCK_QUERIES)
    shards = max(64, -(-df.count() // BLOCK_ROWS))
    return search(build_index(vectors), query_blocks(asked.coalesce(max(1, blocks))), k, shards, max(1, -(-blocks // GROUP_BLOCKS)))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
