"""Helpers that the operators of this subpackage share: tables, shared-folder materialisation and text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the folder may live in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For the jobs run inside, Arrow batches of at most `rows` rows: each holds its texts in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_frame(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, bytes_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of a bounded sample of labelled rows, and the number of learnable labels of each class.

    At most rows_per_class ids of each class, the first by a hash of the id, never of the held-out fold; repeated labels
    of an id count as their maximum, null and other labels not at all. Texts are whole; one above bytes_per_class is left out.
    """
    ys = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    ys = ys.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in ys.groupBy("y").count().collect()}
    picked = [ys.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * rows_per_class rows
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return rows.where(F.octet_length("text") <= bytes_per_class), counts


def within(rows: Iterable[tuple[str, int]], bytes_per_class: int) -> Iterator[tuple[str, int]]:
    """The (text, class) rows, in their order, that keep what was taken of their class within bytes_per_class."""
    room = {0: bytes_per_class, 1: bytes_per_class}
    for text, y in rows:
        size = len(text.encode())
        if size <= room[y]:
            room[y] -= size
            yield text, y


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, bytes_per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The rows of training_frame in the order of the hash, on the driver, as far as they stay within bytes_per_class, and the counts.

    Both bounds are documented parameters of the fit. Scoring, and everything else, takes all rows and whole texts.
    """
    rows, counts = training_frame(docs, labels, label, rows_per_class, bytes_per_class)
    found = ((r.text, r.y) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toLocalIterator())
    return list(within(found, bytes_per_class)), counts


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias of a ridge logistic regression of y on the columns of z, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-9 * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- text kernels (numpy on Arrow buffers)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch in row blocks of about `limit` text bytes: (first row, end row, bytes, offsets in those bytes). Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER_BYTE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_STEP = np.uint64(0xA0761D6478BD642F)
_POWERS = np.cumprod(np.full(256, _STEP, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << int(n - 1).bit_length(), _STEP, np.uint64))
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside \\x20 \\x09-\\x0D: (starts, ends, first word of each row and the total), never across rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    span = np.diff(starts, append=len(data))
    longest = int((ends - starts).max())
    place = np.arange(starts[0], len(data)) - np.repeat(starts, span)
    np.minimum(place, longest, out=place)
    values = _LOWER_BYTE[data[starts[0] :]] * _powers(longest + 1)[place]
    return mix64(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence as one; none without words."""
    total = len(hashes)
    salt = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
    rolled = np.zeros(max(0, total - n + 1), np.uint64)
    for j in range(n):
        rolled += hashes[j : j + len(rolled)] * salt[j]
    rolled = mix64(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix64((hashes[a:b] * salt[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def row_shingles(batch: pa.RecordBatch, n: int, column: str = "text") -> Iterator[np.ndarray]:
    """shingles() of every row of a batch, in blocks of 512 KB of text: hashing takes some thirty bytes for each."""
    for _, _, data, offsets in text_blocks(batch, column, 1 << 19):
        starts, ends, first = words(data, offsets)
        yield from shingles(word_hashes(data, starts, ends), first, n)
