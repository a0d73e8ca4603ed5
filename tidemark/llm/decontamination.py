"""Benchmark decontamination by q-gram lemma filtering.

If a passage of m bytes occurs in a text with at most e edits, they share at least m + 1 - q(e + 1) q-grams, on diagonals
(place in the text minus place in the passage) no more than e apart. So every q-gram of a text is looked up among the
passages' q-grams; hits are counted by passage in overlapping bands of 2w diagonals (w > e, a new band every w), and
only bands that reach the bound are verified, by banded alignment of the whole passage. The filter loses nothing.

Both sides are compared with A-Z lower-cased and runs of white space as one space. The edit budget is a share of the
passage's length, lowered for short passages until the bound is positive; passages below q bytes are looked for exactly.

Defined results: null and empty texts and passages match nothing; a null id of either side stays null in the result.
Repeated rows are each reported. Texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, _SPACE, table, text_blocks

Q, EDIT_SHARE = 8, 0.1
#: Passage bytes that are held by a task at once; a larger benchmark is taken block by block.
BLOCK_BYTES = 8 << 20


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with runs of white space as one space: (bytes, offsets, place of each byte before)."""
    if not len(data):
        return data, offsets, np.zeros(0, np.int64)
    blank = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = ~blank
    keep[1:] |= blank[1:] & (~blank[:-1] | edge[1:-1])
    keep[0] = True
    at = np.flatnonzero(keep)
    return np.where(blank[at], np.uint8(32), _LOWER[data[at]]), np.searchsorted(at, offsets), at


def qgrams(b: np.ndarray) -> np.ndarray:
    """All 8-byte grams as integers."""
    if len(b) < Q:
        return np.zeros(0, np.uint64)
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def banded_distance(passage: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the whole passage in text, or None above the budget.

    Row by row over the passage; within a row all end places at once, gaps by a running minimum. Rows stop as soon as no
    cell is within the budget. text is already cut to the band, so that the table is as wide as the band and the passage.
    """
    n = len(text)
    place = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    start = place.copy()
    for j, c in enumerate(passage):
        low, high = max(0, j + 1 - budget), n + 1
        step = np.empty(n + 1, np.int64)
        step[0] = j + 1
        step[1:] = np.minimum(cost[:-1] + (text != c), cost[1:] + 1)
        origin = start.copy()
        origin[1:] = np.where(cost[:-1] + (text != c) <= cost[1:] + 1, start[:-1], start[1:])
        shifted = (step - place) * (n + 2) + place  # the smallest cost, and of equals the nearest
        best = np.minimum.accumulate(shifted)
        source = best % (n + 2)
        cost = step[source] + place - source
        start = origin[source]
        if cost[low:high].min(initial=budget + 1) > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


class Passages:
    """The q-gram index of a bounded block of passages."""

    def __init__(self, rows: list[tuple[int | None, str | None]], share: float = EDIT_SHARE):
        self.items, self.texts, self.short = [], [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b = normal(raw, np.array([0, len(raw)]))[0]
            b = np.frombuffer(b.tobytes().strip(b" "), np.uint8)
            if len(b):
                (self.short if len(b) < Q else self.items).append(item)
                if len(b) >= Q:
                    self.texts.append(b)
                else:
                    self.short[-1] = (item, b.tobytes())
        m = np.array([len(b) for b in self.texts], np.int64)
        self.budget = np.minimum(np.floor(m * share), m // Q - 1).astype(np.int64).clip(0) if len(m) else m
        self.least = m + 1 - Q * (self.budget + 1)
        self.band = np.maximum(self.budget + 1, 16)
        grams = [qgrams(b) for b in self.texts]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.end = np.append(self.first[1:], len(keys))
        self.shift = np.uint64(64 - max(16, min(24, int(len(self.keys)).bit_length() + 6)))
        self.seen = np.zeros(1 << int(64 - self.shift), bool)
        self.seen[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int | None, int, int, int]]:
        """(row, item, start, end, edits) of every occurrence within its budget; start and end are byte places in the row's text."""
        text, at, source = normal(data, offsets)
        for item, b in self.short:
            for row in range(len(at) - 1):
                t = text[at[row] : at[row + 1]].tobytes()
                p = t.find(b)
                while p >= 0:
                    yield row, item, int(source[at[row] + p] - offsets[row]), int(source[at[row] + p + len(b) - 1] + 1 - offsets[row]), 0
                    p = t.find(b, p + 1)
        grams = qgrams(text)
        if not len(grams) or not len(self.keys):
            return
        hits = np.flatnonzero(self.seen[self._slot(grams)])
        index = np.minimum(np.searchsorted(self.keys, grams[hits]), len(self.keys) - 1)
        same = self.keys[index] == grams[hits]
        hits, index = hits[same], index[same]
        row = np.searchsorted(at, hits, "right") - 1
        inside = hits + Q <= at[row + 1]
        hits, index, row = hits[inside], index[inside], row[inside]
        several = self.end[index] - self.first[index]
        posting = np.repeat(self.first[index], several) + np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
        hits, row, owner = np.repeat(hits, several), np.repeat(row, several), self.owner[posting]
        band = (hits - at[row] - self.place[posting]) // self.band[owner]
        spread = int(len(text)) + 2 * int(max(map(len, self.texts))) + 64  # beyond any band's number
        key = (row * len(self.texts) + owner) * (2 * spread) + band + spread
        keys, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        owner = keys // (2 * spread) % len(self.texts)
        full = count >= self.least[owner]
        seen: set[tuple[int, int, int]] = set()
        for k in keys[full]:
            band, pair = int(k % (2 * spread)) - spread, int(k // (2 * spread))
            row, i = divmod(pair, len(self.texts))
            w, e, p = int(self.band[i]), int(self.budget[i]), self.texts[i]
            low = max(0, band * w - e)
            high = min(int(at[row + 1] - at[row]), (band + 2) * w + len(p) + e)
            t = text[at[row] + low : at[row] + high]
            exact = t.tobytes().find(p.tobytes())
            found = (0, exact, exact + len(p)) if exact >= 0 else banded_distance(p, t, e)
            if found is None or found[2] <= found[1]:
                continue
            start, end = int(source[at[row] + low + found[1]] - offsets[row]), int(source[at[row] + low + found[2] - 1] + 1 - offsets[row])
            if (row, i, start) not in seen:
                seen.add((row, i, start))
                yield row, self.items[i], start, end, found[0]


def passage_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Passages]:
    """The benchmark's passages in blocks of bounded size: one for most benchmarks."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield Passages([(r.item_id, r.text) for r in part.collect()])


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): where passages stand in the texts, in UTF-8 bytes."""
    out = None
    for passages in passage_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for low, _, data, offsets in text_blocks(batch, "text"):
                    found = list(shared.value.search(data, offsets))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([low + f[0] for f in found], pa.int64())), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32())))], ["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in whose text a passage stands; all columns stay as they are."""
    at = docs.columns.index("text")
    schema = docs.schema
    for passages in passage_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                for low, _, data, offsets in text_blocks(texts, "text"):
                    keep[[low + f[0] for f in shared.value.search(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
