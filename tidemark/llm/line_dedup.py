"""Line dedup by a deletion-neighbourhood join.

Lines are told apart across all texts: a line goes if an equal line stands earlier (by doc_id, then line number), or if
an earlier line is within one edit of it (insertion, deletion or substitution of a character). Two lines are within one
edit exactly if deleting one character at the same place makes them equal, or deleting one from the longer gives the
shorter; so every line emits the hashes of all its deletion variants, equal variants are joined, and the edit distance
is verified. A group of equal variants is linked to its earliest line only: members of one (variant, place) are all
within one edit of each other, so no pair of a group is emitted and none is lost.

Variants are many (one for each character), so lines that can have no partner are sorted out before, without loss: if
two lines are within one edit, they agree outside one of B blocks of equal length. A line emits a key for each block it
may differ in, B = 2 and then 16; only lines that share a key with another line go on.

Defined results: lines end at \\n; blank lines are kept and never compared; lines below `shortest` characters are
compared for equality only. Null and empty texts stay as they are. A line whose earlier partner goes itself goes too.
Rows that repeat id and text count as one row, and share its decisions; null ids come first. Other columns pass through,
but for those named like the three counts that are added; names that start with `_ld_` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import mix64, shared_dir, stored, table, text_blocks

SHORTEST = 20
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
#: Characters that alone make no line.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0]] = True
_SLOTS = 24
_ROW = "_ld_doc long, _ld_text long"


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, n of each at least."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        _POWERS = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (_STEP, _BACK)]
    return _POWERS


class Lines:
    """Lines of a block of texts, as spans of its characters, with polynomial hashes of any part of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: bool = True):
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # a character begins at each byte that isn't a continuation
        self.edges = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets] if len(data) else np.zeros(len(offsets), np.int64)
        self.codes = codes
        forward, self.inverse = _powers(len(codes) + 1)
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * forward[: len(codes)], dtype=np.uint64))
        ends = np.flatnonzero(codes == 10) if split else np.zeros(0, np.int64)
        # a text of k line ends has k + 1 lines
        self.start = np.sort(np.concatenate([self.edges[:-1], ends + 1]), kind="stable")
        self.end = np.sort(np.concatenate([ends, self.edges[1:]]), kind="stable")
        self.row = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(ends, self.edges)))
        self.number = np.arange(len(self.row)) - np.searchsorted(self.row, self.row)
        blank = np.append(0, np.cumsum((codes >= 256) | ~_BLANK[np.minimum(codes, 255)]))
        self.solid = blank[self.end] > blank[self.start]

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters a to b, wherever they stand."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def hashes(self) -> np.ndarray:
        return line_hash(self.part(self.start, self.end), self.end - self.start)

    def keys(self, blocks: int) -> np.ndarray:
        """For each line a key for each block it may differ in, for pairs whose longer line has its length or one more."""
        out = []
        for longer in (self.end - self.start, self.end - self.start + 1):
            for b in range(blocks):
                head, rest = longer * b // blocks, longer - longer * (b + 1) // blocks
                salt = mix64((longer * 64 + b).astype(np.uint64) + np.uint64(blocks << 56))
                head, rest = np.minimum(head, self.end - self.start), np.minimum(rest, self.end - self.start)
                out.append(mix64(self.part(self.start, self.start + head) + mix64(self.part(self.end - rest, self.end) + salt)))
        return np.column_stack(out).view(np.int64)

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def line_hash(part: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix64(part + length.astype(np.uint64)).view(np.int64)


def deletion_variants(line: str) -> tuple[np.ndarray, int]:
    """(the hash of the line without its i-th character, for every i; the line's own), as Lines.hashes() gives them."""
    codes = mix64(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(codes)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(codes * _powers(n + 1)[0][:n], dtype=np.uint64))
    without = sums[:-1] + (sums[n] - sums[1:]) * np.uint64(_BACK)
    return line_hash(without, np.full(n, n - 1)), int(line_hash(sums[n:], np.array([n]))[0])


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a key of each row: id (the least long for null) and text hash."""
    return docs.withColumn("_ld_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_ld_text", F.xxhash64("text"))


def lines_of(docs: DataFrame, shortest: int) -> DataFrame:
    """(_ld_doc, _ld_text, line, h, keys): every line that isn't blank; keys (of two blocks) only of lines that can have near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, offsets in text_blocks(batch, "text", 1 << 20):
                lines = Lines(data, offsets)
                at = np.flatnonzero(lines.solid)
                rows = pa.array(low + lines.row[at])
                long = (lines.end - lines.start)[at] >= shortest
                keys = lines.keys(2)[at[long]]
                spans = np.append(0, np.cumsum(long * keys.shape[1])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["_ld_doc"].take(rows), batch["_ld_text"].take(rows), pa.array(lines.number[at].astype(np.int32)), pa.array(lines.hashes()[at]), pa.ListArray.from_arrays(pa.array(spans), pa.array(keys.ravel()))], ["_ld_doc", "_ld_text", "line", "h", "keys"])

    return _rows(docs).select("_ld_doc", "_ld_text", "text").mapInArrow(run, f"{_ROW}, line int, h long, keys array<long>")


def sharing(keyed: DataFrame) -> DataFrame:
    """(h): of (h, keys) the lines that share a key with another line."""
    entry = Window.partitionBy("key")
    one = keyed.select("h", F.explode("keys").alias("key"))
    return one.withColumn("low", F.min("h").over(entry)).withColumn("high", F.max("h").over(entry)).where("low != high").select("h").distinct()


def texts_of(docs: DataFrame, wanted: DataFrame, shortest: int) -> DataFrame:
    """(h, text) of the wanted lines, each once. A bit array of fixed size keeps most other lines from being emitted; the join is exact."""
    slot = F.col("h").bitwiseAND(F.lit((1 << _SLOTS) - 1))
    words = wanted.select(slot.alias("x")).groupBy(F.expr("cast(x div 32 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 32 as int))")).alias("b"))
    held = np.zeros(1 << (_SLOTS - 5), np.uint32)
    for r in words.toLocalIterator():
        held[r.w] = r.b
    shared = docs.sparkSession.sparkContext.broadcast(held)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch, "text", 1 << 20):
                lines = Lines(data, offsets)
                h = lines.hashes()
                x = h & ((1 << _SLOTS) - 1)
                some = lines.solid & (lines.end - lines.start >= shortest) & ((shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1) == 1)
                at = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array([lines.text(i) for i in at], pa.string())], ["h", "text"])

    every = docs.select("text").mapInArrow(run, "h long, text string")
    return every.groupBy("h").agg(F.min("text").alias("text")).join(wanted, "h", "left_semi")


def near_lines(docs: DataFrame, first: DataFrame, shortest: int) -> DataFrame:
    """(h, kept): lines with an earlier line within one edit, and the earliest such line. first: (h, at, keys)."""
    some = stored(sharing(first.select("h", "keys")))
    texts = stored(texts_of(docs, some, shortest))

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch, "text", 1 << 20):
                keys = Lines(data, offsets, split=False).keys(16)
                yield pa.RecordBatch.from_arrays([batch["h"].slice(low, high - low), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))], ["h", "keys"])

    some = sharing(texts.mapInArrow(finer, "h long, keys array<long>"))
    placed = stored(texts.join(some, "h").join(first.select("h", "at"), "h"))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.append(*deletion_variants(batch["text"][i].as_py()))
                place = np.append(np.arange(len(v) - 1), -1).astype(np.int32)
                h = batch["h"][i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(place), pa.array(np.full(len(v), h))], ["variant", "place", "h"])

    emitted = placed.select("h", "text").mapInArrow(variants, "variant long, place int, h long").distinct()
    emitted = emitted.join(placed.select("h", "at"), "h")
    place, variant = Window.partitionBy("variant", "place"), Window.partitionBy("variant")
    least = F.struct("at", "h")
    # the earliest of a (variant, place); of a variant, the line that is the variant, and the earliest that has it by a deletion
    grouped = emitted.withColumn("same", F.min(least).over(place)).withColumn("whole", F.min(F.when(F.col("place") < 0, least)).over(variant)).withColumn("longer", F.min(F.when(F.col("place") >= 0, least)).over(variant))
    partner = F.explode(F.array(F.when(F.col("place") >= 0, F.col("same")), F.when(F.col("place") >= 0, F.col("whole")), F.when(F.col("place") < 0, F.col("longer")))).alias("p")
    pairs = grouped.select("h", "at", partner).where("p is not null and p.at < at").select("h", F.col("p.h").alias("g"), F.col("p.at").alias("kept")).distinct()
    pairs = pairs.join(placed.select("h", "text"), "h").join(placed.select(F.col("h").alias("g"), F.col("text").alias("other")), "g")

    @F.pandas_udf("boolean")
    def close(a, b):
        import pandas as pd

        return pd.Series([within_one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    return pairs.where(close("text", "other")).groupBy("h").agg(F.min("kept").alias("kept"))


def decisions(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(_ld_doc, _ld_text, line, near, kept): the lines that go; near: for one edit rather than none; kept: the earliest (doc, text, line) within the bound."""
    shared_dir(docs.sparkSession)
    lines = stored(lines_of(docs, shortest))
    at = F.struct("_ld_doc", "line", "_ld_text").alias("at")
    first = stored(lines.groupBy("h").agg(F.min(at).alias("at"), F.first("keys").alias("keys")))
    near = stored(near_lines(docs, first, shortest))
    named = first.select("h", "at").join(near, "h", "left")
    out = lines.drop("keys").join(named, "h")
    here = F.struct("_ld_doc", "line", "_ld_text")
    return out.where(F.col("kept").isNotNull() | (here != F.col("at"))).select("_ld_doc", "_ld_text", "line", F.col("kept").isNotNull().alias("near"), F.coalesce("kept", "at").alias("kept"))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs with `text` reduced to the lines that stay, and the counts lines, dropped_equal and dropped_near."""
    gone = decisions(docs, shortest).groupBy("_ld_doc", "_ld_text").agg(F.collect_set("line").alias("_ld_gone"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("_ld_near"))
    out = _rows(docs).join(gone, ["_ld_doc", "_ld_text"], "left")
    kept = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_ld_gone", i)), "\n"))
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "lines", "dropped_equal", "dropped_near")]
    near = F.coalesce(F.col("_ld_near"), F.lit(0)).cast("int")
    return out.select(*names, kept.alias("text"), total.alias("lines"), (F.coalesce(F.size("_ld_gone"), F.lit(0)) - near).cast("int").alias("dropped_equal"), near.alias("dropped_near"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines", "dropped_equal", "dropped_near", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d),
f AS MATERIALIZED (SELECT line, min(struct_pack(d := doc_id, k := k)) AS pos FROM l WHERE NOT regexp_full_match(line, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}]*') GROUP BY line),
g AS MATERIALIZED (SELECT * FROM f WHERE length(line) >= {SHORTEST}),
v AS MATERIALIZED (SELECT line, pos, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h FROM (SELECT line, pos, unnest(range(1, length(line) + 1)) AS i FROM g)),
w AS MATERIALIZED (SELECT *, hash(line) AS h FROM g),
n AS MATERIALIZED (SELECT a.line FROM v a JOIN v b ON a.h = b.h AND a.i = b.i AND b.pos < a.pos UNION SELECT a.line FROM v a JOIN w b ON a.h = b.h AND b.pos < a.pos UNION SELECT b.line FROM v a JOIN w b ON a.h = b.h AND a.pos < b.pos),
s AS MATERIALIZED (SELECT l.doc_id, l.k, n.line IS NOT NULL AS near, f.line IS NOT NULL AND f.pos <> struct_pack(d := l.doc_id, k := l.k) AS eq FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN n ON n.line = l.line),
r AS (SELECT doc_id, sum(CAST(near AS INTEGER)) AS dn, sum(CAST(eq AND NOT near AS INTEGER)) AS de, list(k) FILTER (near OR eq) AS gone FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS INTEGER) AS lines, CAST(coalesce(de, 0) AS INTEGER) AS dropped_equal, CAST(coalesce(dn, 0) AS INTEGER) AS dropped_near,
 md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END) AS text_md5
FROM d LEFT JOIN r USING (doc_id)
"""
