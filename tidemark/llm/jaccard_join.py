"""N-gram Jaccard self-join by token-combination prefixes.

A text's set is its distinct n-word shingles. Shingles are put in one global order, rare before frequent (by a
count sketch of fixed size over all texts), then by hash. Two sets with a Jaccard similarity of at least t share k tokens
among the first |s| - ceil(t|s|) + k of each (the k-extended prefix, here k = 2). Rare tokens of that prefix are indexed
one by one. If two similar sets share no rare one there, they share two frequent ones: where prefixes are short,
pairs of frequent tokens are indexed, so that a passage that many texts hold doesn't bring them all together; where
prefixes are long the frequent tokens are indexed one by one, by classes of set size. Class boundaries are those of the
larger set, so both sides of a link always index alike. What the sketch calls frequent changes the cost, never the result.

Links are found without listing the pairs of a group. Equal sets are one class from the start. In the first round each
class is compared with the leader of every index entry it is in, the one with the fewest tokens before the entry's (of
edited copies, the one with the fewest edits), and verified links give components. In the second round
only classes of one entry that are still in different components are compared. Before sets are compared, two exact
bounds drop what can be no link: the place of the entry in each side's order bounds what both share, and differing
bucket parities of the two sets bound their symmetric difference. So the components are exact: every pair
that can be a link was verified, or is connected already.

Defined results: texts that are null, empty or without words have an empty set and are linked with nothing; null ids
stay, with no component; repeated rows have one class; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import mix64, row_shingles, shared_dir, small_batches, stored, table
from tidemark.llm.components import components

SKETCH_BITS, CHUNK_BITS = 24, 18
#: Longest extended prefix whose frequent tokens are indexed in pairs.
PAIR_PREFIX = 24
_K = 2
_BITS = tuple(f"s{i}" for i in range(8))


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set (sorted shingle hashes)."""
    with np.errstate(over="ignore"):
        return int(mix64((s * mix64(s)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0].astype(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """512 bits: of each bucket the parity of how many of the set's shingles fall into it."""
    odd = np.bincount((s >> np.uint64(8) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, sid, s0..s7): each row's set size, the key of its class (null for empty sets), and the class's parities."""
    schema = ", ".join(["doc_id long, n_shingles long, sid long", *(f"{c} long" for c in _BITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s) if len(s) else None, parities(s)) for s in row_shingles(batch, n)]
            bits = np.stack([x[2] for x in sets]) if sets else np.zeros((0, 8), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], ["doc_id", "n_shingles", "sid", *_BITS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def frequency_levels(texts: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Per hash bucket the level of its shingles' frequency over all texts: 0 is rare, above it the binary logarithm.

    Each task counts into one array of fixed size; arrays are summed by chunk, as a stream. A bucket is rare if its
    count is what the bulk of single shingles explains: mean + 6 deviations + 4. A task's counts stop at 65,535, and the sums
    at 2**32 - 1: far beyond what is rare, so a hot shingle never looks rare.
    """
    most = np.iinfo(np.uint16).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for s in row_shingles(batch, n):
                at = (s >> np.uint64(64 - bits)).astype(np.int64)  # a set's shingles rarely share a bucket
                counts[at] += counts[at] < most
        counts = counts.reshape(-1, 1 << min(bits, CHUNK_BITS))
        for k in np.flatnonzero(counts.any(1)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": [zlib.compress(counts[k].tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch["chunk"].to_pylist(), batch["counts"]):
                c = np.frombuffer(zlib.decompress(c.as_py()), np.uint16)
                sums[k] = sums.get(k, np.zeros(len(c), np.uint64)) + c
        for k, c in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": [zlib.compress(np.minimum(c, np.iinfo(np.uint32).max).astype(np.uint32).tobytes(), 1)], "total": pa.array([int(c.sum())], pa.int64())})

    summed = texts.select("text").mapInArrow(count, "chunk int, counts binary").repartition(max(1, 1 << max(0, bits - CHUNK_BITS)), "chunk").mapInArrow(add, "chunk int, counts binary, total long")
    rows = summed.collect()  # one array of 2**bits counts, whatever the number of texts
    out = np.zeros(1 << bits, np.uint8)
    mean = sum(r.total for r in rows) / (1 << bits)
    bound = mean + 6 * np.sqrt(mean) + 4
    size = 1 << min(bits, CHUNK_BITS)
    for r in rows:
        c = np.frombuffer(zlib.decompress(r.counts), np.uint32)
        out[r.chunk * size : (r.chunk + 1) * size] = np.where(c > bound, 1 + 2 * np.log2(np.maximum(c, 1)), 0).astype(np.uint8)
    return out


def index_keys(s: np.ndarray, levels: np.ndarray, bits: int, num: int, den: int, pair_prefix: int = PAIR_PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(entries, room) of a set: rare prefix tokens, and frequent ones in pairs or alone, by size class.

    room: the most the set can share with another whose first shared tokens in the global order are those of the entry.
    """
    n = len(s)
    prefix = min(n, n - (num * n + den - 1) // den + _K)
    level = levels[(s >> np.uint64(64 - bits)).astype(np.int64)]
    rare = s[level == 0]
    room = n - np.arange(prefix)
    if len(rare) >= prefix:
        return rare[:prefix], room  # s is sorted by hash
    often = np.flatnonzero(level)
    often = s[often[np.lexsort((s[often], level[often]))][: prefix - len(rare)]]
    late = room[len(rare) :]
    base = np.log(den / num) * 1.001
    b = int(np.log(n) / base)
    out, rooms = [rare], [room[: len(rare)]]
    for label in (b, b + 1):  # the class of the larger set of a pair is this one's or the next
        longest = np.exp((label + 1) * base)
        salt = mix64(np.array([label + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        if (1 - num / den) * longest + _K <= pair_prefix:
            i, j = np.triu_indices(len(often), 1)
            low, high = np.minimum(often[i], often[j]), np.maximum(often[i], often[j])
            out.append(mix64(low * np.uint64(0xE7037ED1A0B428DB) + mix64(high) + salt))
            rooms.append(np.minimum(late[i], late[j] + 1))
        else:
            out.append(mix64(often + salt))
            rooms.append(late)
    return np.concatenate(out), np.concatenate(rooms)


def postings(texts: DataFrame, n: int, num: int, den: int, levels: np.ndarray, bits: int, pair_prefix: int) -> DataFrame:
    """(key, sid, size, room) for every index entry of every class."""
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            sids = np.asarray(batch["sid"])
            keys, rooms, ids, sizes, held = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                counts = [len(k) for k in keys]
                return pa.RecordBatch.from_pydict({"key": np.concatenate(keys).view(np.int64), "sid": np.repeat(np.array(ids, np.int64), counts), "size": np.repeat(np.array(sizes, np.int32), counts), "room": np.concatenate(rooms).astype(np.int32)})

            for sid, s in zip(sids, row_shingles(batch, n)):
                if not len(s) or set_key(s) != sid:  # another text of a repeated id
                    continue
                entries, room = index_keys(s, levels, bits, num, den, pair_prefix)
                keys.append(entries)
                rooms.append(room)
                ids.append(sid)
                sizes.append(len(s))
                held += len(entries)
                if held > 1 << 17:
                    yield flush()
                    keys, rooms, ids, sizes, held = [], [], [], [], 0
            if keys:
                yield flush()

    return texts.mapInArrow(run, "key long, sid long, size int, room int")


def _member_bits(edges: DataFrame, bits: int = 22) -> np.ndarray:
    """A bit array of fixed size that holds the hashes of all ids in the edges."""
    ids = edges.select(F.explode(F.array("a", "b")).alias("sid")).select(F.pmod(F.xxhash64("sid"), F.lit(1 << bits)).alias("h"))
    words = ids.groupBy(F.shiftright("h", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("x"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words.toLocalIterator():
        out[r.w] = r.x
    return out


def verified(edges: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The edges (a, b) whose sets reach the threshold, by comparing whole sets. texts: (sid, text)."""
    bits = 22
    shared = texts.sparkSession.sparkContext.broadcast(_member_bits(edges, bits))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch["h"])
            yield batch.select(["sid", "text"]).filter(pa.array((shared.value[h >> 5] >> (h & 31).astype(np.uint32)) & np.uint32(1) == 1))

    some = texts.select("sid", "text", F.pmod(F.xxhash64("sid"), F.lit(1 << bits)).alias("h")).mapInArrow(needed, "sid long, text string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, b = np.asarray(batch["a"]), np.asarray(batch["b"])
            for at, (x, y) in enumerate(zip(row_shingles(batch, n, "text_a"), row_shingles(batch, n, "text_b"))):
                if set_key(x) != a[at] or set_key(y) != b[at]:
                    continue
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[at] = same * den >= num * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    full = edges.join(some.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    full = full.join(some.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long").distinct()


def _can_link(x: str, y: str, num: int, den: int) -> Column:
    """What a link needs, by sizes, and by what either side can still share after the entry's tokens."""
    a, b = F.col(f"{x}.size").cast("long"), F.col(f"{y}.size").cast("long")
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (F.least(f"{x}.room", f"{y}.room").cast("long") * (num + den) >= (a + b) * num)


def _parity_close(x: str, y: str, num: int, den: int) -> Column:
    """No more odd buckets differ than the sets of a link may differ in: differing parities bound the symmetric difference from below."""
    odd = F.lit(0)
    for c in _BITS:
        odd = odd + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    both = F.col(f"{x}.size").cast("long") + F.col(f"{y}.size").cast("long")
    return odd * (num + den) <= both * (den - num)


def class_components(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int, bits: int = SKETCH_BITS, pair_prefix: int = PAIR_PREFIX) -> DataFrame:
    """(sid, component) of the classes that are linked with another; the component is a class key."""
    shared_dir(docs.sparkSession)
    known = classes.where(F.col("sid").isNotNull())
    first = known.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    signed = stored(known.groupBy("sid").agg(F.max("n_shingles").cast("int").alias("size"), *[F.max(c).alias(c) for c in _BITS]))
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(first.where(F.col("doc_id").isNotNull()), "doc_id").select("sid", "text"))
    levels = frequency_levels(texts, n, bits)
    entry = Window.partitionBy("key")
    found = postings(texts, n, num, den, levels, bits, pair_prefix).withColumn("leader", F.min(F.struct((F.col("size") - F.col("room")).alias("lead"), "sid", "size", "room")).over(entry)).withColumn("low", F.min("sid").over(entry)).withColumn("high", F.max("sid").over(entry))
    found = stored(found.where("low != high").select("key", "sid", "size", "room", "leader"))
    pairs = found.alias("x").where((F.col("sid") != F.col("leader.sid")) & _can_link("x", "leader", num, den)).select(F.least("sid", "leader.sid").alias("a"), F.greatest("sid", "leader.sid").alias("b")).distinct()
    pairs = pairs.join(signed.alias("x"), F.col("a") == F.col("x.sid")).join(signed.alias("y"), (F.col("b") == F.col("y.sid")) & _parity_close("x", "y", num, den)).select("a", "b")
    tried = stored(pairs)
    links = stored(verified(tried, texts, n, num, den))
    first_round = stored(components(links))
    # what one entry holds of different components is compared pair by pair, unless it was
    left = found.join(first_round.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    left = left.withColumn("low", F.min("component").over(entry)).withColumn("high", F.max("component").over(entry)).where("low != high").select("key", "sid", "room", "component")
    left = stored(left.distinct().join(signed, "sid"))
    cross = (F.col("x.key") == F.col("y.key")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component")) & _can_link("x", "y", num, den) & _parity_close("x", "y", num, den)
    rest = left.alias("x").join(left.alias("y"), cross).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(stored(rest), texts, n, num, den)
    return components(links.unionByName(more)).withColumnRenamed("node", "sid")


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bits: int = SKETCH_BITS, pair_prefix: int = PAIR_PREFIX) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the least doc_id that links of similarity num/den or more reach."""
    with small_batches(docs.sparkSession):  # all that takes texts runs in here
        classes = stored(set_classes(docs, n))
        linked = class_components(docs, classes, n, num, den, bits, pair_prefix)
    least = classes.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("low")).join(linked, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    whole = least.groupBy("component").agg(F.min("low").alias("component_id"))
    names = least.join(whole, "component").select("sid", "component_id")
    out = classes.select("doc_id", "n_shingles", "sid").join(names, "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first_of_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group of linked texts: that of the least doc_id. Rows without a set or an id stay.

    Groups are of rows, not of ids: where ids repeat, rows are numbered by id and then by all their columns as JSON, so that
    one of repeated rows stays, and of one id's different texts each is decided by its own links.
    """
    key = F.col("doc_id").cast("long")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy(key.alias("doc_id")).count()
    rows, row = docs, key
    if not ids.where("count > 1").isEmpty():
        ordered = docs.orderBy(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        rows, row = stored(ordered.withColumn("_jj_row", F.when(key.isNotNull(), F.monotonically_increasing_id()))), F.col("_jj_row")
    groups = jaccard_groups(rows.select(row.alias("doc_id"), "text"), n, num, den)
    drop = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_jj_id"))
    return rows.join(drop, row == F.col("_jj_id"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85, 100)


OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
c AS MATERIALIZED (SELECT doc_id, len(sh) AS n, sh FROM s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(sh) AS t FROM c),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_shingles, m.component_id FROM c JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = c.doc_id
"""
