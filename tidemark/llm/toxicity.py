"""Toxicity by compression distance.

zstandard dictionaries are trained separately on ordinary and on toxic text. A text is cut in windows of about 32 bytes
at word starts; each window is compressed once with the ordinary dictionary and once with the ordinary and the toxic
one together, and the difference of the two lengths says how much toxic text explains of it that ordinary text
does not. Differences become log-likelihood ratios; their sum over a text, calibrated on labelled texts that had no
part in the dictionaries, gives its log odds. This is done with two pairs of dictionaries, each trained on two of three
folds and calibrated on the third; the score is the probability of the mean log odds.

What each trainer sees: of ordinary texts windows as they are; of toxic texts the stretches made of byte 6-grams that
are surely more frequent in toxic than in ordinary texts (the log odds exceed a bound by two standard errors). Without that,
common syllables crowd out what is toxic, and the distance tells little. Grams are counted by the distinct contexts
they stand in: what copies of one text repeat counts once, however many there are.

What makes the lengths comparable on so short windows: a primer that both sides hold stands before each window,
so that the frame is always compressible and a single further match shows; windows overlap by a few bytes, since
zstandard looks for no match in the last bytes of a frame; matches are of 6 bytes or more.

Defined results: null and empty texts have no window and get the score of no evidence, like any text without a
difference; null ids stay, and are not held out; repeated rows are scored each. Labels of the held-out fold are never
read by the fit, which reads its rows whole. Without labels of both classes every score is the share of label 1 (0
without labels). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _LOWER, _SPACE, held_out, mix64, platt, table, text_blocks, training_frame, within

#: The fit's bounds: labelled rows of each class, and bytes of their whole texts.
ROWS_PER_CLASS, BYTES_PER_CLASS = 2500, 16 << 20
WINDOW, OVERLAP = 32, 12
#: Bytes of the two dictionaries, and ordinary windows that the trainer sees at most (evenly spaced among all).
ORDINARY_SIZE, TOXIC_SIZE, TRAINER_WINDOWS = 2048, 2048, 40_000
#: A gram leans to toxic text when its log odds exceed ODDS by DEVIATIONS standard errors, in LEAST contexts or more.
GRAM, ODDS, DEVIATIONS, LEAST, FOLDS = 6, 1.5, 2.0, 4, 3
THRESHOLD = 0.3
_GRAM_BITS, _SEEN_BITS = 22, 27
_TOP = 16
#: Windows that are laid out and compressed at once.
_BLOCK = 1 << 12
_PRIMER = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)
_PAD = b"\n" * 16


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the windows: they begin with the space before a word and run into the next one."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    place = (starts - offsets[row]) // WINDOW
    keep = np.ones(len(starts), bool)
    keep[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    starts, row = starts[keep], row[keep]
    ends = np.minimum(np.append(starts[1:], n) + OVERLAP, offsets[row + 1])
    # what lies between two starts in one long word stays in one window; none is cut
    return np.maximum(starts - 1, offsets[row]), ends, row


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def lengths(compressor: zstandard.ZstdCompressor, buffer: bytes, segments: bytes) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, segments), threads=1)
    return np.fromiter(map(len, out), np.int64, len(out))


def differences(pairs: list[tuple], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of each pair of compressors the bytes that the toxic side saves over the ordinary one, for each window."""
    p = len(_PRIMER)
    tail = 12  # spaces after the window, for the same reason as the overlap
    size = ends - starts + p + tail
    at = np.append(0, np.cumsum(size))
    place = np.arange(at[-1], dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), size)
    source = np.repeat((starts - p).astype(np.int32), size) + place
    last = np.repeat(ends.astype(np.int32), size)
    buffer = np.where(place < p, _PRIMER[np.minimum(place, p - 1)], np.where(source < last, data[np.clip(source, 0, len(data) - 1)], 32)).astype(np.uint8).tobytes()
    segments = np.column_stack([at[:-1], size]).astype(np.uint64).tobytes()
    return [lengths(ordinary, buffer, segments) - lengths(toxic, buffer, segments) for ordinary, toxic in pairs]


def histograms(data: np.ndarray, offsets: np.ndarray, pairs: list[tuple]) -> np.ndarray:
    """(pair, row, difference): the number of a row's windows by difference, -_TOP to _TOP (beyond them counts as the last). data: lower-cased bytes."""
    starts, ends, row = windows(data, offsets)
    out = np.zeros((len(pairs), len(offsets) - 1, 2 * _TOP + 1))
    for a in range(0, len(starts), _BLOCK):
        cut = slice(a, a + _BLOCK)
        low, high = starts[cut].min(), ends[cut].max()
        for k, d in enumerate(differences(pairs, data[low:high], starts[cut] - low, ends[cut] - low)):
            np.add.at(out[k], (row[cut], np.clip(d, -_TOP, _TOP) + _TOP), 1)
    return out


def features(hist: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Of each row: its summed evidence (signed logarithm, and by the root of the number of windows), log number of windows, and the evidence for toxic text alone (logarithm, and mean)."""
    n = np.maximum(hist.sum(1), 1)
    total, toxic = hist @ evidence, hist @ np.maximum(evidence, 0)
    return np.column_stack([np.sign(total) * np.log1p(np.abs(total)), total / np.sqrt(n), np.log1p(hist.sum(1)), np.log1p(toxic), toxic / n])


@dataclass
class Model:
    """Of each pair the contents of both dictionaries, the evidence of a difference and the weights of the calibration; a few KB."""

    pairs: list[tuple[bytes, bytes]]
    evidence: list[np.ndarray]
    weights: list[np.ndarray]
    prior: float

    def compressors(self) -> list[tuple]:
        """(ordinary side, toxic side) of each pair: the toxic part stands before what both hold, so that this lies at the same distance on both sides."""
        both = [(o + _PRIMER.tobytes() + _PAD, t) for o, t in self.pairs]
        return [(_compressor(o), _compressor(t + o)) for o, t in both]

    def score(self, data: np.ndarray, offsets: np.ndarray, compressors: list[tuple]) -> np.ndarray:
        if not self.weights:
            return np.full(len(offsets) - 1, self.prior)
        margin = 0.0
        for hist, evidence, w in zip(histograms(_LOWER[data], offsets, compressors), self.evidence, self.weights):
            x = features(hist, evidence)
            margin = margin + np.column_stack([x, np.ones(len(x))]) @ w
        return 1 / (1 + np.exp(-np.clip(margin / len(self.weights), -35, 35)))


def joined(texts: list[np.ndarray], limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """The texts in blocks of about `limit` bytes, a zero byte after each."""
    held, size = [], 0
    for t in texts:
        held += [t, np.zeros(1, np.uint8)]
        size += len(t) + 1
        if size >= limit:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def gram_buckets(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each place's gram, whether it lies in one text) of a block."""
    n = max(0, len(block) - GRAM + 1)
    x = block.astype(np.uint64)
    g = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    for j in range(GRAM):
        g = g << np.uint64(8) | x[j : j + n]
        inside &= block[j : j + n] > 0
    return mix64(g), inside


def gram_contexts(texts: list[np.ndarray]) -> np.ndarray:
    """Per hash bucket the number of distinct contexts (the next six bytes) of its grams, by a bitmap of fixed size; 65,535 stands for all above."""
    counts = np.zeros(1 << _GRAM_BITS, np.uint16)
    seen = np.zeros(1 << (_SEEN_BITS - 3), np.uint8)
    for block in joined(texts):
        h, inside = gram_buckets(block)
        after = np.zeros(len(h), np.uint64)
        after[: max(0, len(h) - GRAM)] = h[GRAM:]
        h, after = h[inside], after[inside]
        context, first = np.unique(mix64(h + after * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN_BITS), return_index=True)
        at, bit = (context >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (context & np.uint64(7)).astype(np.uint8))
        new = seen[at] & bit == 0
        if not new.any():
            continue
        at, bit = at[new], bit[new]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        seen[at[start]] |= np.bitwise_or.reduceat(bit, start)
        bucket, n = np.unique((h[first[new]] >> np.uint64(64 - _GRAM_BITS)).astype(np.int64), return_counts=True)
        counts[bucket] = np.minimum(counts[bucket] + n, 65535).astype(np.uint16)
    return counts


def leaning(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """Which buckets surely are more frequent in toxic text. Both sides are lists of counts to be summed."""
    totals = [1.0 + sum(int(c.sum(dtype=np.int64)) for c in side) for side in (toxic, ordinary)]
    out = np.zeros(len(toxic[0]), bool)
    for at in range(0, len(out), 1 << 18):
        a, b = (sum(c[at : at + (1 << 18)].astype(np.float32) for c in side) + np.float32(0.5) for side in (toxic, ordinary))
        odds = np.log(a / totals[0]) - np.log(b / totals[1])
        out[at : at + (1 << 18)] = (a > LEAST) & (odds - DEVIATIONS * np.sqrt(1 / a + 1 / b) > ODDS)
    return out


def leaning_stretches(texts: list[np.ndarray], lean: np.ndarray) -> list[bytes]:
    """The maximal byte runs that leaning grams cover."""
    out = []
    for block in joined(texts):
        h, inside = gram_buckets(block)
        at = np.flatnonzero(lean[(h >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)] & inside)
        if not len(at):
            continue
        cover = np.zeros(len(block) + 1, np.int32)
        cover[at] += 1
        cover[at + GRAM] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]]).astype(np.int8)))
        raw = block.tobytes()
        out += [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard's trainer makes of the samples; their own bytes where they are too few or too short for it."""
    size = max(256, min(size, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def ordinary_windows(texts: list[np.ndarray]) -> list[bytes]:
    """Windows of the texts, at most TRAINER_WINDOWS, evenly spaced."""
    found = sum(len(windows(block, np.array([0, len(block)]))[0]) for block in joined(texts))
    step, skip, out = max(1, -(-found // TRAINER_WINDOWS)), 0, []
    for block in joined(texts):
        starts, ends, _ = windows(block, np.array([0, len(block)]))
        raw = block.tobytes()
        out += [raw[a:b] for a, b in zip(starts[skip::step], ends[skip::step])]
        skip = (skip - len(starts)) % step
    return out


def calibrated(hist: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(evidence of each difference, weights and bias of a text's log odds) from texts of both classes, weighted to the classes' shares among all labels."""
    by_class = [hist[y == k].sum(0) + 1 for k in (0, 1)]
    evidence = np.log(by_class[1] / by_class[1].sum()) - np.log(by_class[0] / by_class[0].sum())
    x = features(hist, evidence)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    w = platt((x - mean) / scale, y, np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y))
    return evidence, np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def fit(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """Two pairs of dictionaries: each is trained on all folds but one, which calibrates it."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    texts = {y: [_LOWER[np.frombuffer(t.encode(), np.uint8)] for t in dict.fromkeys(t for t, z in rows if z == y)] for y in (0, 1)}
    model = Model([], [], [], prior)
    if min(len(t) for t in texts.values()) < FOLDS:
        return model
    grams = {(y, f): gram_contexts(texts[y][f::FOLDS]) for y in (0, 1) for f in range(FOLDS)}
    for f in range(FOLDS - 1):
        ordinary, toxic = ([t for i, t in enumerate(texts[y]) if i % FOLDS != f] for y in (0, 1))
        lean = leaning(*([grams[y, g] for g in range(FOLDS) if g != f] for y in (1, 0)))
        pair = trained(ordinary_windows(ordinary), ORDINARY_SIZE, 32), trained(leaning_stretches(toxic, lean), TOXIC_SIZE, 16)
        compressors = Model([pair], [], [], prior).compressors()
        rest = [(t, y) for y in (0, 1) for t in texts[y][f::FOLDS]]
        hist = np.array([histograms(t, np.array([0, len(t)]), compressors)[0, 0] for t, _ in rest])
        evidence, weights = calibrated(hist, np.array([y for _, y in rest]), prior)
        model.pairs.append(pair)
        model.evidence.append(evidence)
        model.weights.append(weights)
    return model


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for low, high, data, offsets in text_blocks(batch, "text", 1 << 20):
                score[low:high] = model.score(data, offsets, compressors)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits in one task, on the bounded sample; what comes to the driver is the model."""
    rows, counts = training_frame(docs, labels, "toxic", ROWS_PER_CLASS, BYTES_PER_CLASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((text.as_py(), y.as_py()) for batch in batches for text, y in zip(batch.column("text"), batch.column("y")))
        model = fit(list(within(found, BYTES_PER_CLASS)), counts)
        sides = [[pair[side] for pair in model.pairs] for side in (0, 1)]
        columns = [pa.array(x, pa.binary()) for x in sides] + [pa.array([list(v) for v in x], pa.list_(pa.float64())) for x in (model.evidence, model.weights)]
        yield pa.RecordBatch.from_arrays(columns, ["ordinary", "toxic", "evidence", "weights"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")  # at most 2 * ROWS_PER_CLASS rows
    parts = ordered.select("text", "y").mapInArrow(run, "ordinary binary, toxic binary, evidence array<double>, weights array<double>").collect()
    total = sum(counts.values())
    return Model([(bytes(r.ordinary), bytes(r.toxic)) for r in parts], [np.array(r.evidence) for r in parts], [np.array(r.weights) for r in parts], counts.get(1, 0) / total if total else 0.0)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; all columns stay as they are."""
    model = fit_toxicity(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            for low, high, data, offsets in text_blocks(texts, "text", 1 << 20):
                keep[low:high] = model.score(data, offsets, compressors) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
