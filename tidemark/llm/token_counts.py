"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a byte trie. Every node carries a failure link: the node that stands for what is left of the
node's string once the longest pieces at its front are taken, and the number of pieces so taken. A word is then read
byte by byte: follow the edge, or else add the popped count and take the failure link; at the end the count that
empties the node is added. No piece is built, each byte is read once, and the failure steps are no more than the bytes.

A batch's distinct words run in lockstep: one vector step reads the next byte of every word that is still running.

Words: runs outside \\x20 \\x09-\\x0D with the one space before them, if there is one; other white space counts by its own
bytes, run by run. Greedy longest match, not merge order, defines the pieces of a word; a byte that no piece starts with counts as one
unknown piece. Defined results: null and empty texts have 0 tokens; repeated rows are counted each; a null id stays.
Other columns are ignored, whatever their names. Text length is unbounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import _SPACE, mix64, table, text_blocks

#: A public byte-level vocabulary of rank lines; the path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """The trie with failure links and popped counts, as flat arrays.

    fail[v], pops[v]: where reading goes on, and the pieces counted, when v has no edge for the next byte.
    A failure of -1 means that the byte after v's counted pieces is lost as one unknown piece (only at the root).
    """

    def __init__(self, vocabulary: list[bytes]):
        edges: dict[int, int] = {}
        piece = [False]
        parent, byte_in = [0], [0]
        for word in vocabulary:
            v = 0
            for b in word:
                u = edges.get(v << 8 | b)
                if u is None:
                    u = edges[v << 8 | b] = len(piece)
                    piece.append(False)
                    parent.append(v)
                    byte_in.append(b)
                v = u
            if v:
                piece[v] = True
        n = len(piece)
        fail, pops = [-1] * n, [0] * n
        end_pops = [0] * n
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):
            if piece[v]:  # the whole string is one piece
                fail[v], pops[v] = 0, 1
                continue
            z, count, b = fail[parent[v]], pops[parent[v]], byte_in[v]
            if z < 0:  # the parent is the root: a first byte that is no piece
                fail[v], pops[v] = 0, 1  # one unknown piece
                continue
            while (u := edges.get(z << 8 | b)) is None and z:
                count += pops[z]
                z = fail[z]
            fail[v], pops[v] = (u, count) if u is not None else (0, count + 1)
        for v in sorted(range(1, n), key=depth.__getitem__):  # what the string holds when nothing follows
            z, count = v, 0
            while z:
                count += pops[z]
                z = fail[z]
            end_pops[v] = count
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.fail, self.pops, self.end_pops = (np.array(x, np.int64) for x in (fail, pops, end_pops))
        self._hash()

    def _hash(self) -> None:
        """An open-addressed table of the edges: a few gathers a lookup instead of a binary search."""
        bits = int(len(self.edge_keys) * 4 - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.target = np.full(1 << bits, -1, np.int64)
        rest_k, rest_t = self.edge_keys, self.edge_to
        place = self._place(rest_k)
        self.probes = 0
        while len(rest_k):
            self.probes += 1
            free = self.slots[place] < 0
            self.slots[place[free]] = rest_k[free]
            won = self.slots[place] == rest_k
            self.target[place[won]] = rest_t[won]
            rest_k, rest_t, place = rest_k[~won], rest_t[~won], (place[~won] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that the edge leads to; -1 without one."""
        keys = state << 8 | byte
        place = self._place(keys)
        out = np.where(self.slots[place] == keys, self.target[place], -1)
        miss = np.flatnonzero((out < 0) & (self.slots[place] >= 0))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            place[miss] = (place[miss] + 1) & (len(self.slots) - 1)
            hit = self.slots[place[miss]] == keys[miss]
            out[miss[hit]] = self.target[place[miss[hit]]]
            miss = miss[~hit & (self.slots[place[miss]] >= 0)]
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each span of data, all spans in lockstep."""
        total = np.zeros(len(starts), np.int64)
        live = np.flatnonzero(ends > starts)
        state, at = np.zeros(len(live), np.int64), starts[live].copy()
        while len(live):
            to = self.step(state, data[at].astype(np.int64))
            stuck = to < 0
            lost = stuck & (state == 0)  # no piece starts with this byte
            total[live] += np.where(stuck, np.where(lost, 1, self.pops[state]), 0)
            at += ~stuck | lost
            state = np.where(stuck, np.where(lost, 0, self.fail[state]), to)
            done = at >= ends[live]
            if done.any():
                total[live[done]] += self.end_pops[state[done]]
                live, state, at = live[~done], state[~done], at[~done]
        return total


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with the space before them and the remaining runs of white space: (starts, ends, first span of each row)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~_SPACE[data]
    begin = edge[:-1].copy()
    begin[1:] |= solid[1:] != solid[:-1]
    lead = begin & solid & ~edge[:-1]  # a word after white space takes the one space before it
    lead[1:] &= data[:-1] == 0x20
    lead[0] = False
    where = np.flatnonzero(lead)
    begin[where] = False
    begin[where - 1] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, case kept, to find the distinct ones of a block."""
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    steps = mix64(np.arange(1, int(place.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    return mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * steps[place], starts) + (ends - starts).astype(np.uint64))


def count_tokens(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_spans) for every row. The automaton's size follows the vocabulary alone."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in batches:
            tokens, pieces = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for low, high, data, offsets in text_blocks(batch, "text"):
                starts, ends, first = spans(data, offsets)
                if len(starts):
                    _, at, inverse = np.unique(span_keys(data, starts, ends), return_index=True, return_inverse=True)
                    summed = np.append(0, np.cumsum(a.counts(data, starts[at], ends[at])[inverse]))
                    tokens[low:high] = summed[first[1:]] - summed[first[:-1]]
                    pieces[low:high] = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(pieces)], ["doc_id", "n_tokens", "n_spans"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_spans long")
    return out.withColumnRenamed("doc_id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY))
