"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs no rule decides.

Rules: the longest rule whose host is the URL's host or one of its parent domains, and whose path the URL's path starts
with, wins. All other URLs are judged by trees on the URL alone: length, depth, digit ratio, entropy, parameter counts,
hyphens and labels of the host, and statistics of its suffixes: how many of all pages have the suffix, and which share
of the labelled ones is blocked. Suffix counts cover all rows and are summed in a table of fixed size by hash, so
neither a hot host nor the number of hosts matters. While the trees are fitted, a URL's block rates come from the labels of the
other folds (by a hash of the URL), never from its own label.

Labels: (url, block) pairs; by default URLs whose host holds a term of a short fixed list are blocked, and those that a
rule allows, with a share of the rest, are presumed clean. The fit takes a bounded sample, by a hash of the URL.

Defined results: a null URL or one without `://` has an empty host and path; no rule fits it, and the trees judge it
like any other. Null ids stay; repeated rows are judged each. Without labels of both kinds the verdict is allow.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

#: (rule as shown, host, path, verdict)
RULES = (("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"))
#: Terms of a host that label it as blocked.
TERMS = ("adult", "ads", "bets", "casino", "cheap", "pills", "spam")
#: The fit's bound: labelled URLs of each kind.
ROWS_PER_CLASS = 5000
BUCKETS, FOLDS = 4096, 5
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "parameter_length", "hyphens", "labels", "longest_label", "vowel_ratio", "tls", "suffix1_log_pages", "suffix1_block_rate", "suffix2_log_pages", "suffix2_block_rate")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """df with `host` and `path` columns, A-Z of the host lower-cased; both empty for null URLs and those without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("path", F.coalesce(path, F.lit(""))).withColumn("host", F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Ties of length go to the rule listed first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for shown, rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(shown)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def suffix_table(pages: DataFrame, labelled: DataFrame) -> np.ndarray:
    """[FOLDS + 1, 2, BUCKETS, 2]: for one and two labels, by hash bucket, all pages and the smoothed block rate of labelled URLs.

    The entry of a fold has the rates of the other folds' labels, the last one those of all.
    """
    out = np.zeros((FOLDS + 1, 2, BUCKETS, 2))
    bucket = lambda k: F.pmod(F.crc32(suffix(F.col("host"), k)), F.lit(BUCKETS)).cast("int").alias("bucket")
    for i in (0, 1):
        for r in pages.groupBy(bucket(i + 1)).count().collect():  # at most BUCKETS rows
            out[:, i, r.bucket, 0] = np.log1p(r["count"])
        sums = np.zeros((FOLDS, BUCKETS, 2))
        for r in labelled.groupBy(fold(F.col("url")).alias("fold"), bucket(i + 1)).agg(F.sum("block").alias("b"), F.count("*").alias("n")).collect():  # at most FOLDS * BUCKETS
            sums[r.fold, r.bucket] = r.b, r.n
        used = np.concatenate([sums.sum(0) - sums, sums.sum(0, keepdims=True)])
        whole = used.sum(1)
        overall = np.divide(whole[:, 0], whole[:, 1], out=np.zeros(FOLDS + 1), where=whole[:, 1] > 0)[:, None]
        out[:, i, :, 1] = (used[..., 0] + 4 * overall) / (used[..., 1] + 4)
    return out


def features(urls: list[str | None], hosts: list[str], paths: list[str], suffixes: np.ndarray) -> np.ndarray:
    from zlib import crc32

    x = np.zeros((len(urls), len(FEATURES)))
    for i, (u, h, p) in enumerate(zip(urls, hosts, paths)):
        u = u or ""
        b = np.frombuffer(u.encode(), np.uint8)
        query = u.partition("#")[0].partition("?")[2]
        parts = h.split(".")
        counts = np.bincount(b, minlength=1)
        share = counts[counts > 0] / max(1, len(b))
        letters = [c for c in h if c.isalpha()]
        x[i, :12] = len(b), len(h), sum(map(bool, p.split("/"))), sum(c.isdigit() for c in u) / max(1, len(u)), -(share * np.log2(share)).sum(), query.count("=") + query.count("&"), len(query), h.count("-"), len(parts), max(map(len, parts)), sum(c in "aeiou" for c in letters) / max(1, len(letters)), u[:6].lower() == "https:"
        for k in (0, 1):
            x[i, 12 + 2 * k : 14 + 2 * k] = suffixes[k, crc32(".".join(parts[-k - 1 :]).encode()) % BUCKETS]
    return x


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss, as arrays [tree, node]; children of node k are 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1)) - 1):
                node = np.where(f[node] >= 0, 2 * node + 1 + (x[rows, np.maximum(f[node], 0)] > t[node]), node)
            out += v[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting: second-order gains over quantile bins, level by level."""
    nodes = (1 << (depth + 1)) - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p0 / (1 - p0))), np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)))
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                at = np.flatnonzero(node == k)
                if not len(at):
                    continue
                gs, hs = g[at].sum(), h[at].sum()
                model.value[t, k] = -rate * gs / (hs + ridge)
                best = (1e-6, -1, 0.0)
                for f, e in enumerate(edges if level < depth else ()):
                    if not len(e):
                        continue
                    b = binned[at, f]
                    gl, hl, n = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (g[at], h[at], np.ones(len(at))))
                    gain = np.where((n >= least) & (len(at) - n >= least), gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge), -1)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, float(e[i]))
                if best[1] >= 0:
                    model.feature[t, k], model.threshold[t, k] = best[1], best[2]
                    node[at] = 2 * k + 1 + (x[at, best[1]] > best[2])
        margin = margin + model.value[t, node]
    return model


def default_labels(pages: DataFrame) -> DataFrame:
    """(url, host, path, block): hosts with a listed term are blocked; allowed by rule, and one of four of the rest by a hash, count as clean.

    What a rule blocks is left out: rules name regions, and say nothing of how a URL looks.
    """
    listed = F.col("host").rlike("|".join(re.escape(t) for t in TERMS))
    clean = (F.col("verdict") == "allow") | F.col("verdict").isNull() & (F.pmod(F.xxhash64("url"), F.lit(4)) == 0)
    block = F.when(listed, F.lit(1)).when(clean, F.lit(0))
    return pages.where(F.col("url").isNotNull()).select("url", "host", "path", block.alias("block")).where(F.col("block").isNotNull())


def fit(pages: DataFrame, labelled: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, Trees | None]:
    suffixes = suffix_table(pages, labelled)
    parts = [labelled.where(F.col("block") == k).select("url", "host", "path", "block", fold(F.col("url")).alias("fold")).distinct().orderBy(F.xxhash64("url"), "url").limit(rows_per_class) for k in (0, 1)]
    rows = [r for p in parts for r in p.collect()]
    y = np.array([r.block for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return suffixes[FOLDS], None
    x = np.zeros((len(rows), len(FEATURES)))
    for f in range(FOLDS):
        at = [i for i, r in enumerate(rows) if r.fold == f]
        x[at] = features([rows[i].url for i in at], [rows[i].host for i in at], [rows[i].path for i in at], suffixes[f])
    return suffixes[FOLDS], boost(x, y)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row; score: the trees' block probability where they judge."""
    urls = with_host_path(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = stored(urls.withColumn("rule", rule).withColumn("verdict", verdict))
    if labelled is not None:
        labelled = with_host_path(labelled)
    suffixes, trees = fit(urls, default_labels(urls) if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast((suffixes, trees))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, trees = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            if trees is not None and batch.num_rows:
                score = 1 / (1 + np.exp(-trees.margin(features(batch["url"].to_pylist(), batch["host"].to_pylist(), batch["path"].to_pylist(), suffixes))))
            decided = batch["verdict"].to_pylist()
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(decided, score)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], batch["rule"], pa.array(verdict, pa.string()), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    out = urls.select("page_id", "url", "host", "path", "rule", "verdict").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("page_id", id_col)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
