"""The training-data operators against brute force, SQL, held-out labels, and tables of edge rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, jaccard_join, line_dedup, mixing, quality, registry, sharding, token_counts, topk_search, toxicity, url_filter
from tidemark.llm.common import row_shingles, table
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, keys string, h long, lines int"


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), 1.0, "x", "k", 5, 7) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


EDGE = [None, "", "   \n\t ", "one", "same text here once more", "same text here once more", "Ünï çödé wörds ñ 漢字 \U0001f600 end", "x" * 200_000, "word " * 30_000, "a\x00b \x1c c"]


def edge(spark):
    return documents(spark, [*EDGE, "nobody knows this row"], [*range(len(EDGE)), None])


def empty(spark):
    return documents(spark, [])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, data, duck):
    got, want = registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("seed,dims,scale", [(0, 8, 1.0), (1, 64, 0.1), (2, 3, 100.0)])
def test_topk_brute_force(spark, seed, dims, scale):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(400, dims)) * scale
    v[50:60] = v[0]  # ties
    df = spark.createDataFrame([(i, [float(e) for e in r], "s") for i, r in enumerate(v)], "vec_id long, embedding array<double>, score string")
    index = topk_search.build_index(topk_search.quantised(df, "vec_id", "embedding"), 64)
    got = topk_search.search(index, topk_search.query_blocks(topk_search.quantised(df.where("vec_id % 20 = 0"), "vec_id", "embedding"), 7), 5, 3).collect()
    q = np.floor(256 * v).astype(np.int64)
    want = []
    for i in range(0, 400, 20):
        s = q @ q[i]
        order = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == want


def test_topk_edge_rows(spark):
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, []), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got)] == [(1, 5, 65536), (2, 4, 0), (3, 6, 0)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_topk_broadcasts_no_query_copies(spark):
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    got = topk_search.top_k(rows, F.col("vec_id") % 50 == 0)
    assert len(got.collect()) == 20
    plan = got._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert "CoGroups" in plan and "Broadcast" not in plan


def test_topk_cells(spark):
    v = np.random.default_rng(5).normal(size=(300, 6))
    vectors = topk_search.quantised(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    one, many = (sorted(topk_search.search(topk_search.build_index(vectors, 40), topk_search.query_blocks(vectors, 30), 3, *n).collect()) for n in ((1, 1), (5, 3)))
    assert one == many and len(one) == 900


def test_topk_of_huge_products(spark):
    rng = np.random.default_rng(4)
    v = [[2e7] * 8]
    for x in rng.normal(size=(60, 7)):
        v.append([*(2e7 * x).tolist(), -float((2e7 * x).sum()) + float(rng.integers(-50, 50))])  # products beyond 64 bits that cancel
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    q = [[math.floor(256 * x) for x in r] for r in v]
    score = lambda i, j: sum(x * y for x, y in zip(q[i], q[j]))
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0).collect())
    order = sorted(range(1, 61), key=lambda j: (-score(0, j), j))[:5]
    assert max(abs(score(0, j)) for j in order) < 2**63 and got == [(0, r + 1, j, score(0, j)) for r, j in enumerate(order)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk_search.top_k(spark.createDataFrame([(0, [1e8] * 64), (1, [1e8] * 64)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


# ---------------------------------------------------------------- 2, 6


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier(spark, module, label):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    name = "fit_quality" if label == "quality" else "fit_toxicity"
    model = getattr(module, name)(docs, labels)
    got = module.score_texts(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all()
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all() and len(held) > 500
    s, y = held.score.rank().to_numpy(), held[label].to_numpy()
    auc = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.9 and (held.predicted == y).mean() > 0.93
    if label == "toxic":  # at the threshold: some 8 % of the toxic labels stand on texts without toxic words
        assert held.predicted[y == 1].mean() > 0.8 and held.predicted[y == 0].mean() < 0.05


@pytest.mark.parametrize("module,fit", [(quality, quality.fit_quality), (toxicity, toxicity.fit_toxicity)])
def test_classifier_edge_rows(spark, module, fit):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 3, 4, 5, 6, 7, 8, 9)] + [(3, None, None), (None, 1, 1), (4, 7, 7)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = module.score_texts(edge(spark), fit(edge(spark), lab)).toPandas()
        assert len(got) == len(EDGE) + 1 and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
        assert got[got.doc_id == 0].score.item() == got[got.doc_id == 1].score.item()
        assert got[got.doc_id == 4].score.item() == got[got.doc_id == 5].score.item()
        assert module.score_texts(empty(spark), fit(empty(spark), lab)).count() == 0
    kept = toxicity.drop_toxic(edge(spark), labels.limit(0))
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) + 1


def test_training_rows_are_whole(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    whole = {r.text for r in docs.select("text").collect()}
    got, counts = common.training_rows(docs, labels, "toxic", 20, 1 << 30)
    assert all(t in whole for t, _ in got) and [sum(y == k for _, y in got) for k in (0, 1)] == [20, 20] and counts[0] > 200
    few, _ = common.training_rows(docs, labels, "toxic", 20, 9000)
    assert all(t in whole for t, _ in few) and all(sum(len(t.encode()) for t, y in few if y == k) <= 9000 for k in (0, 1)) and 0 < len(few) < 40


def test_toxicity_fit_in_a_task(spark):
    """The task's model is that of the same rows fitted here; without labels of both classes there is none."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    a = toxicity.fit_toxicity(docs, labels)
    b = toxicity.fit(*common.training_rows(docs, labels, "toxic", toxicity.ROWS_PER_CLASS, toxicity.BYTES_PER_CLASS))
    assert a.pairs == b.pairs and len(a.pairs) == 2 and a.prior == b.prior
    assert all((x == y).all() for x, y in zip(a.evidence + a.weights, b.evidence + b.weights))
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 0")).pairs == [] == toxicity.fit_toxicity(docs.limit(0), labels).pairs


def test_compression_distance_brute_force(spark):
    """Windows found and compressed one by one, and evidence summed in plain Python, against the blocks of a batch."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    some = docs.where("doc_id % 7 = 0 AND doc_id > 20").unionByName(edge(spark).select(docs.columns))
    got = {r.doc_id: r.score for r in toxicity.score_texts(some, model).collect()}
    pairs = model.compressors()
    low = toxicity._PRIMER.tobytes()
    for r in some.collect():
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode())
        starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        starts = [s for k, s in enumerate(starts) if not k or s // 32 != starts[k - 1] // 32]
        z = 0.0
        for (ordinary, toxic), evidence, weights in zip(pairs, model.evidence, model.weights):
            hist = [0] * 33
            for k, s in enumerate(starts):
                end = min((starts[k + 1] if k + 1 < len(starts) else len(b)) + 12, len(b))
                frame = low + b[max(0, s - 1) : end] + b" " * 12
                d = len(ordinary.compress(frame)) - len(toxic.compress(frame))
                hist[max(-16, min(16, d)) + 16] += 1
            n = sum(hist)
            total, toxic_only = (sum(h * e for h, e in zip(hist, evidence) if e > least) for least in (-np.inf, 0))
            x = [np.sign(total) * np.log1p(abs(total)), total / max(1, n) ** 0.5, np.log1p(n), np.log1p(toxic_only), toxic_only / max(1, n), 1]
            z += float(np.dot(x, weights)) / 2
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-9


def test_quality_brute_force(spark):
    """Features as sets of byte strings in plain Python against the arrays of a batch."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    some = docs.where("doc_id % 11 = 0 AND doc_id > 20").unionByName(edge(spark).select(docs.columns))
    got = {r.doc_id: r.score for r in quality.score_texts(some, model).collect()}
    kind = lambda c: 0 if 97 <= c <= 122 or c >= 128 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c == 32 else 4 if c == 10 else 5 if c in b".,;:'-\"()?" else 6 if c == 33 else 7
    for r in some.collect():
        b = (r.text or "").encode()
        f = {c for c in b} | {256 + (b[i] << 8 | b[i + 1]) for i in range(len(b) - 1)}
        f |= {256 + 65536 + (((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 14) for i in range(len(b) - 2)}
        f |= {256 + 65536 + (1 << 18) + (kind(b[i]) << 9 | kind(b[i + 1]) << 6 | kind(b[i + 2]) << 3 | kind(b[i + 3])) for i in range(len(b) - 3)}
        f = sorted(f)
        norm = float((model.ratio[f].astype(np.float64) ** 2).sum()) ** 0.5 or 1.0
        z = model.scale[0] * (float(model.weights[f].astype(np.float64).sum()) / norm + model.bias) + model.scale[1]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-3


def test_held_out_labels_change_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, flipped))
    assert a.pairs == b.pairs and np.allclose(a.weights, b.weights)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(80, 3)), np.sign(rng.normal(size=80))
    w = quality.dual_coordinate_descent([(np.arange(3), r) for r in x], y, np.full(80, 0.5), 3, 500)

    def primal(v):
        return 0.5 * (v**2).sum() + 0.5 * np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()

    assert all(primal(w) <= primal(w + d) + 1e-4 for d in rng.normal(size=(200, 4)) * 0.05)


# ---------------------------------------------------------------- 3


def test_url_rules(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "HTTP://WWW.Example.NET/de/1?q#f": ("www.example.net", "/de/1", "net/", "block"),
        "https://example.com/de/9#x/y": ("example.com", "/de/9", "example.com/de/", "block"),
        "https://x.org/fr/?a://b": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "https://net": ("net", "", None, None),
        "://?q": ("", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(99, None, "h"), (None, "http://q.net/", "h"), (0, next(iter(cases)), "h")], "page_id long, url string, host string")
    got = url_filter.judge(df).toPandas()
    assert len(got) == len(cases) + 3 and set(got.verdict) <= {"allow", "block"}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[got.page_id == i].iloc[0]
        assert (r.host, r.path) == (host, path) and (r["rule"] == rule or rule is None and r["rule"] is None)
        assert verdict is None or r.verdict == verdict
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_trees(spark):
    got = url_filter.op3_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").toPandas()
    spam = got.host.str.contains("pills|casino|spam|bets|ads-|adult")
    assert (got[spam].verdict == "block").mean() > 0.95 and (got[~spam].verdict == "allow").mean() > 0.95


def test_suffix_rates_of_a_fold_leave_its_labels_out(spark):
    hosts = [f"h{i}.{t}" for i in range(40) for t in ("com", "co.uk", "net")]
    data = [(i, f"http://{h}/{i}", h, "/", i % 3 % 2) for i, h in enumerate(hosts)]
    df = spark.createDataFrame(data, "page_id long, url string, host string, path string, block int").withColumn("fold", url_filter.fold(F.col("url")))
    table = url_filter.suffix_table(df, df)
    rows = df.collect()
    assert len({r.fold for r in rows}) == url_filter.FOLDS
    for left in range(url_filter.FOLDS + 1):
        used = [r for r in rows if r.fold != left]
        overall = sum(r.block for r in used) / len(used)
        for k in (1, 2):
            names = {}
            for r in used:
                names.setdefault(zlib.crc32(".".join(r.host.split(".")[-k:]).encode()) % url_filter.BUCKETS, []).append(r.block)
            for b, y in names.items():
                assert abs(table[left, k - 1, b, 1] - (sum(y) + 4 * overall) / (len(y) + 4)) < 1e-12


def test_boosting_fits_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    assert (((url_filter.boost(x[:400], y[:400]).margin(x[400:])) > 0) == y[400:]).mean() > 0.95


# ---------------------------------------------------------------- 4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_brute(docs):
    """{(doc, line)} that go, by the definition."""
    every = [(d, k, x) for d, t in sorted(docs.items()) for k, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    gone = {}
    for i, (d, k, x) in enumerate(every):
        if any(z == x for _, _, z in every[:i]):
            gone[d, k] = "equal"
    first = {}
    for d, k, x in every:
        first.setdefault(x, (d, k))
    near = {x for x in first if len(x) >= 20 and any(first[z] < first[x] and len(z) >= 20 and abs(len(z) - len(x)) < 2 and levenshtein(x, z) == 1 for z in first)}
    for d, k, x in every:
        if x in near:
            gone[d, k] = "near"
    return gone


def test_lines_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(18, 60))) for _ in range(12)]

    def mutate(x):
        i, kind = rng.randrange(len(x)), rng.random()
        return x if kind < 0.3 else x[:i] + x[i + 1 :] if kind < 0.5 else x[:i] + rng.choice("abz") + x[i:] if kind < 0.7 else x[:i] + rng.choice("abz") + x[i + 1 :]

    texts = ["\n".join(mutate(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(50)] + ["", "\n\n", "  ", "short\nshort\nshorx"]
    want = line_brute(dict(enumerate(texts)))
    got = {(r._ld_doc, r.line): "near" if r.near else "equal" for r in line_dedup.decisions(documents(spark, texts)).collect()}
    assert got == want and {"near", "equal"} == set(want.values())
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)


def test_lines_edge_rows(spark):
    got = line_dedup.dedup_lines(edge(spark)).toPandas().set_index("doc_id")
    assert len(got) == len(EDGE) + 1 and got.text[0] is None and got.text[1] == "" and got.text[7] == EDGE[7] and got.text[5] == ""
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_one_edit():
    assert all(line_dedup.within_one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "abxc"), ("abc", "ab"), ("", "a")))
    assert not any(line_dedup.within_one_edit(a, b) for a, b in (("abc", "acb"), ("abc", "a"), ("ab", "ba"), ("abc", "xbcd")))


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("n,target", [(0, 10), (1, 10), (39, 10), (40, 10), (997, 13)])
def test_shards(spark, n, target):
    rng = random.Random(n)
    docs = documents(spark, [rng.choice(["", None, "é" * rng.randint(1, 2000), "copy"]) for _ in range(n)], [rng.choice([k, None]) if k % 50 == 0 else k for k in range(n)])
    got = sharding.shard_by_curve(docs, target_rows=target).toPandas()
    assert len(got) == n
    if n:
        counts = got.groupby("shard").size().reindex(range(40), fill_value=0)
        assert counts.max() - counts.min() <= 1 and (got.law == "rows").all() and got.grown_shard.isna().all()
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
        order = got.sort_values(["shard", "slot"]).curve.to_numpy()
        assert (np.diff(order) >= 0).all()
        by = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
        for r in got.dropna(subset=["doc_id"]).itertuples():
            t = by[int(r.doc_id)]
            assert r.size == 16 + len((t or "").encode()) and (np.isnan(r.text_crc32) if t is None else int(r.text_crc32) == zlib.crc32(t.encode()))


def test_boundaries_do_not_depend_on_ranges(spark):
    counts = spark.createDataFrame([(f"s{i * 7919 % 1000:04d}", 1 + i % 13) for i in range(500)] + [(None, 40)], "s string, count long")
    whole = sharding.boundaries(counts, "s", 4)
    values, below, first = sorted((r.s, r["count"]) for r in counts.where("s is not null").collect()), 40, {}
    for v, n in values:  # nulls lie below all others
        first.setdefault(max(1, below * 16 // (40 + sum(n for _, n in values))), v)
        below += n
    assert whole == [(v, b) for b, v in sorted(first.items())]
    assert len(whole) > 10 and all(sharding.boundaries(counts, "s", 4, n) == whole for n in (1, 7, 499))
    assert sharding.boundaries(counts.where("s is null"), "s", 4) == [] == sharding.boundaries(counts.limit(0), "s", 4)


def test_shard_files_hold_whole_rows_and_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("clash")).withColumn("slot", F.lit(None).cast("string"))
    ranges = sharding.write_shards(docs, str(tmp_path / "out"), 60).toPandas()
    back = spark.read.parquet(str(tmp_path / "out")).select("row.*").toPandas().sort_values("doc_id", ignore_index=True)
    assert back.equals(docs.toPandas().sort_values("doc_id", ignore_index=True)) and ranges.rows.sum() == len(back)
    read = lambda r, c, v: r.rows[(r[f"least_{c}"] <= v) & (r[f"greatest_{c}"] >= v)].sum() / len(back)
    for c in ("source", "lang"):
        share = back[c].value_counts(normalize=True)
        # files read for one value, against its share of the rows
        assert sum(read(ranges, c, v) * w for v, w in share.items()) < 0.5 * (1 + (share**2).sum())
        assert all(read(ranges, c, v) >= w - 1e-9 for v, w in share.items())


def test_hilbert_is_a_walk():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert_index([g[:, i] for i in range(3)], 3)
    assert sorted(index) == list(range(512))
    walk = g[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---------------------------------------------------------------- 7


def test_decontamination_finds_every_edited_passage(spark):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefg hij") for _ in range(rng.randint(40, 300))).strip() + "z") for i in range(30)] + [(90, "tiny"), (91, ""), (92, None)]
    index = decontamination.Passages(items)
    budget = dict(zip(index.items, index.budget))
    texts, want = [], set()
    for d in range(60):
        i, t = items[rng.randrange(30)]
        x = list(t)
        for _ in range(rng.randint(0, int(budget[i]))):
            k, kind = rng.randrange(len(x)), rng.random()
            if kind < 0.4:
                x[k] = "q"
            elif kind < 0.7:
                x.insert(k, "q")
            elif len(x) > 1:
                del x[k]
        texts.append("Some words  before\n" + "".join(x).upper() + "\tand after")
        want.add((d, i))
    texts += ["nothing at all", "", None, items[0][1][: len(items[0][1]) // 2], "It is a tiny thing"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.occurrences(documents(spark, texts), bench).toPandas()
    pairs = {(r.doc_id, r.item_id) for r in got.itertuples()}
    assert want <= pairs and pairs - want == {(64, 90)}
    for r in got.itertuples():
        assert 0 <= r.start < r.end <= len(texts[r.doc_id].encode())
        if r.item_id < 90:
            cut = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", texts[r.doc_id].encode()[r.start : r.end].decode().lower())
            passage = re.sub(" +", " ", dict(items)[r.item_id])
            assert levenshtein(passage, cut) == r.edits <= budget[r.item_id]
    kept = decontamination.drop_contaminated(documents(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {60, 61, 62, 63} and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("m", range(8, 41))
def test_decontamination_finds_edited_short_passages(m):
    """With all allowed edits, each where it breaks eight q-grams."""
    rng = random.Random(m)
    p = "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(m))
    index = decontamination.Passages([(1, p)])
    e = int(index.budget[0])
    assert index.least[0] >= 1
    edited = "".join("z" if i % 8 == 7 and i // 8 < e else c for i, c in enumerate(p))
    for text in (p, edited):
        b = np.frombuffer(f"xyz {text} xyz".encode(), np.uint8)
        assert any(f[1] == 1 and f[4] <= e for f in index.search(b, np.array([0, len(b)]))), text


def test_decontamination_edge_rows(spark):
    bench = spark.createDataFrame([(1, EDGE[4]), (None, EDGE[6])], "item_id long, text string")
    got = decontamination.occurrences(edge(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id or -1) for r in got) == [(4, 1), (5, 1), (6, -1)]
    assert decontamination.occurrences(edge(spark), bench.limit(0)).count() == 0
    assert decontamination.occurrences(empty(spark), bench).count() == 0
    assert len(list(decontamination.passage_blocks(bench, 10))) > 1


# ---------------------------------------------------------------- 8


def jaccard_brute(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed,n,num,bits,pair_prefix", [(0, 4, 85, 24, 24), (1, 5, 80, 6, 24), (2, 4, 85, 4, 200), (3, 2, 50, 5, 24), (4, 4, 85, 4, 0)])
def test_jaccard_brute_force(spark, seed, n, num, bits, pair_prefix):
    """bits: few buckets make most shingles frequent, which tries pairs and size classes."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 9)):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            texts.append(" ".join((passage if rng.random() < 0.4 else []) + x).upper())
    texts += ["", None, "W1", "w1 w2", "W1  w2", "w1 w2 w3 w4", " \n "]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(documents(spark, texts), n, num, 100, bits, pair_prefix).collect()}
    assert got == jaccard_brute(texts, n, num, 100)


def test_jaccard_memory_is_bounded(spark, monkeypatch):
    import tracemalloc

    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i * j % 997}" for j in range(2000)) for i in range(1, 401)]})
    tracemalloc.start()
    assert sum(1 for _ in jaccard_join.row_shingles(batch, 5)) == 400
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # for 4 MB of text
    key, seen, run = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard_join.class_components
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard_join, "class_components", lambda docs, *a: (seen.append(spark.conf.get(key)), run(docs, *a))[1])
    assert jaccard_join.jaccard_groups(documents(spark, ["a b c d e f", "x"]), 5, 80, 100).count() == 2
    assert seen == ["1000"] and spark.conf.get(key) == before


def test_jaccard_edge_rows(spark):
    got = jaccard_join.jaccard_groups(edge(spark), 5, 80, 100).toPandas()
    assert len(got) == len(EDGE) + 1
    by = got.dropna(subset=["doc_id"]).set_index("doc_id").component_id
    assert by[5] == 4 and by[0] == 0 and by[1] == 1 and got[got.doc_id.isna()].component_id.isna().all()
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0
    kept = jaccard_join.keep_first_of_groups(edge(spark))
    assert kept.count() == len(EDGE) and kept.columns == edge(spark).columns


def test_keep_first_with_repeated_ids(spark):
    a, b, c = ("one two three four five six seven " + w for w in ("a", "b", "c"))
    texts = [a, a, b + " other text of its own that is linked with nothing", a, c * 3, c * 3, "", "", a]
    ids = [1, 1, 2, 2, 5, 4, 7, 7, None]
    docs = documents(spark, texts, ids)
    kept = jaccard_join.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    # of group a the first row of id 1; id 2 keeps the text that is no copy; rows without a set or an id stay
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, a), (2, texts[2]), (4, c * 3), (7, ""), (7, ""), (-1, a)])


def test_a_hot_shingle_never_looks_rare(spark):
    texts = spark.range(0, 65_537, 1, 1).select(F.lit("a b c d e").alias("text"))  # one more than 16 bits count
    hot = next(iter(jaccard_join.row_shingles(pa.RecordBatch.from_pydict({"text": ["a b c d e"]}), 5)))
    assert jaccard_join.frequency_levels(texts, 5, 16)[int(hot[0] >> np.uint64(48))] > 0


def test_shingle_counts_match_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a b c d e", "A B c D e", "a b", None, "x\x0by\x0cz w"]})
    s = list(row_shingles(batch, 4))
    assert [len(x) for x in s] == [2, 2, 1, 0, 1] and (s[0] == s[1]).all()


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# ---------------------------------------------------------------- 9


def test_raking_meets_its_targets(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", rng.randint(1, 1000)) for i in range(5) for j in range(3) for k in range(2)], "source string, lang string, topic string, base long")
    targets = {d: mixing.default_targets(cells, d, 0.5) for d in mixing.DIMS}
    out = mixing.rake(cells, targets)
    total = out.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(cells.agg(F.sum("base")).first()[0])
    for d in mixing.DIMS:
        for r in out.groupBy(d).agg(F.sum("weight").alias("w")).join(targets[d], d).collect():
            assert r.w / total == pytest.approx(r.target, rel=1e-6)
    p = mixing.with_rate(out, 0.6).toPandas()
    rate = min(0.6, 1 / p.ratio.max())
    assert (p.base * p.probability).sum() == pytest.approx(rate * total, rel=1e-6) and p.probability.max() <= 1
    joined = mixing.rake(cells, targets, few=False).toPandas().set_index(list(mixing.DIMS)).weight
    assert (joined / out.toPandas().set_index(list(mixing.DIMS)).weight - 1).abs().max() < 1e-8


def skewed_cells(spark, thin=1):
    """Sources that nearly keep to one language each, one of them hot: a few sweeps do not do."""
    rows = [(f"s{i}", f"l{j}", f"t{k}", (50_000 if i == 0 else 40 * (i + 1)) if j == i % 4 else thin + (i + k) % 2) for i in range(30) for j in range(4) for k in range(3)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, base long")


def margin_errors(cells, targets, column="weight"):
    total = cells.agg(F.sum(column)).first()[0]
    return {d: max(abs(r.w / total / r.target - 1) for r in cells.groupBy(d).agg(F.sum(column).alias("w")).join(targets[d], d).collect()) for d in targets}


def test_raking_goes_on_until_the_margins_hold(spark):
    cells = skewed_cells(spark, 40)
    targets = {d: mixing.default_targets(cells, d, mixing.POWERS[d]) for d in mixing.DIMS}
    assert max(margin_errors(mixing.rake(cells, targets), targets).values()) < 1e-8


def test_sample_has_the_targets(spark):
    """Expected margins of the sample, as op9 takes it, on the 0.1 table: defaults, then targets that are given."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    given = {"topic": {"brief": 0.1, "prose": 0.5, "long": 0.4, "nowhere": 0.2}, "lang": {"en": 3, "de": 1}}
    for targets in (None, given):
        got = mixing.weigh(docs, targets).toPandas()
        kept = got.tokens * got.probability
        assert got.probability.between(0, 1).all()
        for d in mixing.DIMS:
            if targets and d in targets:
                want = {k: v for k, v in targets[d].items() if k != "nowhere"}
            else:
                want = (got.groupby(d).tokens.sum() ** mixing.POWERS[d]).to_dict()
            share = kept.groupby(got[d]).sum() / kept.sum()
            assert all(share.get(k, 0) == pytest.approx(v / sum(want.values()), rel=0.01) for k, v in want.items() if v)
            assert share[[k for k in share.index if k not in want]].sum() < 1e-9
        drawn = (got.tokens * got.sampled).groupby(got.topic).sum() / (got.tokens * got.sampled).sum()
        assert (drawn - kept.groupby(got.topic).sum() / kept.sum()).abs().max() < 0.03


@pytest.mark.parametrize("keep", [0.6, mixing.KEEP])
def test_sample_has_its_target_margins(spark, keep):
    """Expected tokens by margin, of the setting that the pipeline has: clipping at 1 must not lose what was raked."""
    rng = random.Random(3)  # at KEEP two topics have fewer tokens than their targets ask for
    cells = [(f"s{i}", f"l{j}", f"t{k}", rng.randint(200, 1000) * (1, 1, 3, 40, 60)[k]) for i in range(6) for j in range(3) for k in range(5)]
    cells = spark.createDataFrame(cells, "source string, lang string, topic string, base long")
    rows = cells.select(*[F.col(d).alias(f"_mix_{d}") for d in mixing.DIMS], F.col("base").alias("_mix_tokens"))
    wanted = {d: mixing.default_targets(cells, d, mixing.POWERS[d]).toPandas().set_index(d).target for d in mixing.DIMS}
    found = {d: cells.groupBy(d).agg(F.sum("base").alias("n")).toPandas().set_index(d).n for d in mixing.DIMS}

    def distances(**setting):
        got = rows.join(mixing.cell_probabilities(rows, keep=keep, **setting), [f"_mix_{d}" for d in mixing.DIMS]).toPandas()
        assert got._mix_probability.between(0, 1).all()
        kept = got._mix_tokens * got._mix_probability
        assert kept.sum() == pytest.approx(keep * got._mix_tokens.sum(), rel=1e-4)
        out = 0.0
        for d in mixing.DIMS:
            total = found[d].sum()
            target, most = wanted[d].copy(), found[d] / total / keep
            while (target > most * (1 + 1e-12)).any():  # what is short goes to the others in proportion
                short = target >= most
                target = target.where(~short, most)
                target[~short] *= (1 - target[short].sum()) / target[~short].sum()
            share = kept.groupby(got[f"_mix_{d}"]).sum() / (keep * total)
            out = max(out, (share / target - 1).abs().max())
        return out

    assert distances(bounded=True) < 2 * mixing.BOUNDED_TOLERANCE


def test_raking_says_when_targets_contradict(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, base long")
    shares = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("x", 0.9), ("y", 0.1)], "topic": [("t", 1.0)]}
    with pytest.warns(UserWarning, match="margin error"):  # sources of one language have too little of the others
        mixing.rake(skewed_cells(spark), {d: mixing.default_targets(skewed_cells(spark), d, mixing.POWERS[d]) for d in mixing.DIMS}, keep=mixing.KEEP)
    with pytest.warns(UserWarning, match="margin error"):
        mixing.rake(cells, {d: spark.createDataFrame(v, f"{d} string, target double") for d, v in shares.items()})


def test_mixing_edge_rows(spark):
    docs = edge(spark).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    got = mixing.weigh(docs).toPandas().set_index("doc_id")
    assert len(got) == len(EDGE) + 1 and (got.lang == "(none)").all() and got.tokens[0] == 0 and got.topic[0] == "empty" and got.probability.between(0, 1).all()
    assert got.sampled[4] in (0, 1)
    assert mixing.weigh(empty(spark)).count() == 0
    kept = mixing.sample_mixture(docs)
    assert kept.columns == docs.columns and kept.count() == got.sampled.sum()


# ---------------------------------------------------------------- 10


def greedy(b, pieces, longest):
    n = i = 0
    while i < len(b):
        i += next((k for k in range(min(longest, len(b) - i), 0, -1) if b[i : i + k] in pieces), 1)
        n += 1
    return n


SPLIT = re.compile(rb" ?[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+(?= [^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")


@pytest.mark.parametrize("seed", range(4))
def test_tokens_brute_force_on_odd_vocabularies(spark, seed):
    """Vocabularies with gaps: bytes that no piece starts with, long pieces whose prefixes are none."""
    rng = random.Random(seed)
    alphabet = b"abc "
    vocabulary = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(3, 40))] + [b"aaaaabab"]
    texts = ["".join(rng.choice("abc d\n") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, texts), vocabulary).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sum(greedy(m, set(vocabulary), 8) for m in SPLIT.findall(t.encode())), repr(t)


def test_tokens_public_vocabulary(spark, data):
    v = token_counts.read_vocabulary(token_counts.VOCABULARY)
    pieces, longest = set(v), max(map(len, v))
    docs = table(spark, data, "documents").limit(40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs, v).collect():
        assert r.n_tokens == sum(greedy(m, pieces, longest) for m in SPLIT.findall(texts[r.doc_id].encode()))
    got = token_counts.count_tokens(edge(spark), v).toPandas()
    assert len(got) == len(EDGE) + 1 and (got[got.doc_id.isin([0, 1])].n_tokens == 0).all() and (got[got.doc_id > 1].n_tokens > 0).all()
    assert token_counts.count_tokens(empty(spark), v).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before), sf)
        after = out.toPandas()
        if name == "sharding":
            assert sorted(after.doc_id) == sorted(before.doc_id) and set(after.shard) == set(range(40))
            break
        assert list(after.columns) == docs.columns
        kept = before[before.doc_id.isin(after.doc_id)].sort_values("doc_id").reset_index(drop=True)
        assert kept.equals(after.sort_values("doc_id").reset_index(drop=True))
        if name == "near_duplicates":
            groups = jaccard_brute(list(before.text), 5, 80, 100)
            assert sorted(after.doc_id) == sorted(before.doc_id[i] for i, (_, r) in groups.items() if before.doc_id[i] == min(before.doc_id[j] for j, (_, q) in groups.items() if q == r))
        if name == "decontamination":
            passages = [r.text for r in table(spark, sf, "benchmark").collect()]
            assert not any(p in t for t in after.text for p in passages) and len(before) - len(after) == sum(any(p in t for p in passages) for t in before.text)
        before = after
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


# ---------------------------------------------------------------- properties


def _lines(texts):
    b = [t.encode() for t in texts]
    return line_dedup.Lines(np.frombuffer(b"".join(b), np.uint8), np.append(0, np.cumsum([len(x) for x in b])).astype(np.int64), split=False)


def test_near_lines_always_share_a_block():
    """The filters before the variants lose no pair within one edit, and edit checks agree with the full distance."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.text("abé漢", min_size=20, max_size=70), st.integers(0, 200), st.sampled_from(["sub", "ins", "del"]), st.sampled_from("abz"))
    def check(a, place, kind, c):
        i = place % len(a)
        b = a[:i] + {"sub": c + a[i + 1 :], "ins": c + a[i:], "del": a[i + 1 :]}[kind]
        assert line_dedup.within_one_edit(a, b) == (levenshtein(a, b) <= 1)
        if len(b) < 20:
            return
        lines = _lines([a, b])
        for blocks in (2, 16):
            x, y = lines.keys(blocks)
            assert set(x) & set(y)
        (va, ha), (vb, hb) = (line_dedup.deletion_variants(t) for t in (a, b))
        assert [ha, hb] == list(lines.hashes())
        assert a == b or (set(zip(va, range(len(a)))) & set(zip(vb, range(len(b)))) if len(a) == len(b) else ha in vb or hb in va)

    check()


def test_similar_sets_always_share_an_entry():
    """Whatever the frequency levels say, sets that reach the threshold share an index entry whose room allows the link."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None)
    @given(st.integers(0, 10**6), st.integers(1, 120), st.integers(0, 12), st.integers(0, 12), st.sampled_from([(85, 100), (80, 100), (50, 100)]), st.integers(0, 40))
    def check(seed, shared, only_a, only_b, threshold, pair_prefix):
        num, den = threshold
        rng = np.random.default_rng(seed)
        pool = np.unique(rng.integers(0, 1 << 63, shared + only_a + only_b, dtype=np.uint64))
        rng.shuffle(pool)
        both = pool[:shared]
        a, b = np.sort(np.append(both, pool[shared : shared + only_a])), np.sort(np.append(both, pool[shared + only_a :]))
        same = len(np.intersect1d(a, b))
        if same * den < num * (len(a) + len(b) - same) or len(a) == len(b) == same:
            return
        levels = rng.choice(np.array([0, 0, 5, 9], np.uint8), 16)
        entries = [dict(zip(*(x.tolist() for x in jaccard_join.index_keys(s, levels, 4, num, den, pair_prefix)))) for s in (a, b)]
        hits = set(entries[0]) & set(entries[1])
        assert any(min(entries[0][k], entries[1][k]) * (num + den) >= num * (len(a) + len(b)) for k in hits)
        odd = sum(int(x).bit_count() for x in (jaccard_join.parities(a).view(np.uint64) ^ jaccard_join.parities(b).view(np.uint64)))
        assert odd * (num + den) <= (len(a) + len(b)) * (den - num)

    check()
