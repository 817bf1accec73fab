"""Quality network, toxicity field and the pipeline: exact parts against plain Python, the rest by held-out rows."""
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loamgrid.llm import labelled, mixing, quality_net, repeats, toxicity

EXTRA = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(n, seed):
    """Prose, and junk that repeats words or shouts; in some a bad word, alone or with an ending."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "the", "ing", "er", "on", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        good, toxic = rng.random() > 0.25, rng.random() < 0.3
        if not good:
            words = [w for w in words[:12] for _ in range(9)] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scoundrel", "villain,", "qwzzk" + rng.choice(["a", "ing", "ly", "er"])])
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 0))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus(500, 3)
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (None, "no id", "en", "s1", 5), (5, rows[5][1], "en", "s0", 0), (1002, "villain " + "the an " * 30000, "en", "s1", 0)]
    rows += [(2000 + k, rows[k][1] + " more", "en", "s2", 0) for k in range(20, 40)]
    labels += [(5, labels[5][1], labels[5][2]), (6, 1 - labels[6][1], 1 - labels[6][2]), (None, 1, 1), (7, None, None), (9999, 1, 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path, rows, {i: (q, t) for i, q, t in labels if i not in (6, None) and q is not None}


def accuracy(rows, labels, column):
    held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in held) / len(held)


def test_quality(spark, tables):
    path, rows, labels = tables
    docs, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality_net.quality(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert accuracy(got, labels, 0) > 0.93


def test_quality_without_labels(spark, tables, edge_docs, no_docs):
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality_net.quality(edge_docs, known).collect()} == {0.5}
    assert quality_net.quality(no_docs, known).count() == 0


def test_gradients():
    """Backward against differences."""
    rng = np.random.default_rng(0)
    net = quality_net._first_net(rng)
    chunks = [rng.integers(0, 768, (k, 2 * quality_net.HOP + quality_net.WIDTH)).astype(np.uint16) for k in (1, 3)]
    ys, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        total = 0.0
        for c, y, w in zip(chunks, ys, weight):
            tables = net.tables().astype(float)
            answers = sum(tables[j][c[:, j:2 * quality_net.HOP + j:quality_net.STRIDE]] for j in range(quality_net.WIDTH)).max(axis=1) + net.bias
            deep = np.maximum(np.maximum(answers, 0) @ net.deep + net.deep_bias, 0)
            odds = np.concatenate((deep.max(axis=0), deep.mean(axis=0))) @ net.last + net.last_bias[0]
            total += w * math.log1p(math.exp(-odds if y else odds)) / len(ys)
        return total
    grads = quality_net._gradients(net, chunks, ys, weight)
    for p, g in zip(net, grads):
        flat, at = p.reshape(-1), int(np.abs(g).argmax())
        old, step = flat[at], 1e-3
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert g.reshape(-1)[at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-4)


def test_symbols():
    rng = random.Random(0)
    for _ in range(30):
        data = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + rng.choice(["", "word " * rng.randint(0, 30)]) + "tail"
        raw = np.frombuffer(data.encode(), np.uint8)
        want = []
        for i in range(len(data)):
            run = [w for w in (12, 48) if any(i - w + 1 - lag >= 0 and data[i - w + 1:i + 1] == data[i - w + 1 - lag:i + 1 - lag] for lag in range(2, 41))]
            want.append(ord(data[i]) + 256 * len(run))
        assert quality_net.symbols(raw).tolist() == want


def test_scores_by_stretches(monkeypatch):
    net = quality_net._first_net(np.random.default_rng(1))
    data = np.frombuffer(("some words and words and words and words and words, then OTHERS!! " * 90).encode(), np.uint8)
    whole = quality_net.score(data, net, net.tables())
    monkeypatch.setattr(quality_net, "STRETCH", 2 * quality_net.HOP)
    assert quality_net.score(data, net, net.tables()) == pytest.approx(whole, rel=1e-5)


def test_toxicity(spark, tables):
    path, rows, labels = tables
    docs, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        for s in r.spans:
            assert texts[r.doc_id][s.start:s.end].strip("abcdefghijklmnopqrstuvwxyz") == ""
    assert accuracy(got, labels, 1) > 0.95
    long = next(r for r in got if r.doc_id == 1002)
    assert long.predicted == 1 and [(s.start, s.end) for s in long.spans] == [(0, 7)]


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 and not r.spans for r in toxicity.toxicity(edge_docs, known).collect())
    assert toxicity.toxicity(no_docs, known).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    bounds = np.array([0, 4, 4, 5, 11])
    emission, steps = rng.normal(size=11), rng.normal(size=4)
    got, _, _ = toxicity.marginals(emission, bounds, steps)
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        weight = np.zeros((n, 2))
        for path in range(2**n):
            tags = [(path >> t) & 1 for t in range(n)]
            value = math.exp(sum(emission[a + t] * tags[t] for t in range(n)) + sum(steps[2 * tags[t - 1] + tags[t]] for t in range(1, n)))
            for t in range(n):
                weight[t, tags[t]] += value
        np.testing.assert_allclose(got[a:b], np.log(weight[:, 1] / weight[:, 0]) if n else [])


def test_tokens_and_offsets():
    texts = ["Bad-word, été!", "", "run", "on x" + "y" * 9]
    data, bounds = toxicity.buffers(pa.array(texts))
    tokens = toxicity.tokens_of(data, bounds)
    found = [[bytes(data[tokens.starts[i]:tokens.ends[i]]).decode() for i in range(a, b)] for a, b in zip(tokens.bounds, tokens.bounds[1:])]
    assert found == [["Bad", "word", "été"], [], ["run"], ["on", "xyyyyyyyyy"]]
    again = toxicity.tokens_of(*toxicity.buffers(pa.array(["bad"])))
    assert (again.features[0] == tokens.features[0]).all()


def test_sample(spark, tables):
    path, rows, labels = tables
    docs, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    texts, counts = labelled.sample(docs, known, "quality", 30, 5, 0)
    got = texts.collect()
    learn = {i: q for i, (q, _) in labels.items() if zlib.crc32(str(i).encode()) % 5}
    assert counts == {y: sum(q == y for q in learn.values()) for y in (0, 1)}
    assert 0 < len(got) <= 60 and {(r.text, r.y) for r in got} <= {(t, learn.get(i)) for i, t, *_ in rows}


def test_pipeline(spark, tables):
    """Every stage against plain Python on what its predecessor kept."""
    path, _, labels = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, path)
        before, got = [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]
        if name != "packing":
            assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
        if name == "quality classifier":
            assert set(got) <= set(before)
            kept = {r[0] for r in got}
            assert sum((i in kept) == bool(q) for i, (q, _) in labels.items() if i < 500) > 0.95 * 498
        if name == "n-gram Jaccard join":
            ids = {r[0] for r in before}
            assert set(got) <= set(before) and {r[0] for r in got} == ids - {i for i in ids if i and i >= 2000 and i - 2000 in ids}
        if name == "substring dedup":
            whole = sum(len((r[1] or "").split()) for r in before)
            assert sum(len((r[1] or "").split()) for r in got) <= whole and len(got) <= len(before)
        if name == "mixing sources to target weights":
            assert set(got) <= set(before)
            share = sum(len((r[1] or "").encode().split()) for r in got) / sum(len((r[1] or "").encode().split()) for r in before)
            assert 1.1 < share < 1.9
        if name == "packing":
            assert sum(r[2] for r in got) > sum(len((r[1] or "").encode().split()) for r in before)
        docs = spark.createDataFrame(got, after.schema)
    assert corpus_pipeline.run(spark, path).count() > 0


def test_pipeline_of_nothing(spark, tables, tmp_path):
    path, *_ = tables
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_match_sql(spark, sf_dir):
    from compare import check, connect
    from loamgrid.llm.queries import ORACLE_SQL, QUERIES
    con = connect(sf_dir)
    for name, sql in ORACLE_SQL.items():
        ok, message, _ = check(spark, con, QUERIES[name], sql, sf_dir)
        assert ok, message
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)} and mixing.ORACLE_SQL and repeats.LENGTH == 20
