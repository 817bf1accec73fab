"""Retrieval operators against plain Python on small rows."""
import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import context as cx
from loamgrid.operators import dedupe as dd
from loamgrid.operators import postings as ps
from loamgrid.operators import retrieval as rt
from loamgrid.operators import rerank as rr

RANKED = "query_id int, id string, rank int, rrf_score double, score double, keyword_score double"


def shingles(text, k=5):
    low = text.lower()
    return {low[i:i + k] for i in range(len(low) - k + 1)}


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def greedy(texts, threshold=0.70):
    kept, leader = [], {}
    for i, t in texts:
        leader[i] = next((j for j, u in kept if similarity(t, u) > threshold), i)
        if leader[i] == i:
            kept.append((i, t))
    return leader


def corpus(seed=3, n=60):
    rng = np.random.default_rng(seed)
    words = ["alpha", "bravo", "carbon", "delta", "ember", "fjord", "gamma", "hollow", "ivory", "jungle"]
    base = [" ".join(rng.choice(words, 40)) for _ in range(8)]
    out = []
    for i in range(n):
        text = base[int(rng.integers(8))].split()
        for _ in range(int(rng.integers(0, 12))):
            text[int(rng.integers(len(text)))] = str(rng.choice(words)) + str(i)
        out.append((i, " ".join(text)))
    return out + [(n, "abc"), (n + 1, "abc"), (n + 2, "xy"), (n + 3, ""), (n + 4, out[0][1])]


def test_ranked_dedupe_is_greedy(spark):
    rows = corpus()
    df = spark.createDataFrame([(q, i + 1, t) for q in (1, 2) for i, t in rows], "query_id int, rank int, content string")
    once = dd.dedupe_ranked(df, prefix=None)
    want = {i + 1 for i, j in greedy(rows).items() if i == j}
    for q in (1, 2):
        assert {r["rank"] for r in once.where(F.col("query_id") == q).collect()} == want
    assert dd.dedupe_ranked(once, prefix=None).count() == once.count()


def test_corpus_dedupe_equals_greedy(spark):
    rows = corpus(seed=5, n=120)
    df = spark.createDataFrame(rows, "id int, content string")
    got = {r["id"]: r["kept_id"] for r in dd.near_duplicates(df, prefix=None).collect()}
    want = greedy(rows)
    assert {i for i, k in got.items() if i == k} == {i for i, k in want.items() if i == k}
    texts = dict(rows)
    assert all(similarity(texts[i], texts[k]) > 0.70 for i, k in got.items())


def test_corpus_dedupe_all_distinct(spark):
    df = spark.createDataFrame([(i, hashlib.md5(str(i).encode()).hexdigest() * 2) for i in range(20)], "id int, content string")
    assert dd.near_duplicates(df).where("id <> kept_id").count() == 0


def test_corpus_dedupe_takes_few_rounds(spark, monkeypatch):
    """A chain of rows that share bands with their neighbours but are not similar: its length is no number of rounds."""
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(640)]
    df = spark.createDataFrame([(i, " ".join(words[10 * i:10 * i + 40])) for i in range(60)], "id int, content string")
    written, cut = [], dd.cut_lineage
    monkeypatch.setattr(dd, "cut_lineage", lambda rows: written.append(1) or cut(rows))
    assert dd.near_duplicates(df).where("id <> kept_id").count() == 0
    assert len(written) < 40


def test_corpus_dedupe_writes_few_pairs_of_unlike_rows(spark, monkeypatch):
    """Rows of one vocabulary agree in bands without being similar; such pairs grow with the square of the rows and are not written."""
    rng = np.random.default_rng(11)
    words = [hashlib.md5(str(i).encode()).hexdigest()[:20] for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 220))) for i in range(40)], "id int, content string")
    pairs, cut = [], dd.cut_lineage

    def counted(rows):
        out = cut(rows)
        pairs.extend([out.count()] if out.columns == ["_id", "_head"] else [])
        return out
    monkeypatch.setattr(dd, "cut_lineage", counted)
    assert dd.near_duplicates(df).where("id <> kept_id").count() == 0
    assert sum(pairs) < 40


def test_corpus_dedupe_in_lots_of_bands(spark, monkeypatch):
    rows = corpus(seed=7, n=50)
    monkeypatch.setattr(dd, "LOT_ROWS", 60 * len(rows))
    monkeypatch.setattr(dd, "MOST_SENT", 5)
    got = {r["id"]: r["kept_id"] for r in dd.near_duplicates(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert {i for i, k in got.items() if i == k} == {i for i, j in greedy(rows).items() if i == j}
    texts = dict(rows)
    assert len(got) == len(rows) and all(similarity(texts[i], texts[k]) > 0.70 for i, k in got.items())


def test_corpus_dedupe_keeps_rows_without_a_text(spark):
    df = spark.createDataFrame([(1, None), (2, "alpha bravo carbon"), (3, None), (4, "")], "id int, content string")
    assert {(r["id"], r["kept_id"]) for r in dd.near_duplicates(df).collect()} == {(1, 1), (2, 2), (3, 1), (4, 1)}


def test_shuffles_are_emptied(spark):
    from loamgrid.session import shuffles_emptied
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    with pytest.raises(ValueError), shuffles_emptied(spark):
        assert spark.conf.get(setting) == "true"
        raise ValueError
    assert spark.conf.get(setting, None) == before


def vectors(spark, seed=1, n=300, q=40, dims=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype("float32")
    v[0] = 0
    v[5] = v[6]
    asked = rng.normal(size=(q, dims)).astype("float32")
    ns = [f"n{i % 3}" for i in range(n)]
    stored = spark.createDataFrame([(f"v{i:03d}", ns[i], [float(x) for x in v[i]]) for i in range(n)], "id string, namespace string, embedding array<float>")
    lists = [(i, 0, f"n{j}", j == i % 3, [float(x) for x in asked[i]]) for i in range(q) for j in range(3)]
    queries = spark.createDataFrame(lists, "query_id int, variant_no int, namespace string, is_primary boolean, embedding array<float>")
    unit = lambda m: m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    want = {}
    scores = unit(asked) @ unit(np.where(v == 0, 1e-30, v)).T
    for i in range(q):
        for j in range(3):
            own = sorted(((round(scores[i, c], 9), f"v{c:03d}") for c in range(1, n) if c % 3 == j), key=lambda p: (-p[0], p[1]))[:7]
            for s, c in own:
                if s >= 0.10:
                    want[(i, c)] = round(s + (0.15 if j == i % 3 else 0), 6)
    return queries, stored, want


def test_vector_topk_both_ways(spark):
    queries, stored, want = vectors(spark)
    for options in ({}, {"max_broadcast": 0, "block_vectors": 30, "block_queries": 7}):
        got = {(r.query_id, r.id): round(r.score, 6) for r in rt.vector_topk(queries, stored, k=7, **options).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.2), (2, "a", 0.5)], "query_id int, id string, score double")
    k = spark.createDataFrame([(1, "c", 0.8), (1, "d", 0.4)], "query_id int, id string, keyword_score double")
    got = {(r.query_id, r.id): (round(r.rrf_score, 9), r["rank"]) for r in rt.rrf(v, k).collect()}
    assert got == {(1, "a"): (round(1 / 61, 9), 2), (1, "b"): (round(1 / 62, 9), 3), (1, "c"): (round(1 / 63 + 1 / 61, 9), 1), (1, "d"): (round(1 / 62, 9), 4),
                   (2, "a"): (round(1 / 61, 9), 1)}


def test_confidence_bands(spark):
    queries = spark.createDataFrame([(i,) for i in range(7)], "query_id int")
    rows = []
    for q, (n, evidence, score) in enumerate([(0, False, 0), (1, True, 1 / 61), (2, False, 1 / 61), (5, True, 1 / 61), (5, False, 1 / 61), (2, True, 0.005), (4, True, 1 / 61)]):
        rows += [(q, f"{i}", i + 1, score, None, 0.3 if evidence and i == 0 else None) for i in range(n)]
    got = {r.query_id: r.confidence for r in rt.confidence(queries, spark.createDataFrame(rows, RANKED)).collect()}
    assert got == {0: "no_data", 1: "low", 2: "medium", 3: "high", 4: "low", 5: "low", 6: "medium"}


def test_merge_and_citations(spark):
    late = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    early = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    assert sorted((r["rank"], r.id) for r in rt.merge_by_precedence([late, early]).collect()) == [(1, "b"), (2, "c"), (3, "a")]
    rows = spark.createDataFrame([(1, i, f"t{i}", u, "p", "c") for i, u in enumerate(["http://a", "", "http://b", "http://a", None, "ftp://x"] + ["http://z"] * 7, 1)],
                                 "query_id int, rank int, title string, source_url string, page_type string, category string")
    assert [(r.citation_no, r.title) for r in rt.citations(rows).orderBy("citation_no").collect()] == [(1, "t1"), (2, "t3"), (3, "t7")]


def context_in_python(rows, budget):
    parts, used, seen = [], 0, set()
    for text in rows:
        key = "".join(text[:100].lower().split())
        if key in seen:
            continue
        seen.add(key)
        entry = f"--- Context {len(parts) + 1} [Source: t | c] ---\n{text}"
        if used + len(entry) > budget:
            rest = budget - used
            if rest > 200:
                cut = entry[:rest]
                end = max(cut.rfind("."), cut.rfind("?"))
                parts.append((cut[:end + 1] if end > 0 else cut) + "\n[truncated for context budget]")
            break
        parts.append(entry)
        used += len(entry)
    return "\n\n".join(parts)


def test_context_budget(spark):
    head = len("--- Context 1 [Source: t | c] ---\n")
    cases = [["a" * (1000 - head)], ["a" * (1001 - head)], ["a" * (800 - head), "b. " * 200], ["a" * (799 - head), "b. " * 200], ["x" * 50, "X " * 50, "y. z? " * 300, "w" * 10],
             ["a" * (799 - head), "b" * 400], []]
    rows = [(q, i, f"{q}-{i}", "t", "c", "", text) for q, case in enumerate(cases) for i, text in enumerate(case, 1)]
    df = spark.createDataFrame(rows, "query_id int, final_rank int, id string, title string, category string, source_url string, content string")
    got = {r.query_id: r.context for r in cx.build_context(df, 1000).collect()}
    for q, case in enumerate(cases):
        assert got.get(q, "") == context_in_python(case, 1000), q
        assert len(got.get(q, "").replace("\n[truncated for context budget]", "").replace("\n\n---", "---")) <= 1000


def test_keyword_topk_and_recent(spark):
    docs = spark.createDataFrame([("a", "fee table", "c", "p", "fee fee cost", datetime(2024, 1, 1)), ("b", "other", "c", "p", "cost", datetime(2024, 1, 2)),
                                  ("z", "none", "c", "p", "none", datetime(2024, 1, 3))], "id string, title string, category string, page_type string, content string, updated_at timestamp")
    queries = spark.createDataFrame([(1, "Fee? cost!"), (2, "unknown")], "query_id int, text string")
    hits = {r.id: round(r.keyword_score, 9) for r in ps.keyword_topk(queries, ps.term_uses(docs)).collect()}
    assert hits == {"a": round(1.6 / 2.6, 9), "b": round(0.2 / 1.2, 9)}
    stored = {r.id: round(r.keyword_score, 9) for r in ps.keyword_topk(queries, ps.postings(docs)).collect()}
    assert stored == hits
    rest = ps.keyword_or_recent(queries, docs, ps.keyword_topk(queries, ps.term_uses(docs), 15), recent=2).where("query_id = 2").orderBy("rank").collect()
    assert [(r.id, r.score) for r in rest] == [("z", 0.5), ("b", 0.5)]


def test_rerank_features(spark):
    as_of = datetime(2024, 1, 31)
    df = spark.createDataFrame([(1, "a", "latest fee notice", 0.2, "Fee notice", "the latest fee notice is out", "notice", ["notice", "x"], datetime(2024, 1, 30, 12)),
                                (1, "b", "latest fee notice", 0.01, "Other", "nothing", "general", [], None)],
                               "query_id int, id string, query_text string, rrf_score double, title string, content string, page_type string, keywords array<string>, updated_at timestamp")
    got = {r.id: r for r in rr.rerank(df.withColumn("score", F.lit(None).cast("double")), as_of).collect()}
    want = 0.25 * 1.0 + 0.20 * 1.0 + 0.20 * (2 / 3 * 1.8) + 0.15 * 0.35 + 0.10 * (1 / 3 * 0.3) + 0.07 * 0.25 + 0.03 * 0.30
    assert abs(got["a"].rerank_score - want) < 1e-9 and got["a"].final_rank == 1
    assert abs(got["b"].rerank_score - 0.25 * 0.1) < 1e-9


def staged_inputs(spark):
    texts = {"c1": "fee structure for nursing students", "c2": "hostel rooms and dining", "c3": "fee payment dates", "c4": "library opening hours", "c5": "fee refund policy", "c6": "sports and games"}
    chunks = spark.createDataFrame([(i, t, t, f"http://x/{i}", "general", "General", datetime(2024, 1, 1), ns) for (i, t), ns in zip(texts.items(), ["finance", "hostel", "finance", "general", "finance", "general"])],
                                   "id string, title string, content string, source_url string, page_type string, category string, updated_at timestamp, namespace string")
    vecs = rt.embed_text(chunks.select("id", "namespace", "content"), "content", 64).select("id", "namespace", "embedding")
    queries = spark.createDataFrame([(1, "fee structure payment refund library sports"), (2, "hostel rooms"), (3, "quasar nebula"), (4, "")], "query_id int, text string")
    return queries, chunks, vecs


def test_staged_retrieval(spark):
    queries, chunks, vecs = staged_inputs(spark)
    rows, outcome = rt.retrieve_staged(queries, chunks, vecs, ps.term_uses(chunks), dims=64)
    level = {r.query_id: r for r in outcome.collect()}
    assert set(level) == {1, 2, 3, 4}
    assert level[1].confidence == "high" and level[1].stage == 1
    assert level[3].confidence == "no_data" and level[4].confidence == "no_data"
    listed = rows.collect()
    assert {r.query_id for r in listed} == {q for q, r in level.items() if r.confidence != "no_data"}
    for q in {r.query_id for r in listed}:
        mine = [r for r in listed if r.query_id == q]
        assert len({r.id for r in mine}) == len(mine) and sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))


def test_chunks_are_embedded_once(spark, monkeypatch):
    """The stages of a search read stored vectors; they do not embed the texts of all chunks again."""
    from loamgrid.plans import answer

    class Seen(Exception):
        pass

    def staged(queries, chunks, vectors, *rest, **options):
        raise Seen(vectors)
    monkeypatch.setattr(answer, "retrieve_staged", staged)
    chunks = spark.createDataFrame([("a", "n", "some words"), ("b", "n", "")], "id string, namespace string, content string")
    with pytest.raises(Seen) as seen:
        answer.answer_context(spark.createDataFrame([(1, "words")], "query_id long, text string"), chunks, datetime(2024, 1, 31), index=object())
    vectors = seen.value.args[0]
    assert "UDF" not in vectors._jdf.queryExecution().optimizedPlan().toString() and [r.id for r in vectors.collect()] == ["a"]
