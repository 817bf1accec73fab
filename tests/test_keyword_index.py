"""Stored keyword index, exact top-k with block maxima, English stems."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions.english import STOP_WORDS, with_stems
from loamgrid.operators import keyword_index as ki
from loamgrid.operators import postings as ps


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    rows = [(f"d{i:04}", " ".join(rng.choice(words, rng.integers(0, 6), p=odds / odds.sum())), " ".join(rng.choice(words, rng.integers(0, 120), p=odds / odds.sum())), "h" if i % 7 else None)
            for i in range(900)]
    rows += [(f"e{i:04}", "w1", "w1 w2 w3", "h") for i in range(300)] + [("x1", None, None, "h"), ("x2", "", "  ", "h"), ("x3", None, "only here", "h")]
    return spark.createDataFrame(rows, "id string, title string, content string, content_hash string")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(1, "w1 w2 w3"), (2, "w59 W58"), (3, "only"), (4, "nothing known"), (5, ""), (6, None), (7, " ".join(f"w{i}" for i in range(60))), (8, "w0 w0 w0")]
    return spark.createDataFrame(rows, "query_id long, text string")


FIELDS = {"title": 1.0, "content": 0.2}


def ranked(rows, score):
    return sorted((r.query_id, r["rank"], r.id, round(r[score], 9)) for r in rows)


@pytest.mark.parametrize("shard_rows, block, lot", [(20_000, 128, 5000), (40, 4, 2)])
def test_weighted_search(docs, questions, monkeypatch, shard_rows, block, lot):
    monkeypatch.setattr(ki, "QUESTIONS", lot)
    index = ki.build_index(docs, fields=FIELDS, shard_rows=shard_rows, block=block)
    for k in (1, 7, 40, 2000):
        want = ps.keyword_topk(questions, ps.term_uses(docs, fields=FIELDS), k).collect()
        assert ranked(ki.keyword_hits(index, questions, k).collect(), "keyword_score") == ranked(want, "keyword_score")


def test_bm25_search(docs, questions):
    docs = docs.fillna("", ["content"])
    index = ki.build_index(docs, fields={"content": 1.0}, scoring=ki.Bm25(), shard_rows=100, block=8)
    got, want = ki.search_index(index, questions, 25).collect(), ps.bm25_topk(questions, docs, 25).collect()
    assert [r[:3] for r in ranked(got, "score")] == [r[:3] for r in ranked(want, "bm25_score")]
    assert np.allclose([r[3] for r in ranked(got, "score")], [r[3] for r in ranked(want, "bm25_score")])


def test_rows_without_hash_and_empty_tables(docs, questions):
    index = ki.build_index(docs, fields=FIELDS, hashed="content_hash")
    found = ki.keyword_hits(index, questions, 2000).select("id").distinct()
    assert found.join(docs.where("content_hash is null"), "id").count() == 0 and found.count() > 900
    none = ki.build_index(docs.where("false"), fields=FIELDS)
    assert ki.keyword_hits(none, questions).count() == 0 and ki.keyword_hits(index, questions.where("false")).count() == 0


def test_search_leaves_the_texts_alone(docs, questions):
    index = ki.build_index(docs, fields=FIELDS)
    plan = ki.keyword_hits(index, questions)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "title" not in plan


def test_block_maxima_change_nothing():
    rng = np.random.default_rng(11)
    for trial in range(200):
        size, k = int(rng.integers(1, 400)), int(rng.integers(1, 30))
        whole, blocks = np.zeros(size), []
        for _ in range(rng.integers(1, 6)):
            docs = rng.permutation(size)[:rng.integers(1, size + 1)]
            weights = np.sort(np.round(rng.pareto(1.0, len(docs)) + 0.1, 1 if trial % 2 else 6))[::-1]
            whole[docs] += weights
            pieces = [(docs[a:a + 5], weights[a:a + 5]) for a in range(0, len(docs), 5)]
            tops = [w[0] for _, w in pieces] + [0.0]
            blocks += [(tops[i], tops[i + 1], *p) for i, p in enumerate(pieces)]
        blocks.sort(key=lambda b: -b[0])
        bounds = np.concatenate(([0], np.cumsum([len(b[2]) for b in blocks])))
        got, scores = ki._best(np.concatenate([b[2] for b in blocks]), np.concatenate([b[3] for b in blocks]), bounds,
                               np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks]), size, k)
        want = [i for i in np.lexsort((np.arange(size), -np.round(whole, 12))) if whole[i] > 0][:k]
        assert got.tolist() == want and np.allclose(scores, whole[want])


# Published examples of the rules.
STEMS = dict(consigned="consign", consistency="consist", consistently="consist", consolatory="consolatori", consolingly="consol", conspicuously="conspicu", conspirators="conspir",
             conspire="conspir", knackeries="knackeri", knaves="knave", kneaded="knead", knightly="knight", knitting="knit", knives="knive", happy="happi", happiness="happi", running="run",
             hoping="hope", hopping="hop", ties="tie", cries="cri", gas="gas", this="this", kiwis="kiwi", gaps="gap", by="by", say="say", luxuriated="luxuri", skies="sky",
             generate="generat", generously="generous", communism="communism", national="nation", relational="relat", university="univers", admission="admiss", fees="fee", feed="feed",
             agreed="agre", awe="awe", analogy="analog", controlling="control", roll="roll", adoption="adopt", enjoy="enjoy", abilities="abil", hopefulness="hope", inning="inning", x2y="x2y")


def test_stems(spark):
    rows = with_stems(spark.createDataFrame([(w,) for w in STEMS], "word string"), "word", "stem").collect()
    assert {r.word: r.stem for r in rows} == STEMS and "the" in STOP_WORDS and len(set(STOP_WORDS)) == 127


def test_english_search(spark):
    docs = spark.createDataFrame([("a", "Fees for students"), ("b", "The student's fee"), ("c", "Studying the rules"), ("d", "the of and")], "id string, content string")
    asked = spark.createDataFrame([(1, "the fee"), (2, "rule studies"), (3, "the and of"), (4, "STUDENT")], "query_id long, text string")
    index = ki.build_index(docs, fields={"content": 1.0}, english=True)
    assert sorted((r.query_id, r.id) for r in ki.keyword_hits(index, asked).collect()) == [(1, "a"), (1, "b"), (2, "c"), (4, "a"), (4, "b")]


def test_equal_sums_are_ties_however_they_come_about(spark):
    """20,000 uses at 0.2 weigh as much as 4,000 at 1.0; a sum of doubles is off by more than the digits that count."""
    docs = spark.createDataFrame([("a", "w1 " * 4000, "w2"), ("b", "", "w1 " * 20000 + "w2"), ("c", "w1 " * 2000, "w1 " * 10000 + "w2"), ("d", "w1 " * 4000, "")], "id string, title string, content string")
    index = ki.build_index(docs, fields=FIELDS, shard_rows=1)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w1")], "query_id long, text string")
    found = ki.keyword_hits(index, asked, 4).orderBy("query_id", "rank").collect()
    assert [r.id for r in found] == list("abcd") * 2
    assert len({r.keyword_score for r in found if r.query_id == 2}) == 1


def test_bm25_ties_are_sums_alike_in_nine_digits():
    nos, scores = ki._best(np.array([1, 0, 2]), np.array([5.0, 5.0 - 2e-11, 4.0]), np.array([0, 3]), np.array([5.0]), np.array([0.0]), 3, 2)
    assert nos.tolist() == [0, 1] and scores[0] < scores[1]


def test_blocks_asked_for_are_read_where_they_lie(docs, questions, monkeypatch):
    """The blocks of an index are as large as its texts: a search for few words does not deal them out again, whatever lots words are counted in."""
    monkeypatch.setattr(ki, "LOT_WORDS", 50)
    index = ki.build_index(docs, fields=FIELDS, shard_rows=100)
    found = ki.keyword_hits(index, questions, 7)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan.split("keyword_blocks_")[0] and "hashpartitioning(rep" not in plan
    assert ranked(found.collect(), "keyword_score") == ranked(ps.keyword_topk(questions, ps.term_uses(docs, fields=FIELDS), 7).collect(), "keyword_score")


def test_equal_weights_in_another_order_are_ties():
    """(a + b) + c and (c + b) + a round to different ninth digits."""
    a, b, c = 4.2010516786, 7.4160162688, 6.1261769301
    nos, scores = ki._best(np.array([0, 0, 0, 1, 1, 1]), np.array([a, b, c, c, b, a]), np.array([0, 6]), np.array([c]), np.array([0.0]), 2, 2)
    assert nos.tolist() == [0, 1] and scores[0] == scores[1]


def test_texts_that_are_null_have_no_part_in_the_mean_length(spark):
    docs = spark.createDataFrame([("a", "w1 w2"), ("b", "w1 w2 w3 w4"), ("c", ""), ("d", None)], "id string, content string")
    index = ki.build_index(docs, fields={"content": 1.0}, scoring=ki.Bm25())
    found = ki.search_index(index, spark.createDataFrame([(1, "w1")], "query_id long, text string")).collect()
    assert [(r.id, round(r.score, 12)) for r in found] == [("a", round(float(np.log(2.0)), 12)), ("b", round(float(np.log(2.0) * 2.2 / 3.1), 12))]


def test_entries_without_text_are_found_by_category_and_type(spark, sf_dir, tmp_path):
    """As in the SQL of the registered queries; with few entries every one that has a word asked for comes up."""
    from compare import check, connect
    from loamgrid.workload import load
    from loamgrid.workload.tables import Tables
    given, (queries, sql) = Tables(spark, sf_dir), load()
    empty = F.col("doc_id") % 5 == 3
    docs = given.documents.where("doc_id < 30").withColumns({"text": F.when(~empty, F.col("text")), "n_chars": F.when(empty, 0).otherwise(F.col("n_chars"))})
    asked = given.benchmark.withColumn("text", F.when(F.col("item_id") % 4 == 1, "policy de notice").otherwise(F.col("text")))
    for name, rows in {"documents": docs, "benchmark": asked, "labels": given.labels, "embeddings": given.embeddings}.items():
        rows.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    for name in "region nation customer supplier part orders lineitem events pages conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con = connect(str(tmp_path))
    for name in ("e3_keyword_topk", "e3_english_topk", "e5_rank_fusion", "e7_citations"):
        ok, message, _ = check(spark, con, queries[name], sql[name], str(tmp_path))
        assert ok, message
