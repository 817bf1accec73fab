"""Upserts, stores, ordered operators, request history, streams."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loamgrid.functions.text import sha256
from loamgrid.operators import dedupe as dd
from loamgrid.operators import frontier as fr
from loamgrid.operators import listing as ls
from loamgrid.operators import ordered
from loamgrid.operators import quality as qu
from loamgrid.operators import requests as rq
from loamgrid.operators import upsert as up
from loamgrid.sources import readers, sinks
from loamgrid.streaming import flows as fl

T0 = datetime(2024, 1, 1)
ENTRY = ("id string, source_url string, source_type string, chunk_index int, content string, namespace string, content_hash string, "
         "created_at timestamp, updated_at timestamp, last_scraped_at timestamp")


def entries(spark, *rows):
    df = spark.createDataFrame([(*r, None, T0, T0, T0) for r in rows], ENTRY)
    return df.withColumn("content_hash", sha256(F.col("content")))


def crawl(spark, *rows):
    df = spark.createDataFrame(list(rows), "source_url string, source_type string, chunk_index int, content string, namespace string")
    return up.stamp_hash(df)


def test_upsert_and_repeat(spark):
    old = entries(spark, ("1", "u", "webpage", 0, "same", "a"), ("2", "u", "webpage", 1, "before", "a"), ("3", "u", "webpage", 2, "gone", "a"))
    new = crawl(spark, ("u", "webpage", 0, "same", "a"), ("u", "webpage", 1, "after", "b"), ("v", "webpage", 0, "fresh", "a"))
    plan = up.plan_upsert(new, old)
    assert sorted((r.source_url, r.chunk_index, r.action) for r in plan.collect()) == [("u", 0, "touch"), ("u", 1, "update"), ("v", 0, "insert")]
    later = T0 + timedelta(days=1)
    table = up.apply_upsert(plan, old, later)
    got = {r.content: r for r in table.collect()}
    assert set(got) == {"same", "after", "gone", "fresh"}
    assert got["after"].id == "2" and got["after"].updated_at == later and got["after"].created_at == T0
    assert got["same"].updated_at == T0 and got["same"].last_scraped_at == later and got["gone"].last_scraped_at == T0
    again = up.plan_upsert(new, table)
    assert {r.action for r in again.collect()} == {"touch"}
    assert {r.action for r in up.plan_upsert(new, table, force=True).collect()} == {"update"}
    assert [(r.id, r.namespace) for r in up.moved_vectors(table, old).collect()] == [("2", "a")]


def test_page_registry_revives(spark):
    pages = spark.createDataFrame([("p", "u", "old", "h", 1, "synced", "success", T0, T0)],
                                  "id string, url string, title string, content_hash string, chunk_count int, sync_status string, crawl_status string, last_scraped_at timestamp, deleted_at timestamp")
    chunks = crawl(spark, ("u", "webpage", 0, "x", "a"), ("u", "webpage", 1, "y", "a")).withColumn("page_title", F.lit("new"))
    row = up.upsert_pages(chunks, pages, T0).first()
    assert (row.id, row.title, row.chunk_count, row.deleted_at) == ("p", "new", 2, None)
    swapped = crawl(spark, ("u", "webpage", 1, "x", "a"), ("u", "webpage", 0, "y", "a")).withColumn("page_title", F.lit("new"))
    assert up.upsert_pages(swapped, pages, T0).first().content_hash != row.content_hash
    assert up.upsert_pages(chunks.orderBy(F.desc("chunk_index")), pages, T0).first().content_hash == row.content_hash


@pytest.mark.parametrize("gap,label", [(4, "healthy"), (5, "degraded"), (6, "degraded")])
def test_namespace_health(spark, gap, label):
    e = spark.range(10).select(F.lit("n").alias("namespace"))
    v = spark.range(10 + gap).select(F.lit("n").alias("namespace"))
    assert qu.namespace_health(e, v).first().sync_health == label
    assert qu.sync_gap(e, v).first().in_sync == (gap <= 5)
    one_sided = {r.namespace: r.sync_health for r in qu.namespace_health(e.withColumn("namespace", F.lit("a")), v.withColumn("namespace", F.lit("b"))).collect()}
    assert one_sided == {"a": "unknown", "b": "orphaned"}


def test_ordered_against_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc") if i % 3 else "hot", i, rng.randint(0, 9), rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v int, m int").cache()
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    pairs = [(ordered.running_sum(df, ["k"], ["o"], F.col("v"), "x"), F.sum("v").over(upto)), (ordered.number_rows(df, ["k"], ["o"], "x"), F.row_number().over(w)),
             (ordered.previous(df, ["k"], ["o"], F.col("m"), "x"), F.lag("m").over(w)), (ordered.previous(df, ["k"], ["o"], F.col("m"), "x", following=True), F.lead("m").over(w)),
             (ordered.running_last(df, ["k"], ["o"], F.col("m"), "x"), F.last("m", ignorenulls=True).over(upto))]
    for got, want in pairs:
        assert sorted((r.k, r.o, str(r.x)) for r in got.collect()) == sorted((r.k, r.o, str(r.x)) for r in df.withColumn("x", want).collect())


def burst(spark):
    times = [0] * 19 + [30, 59.999, 60, 60.001, 61, 200, 259, 260, 261]
    rows = [("a", i, T0 + timedelta(seconds=s)) for i, s in enumerate(times)] + [("b", 100 + i, T0 + timedelta(seconds=7 * i)) for i in range(60)]
    return spark.createDataFrame(rows, "who string, event_id int, ts timestamp")


def windows_in_python(rows, span=60.0):
    state, out = {}, {}
    for who, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        opened, count = state.get(who, (None, 0))
        if opened is None or (ts - opened).total_seconds() > span:
            opened, count = ts, 0
        state[who] = (opened, count + 1)
        out[event] = count + 1
    return out


def test_fixed_windows(spark):
    df = burst(spark)
    want = windows_in_python([tuple(r) for r in df.collect()])
    got = {r.event_id: (r.request_no, r.refused) for r in rq.fixed_windows(df, "who", "ts", "event_id").collect()}
    assert got == {e: (n, n > 20) for e, n in want.items()}
    assert any(refused for _, refused in got.values())


def test_recent_requests(spark):
    df = burst(spark)
    rows = [tuple(r) for r in df.collect()]
    want = {e: sum(1 for w2, _, t2 in rows if w2 == w and t - timedelta(seconds=60) <= t2 <= t) for w, e, t in rows}
    assert {r.event_id: r.requests for r in rq.recent_requests(df, "who", "ts", "event_id", block_seconds=60).collect()} == want


def test_cache_rules_differ(spark):
    df = spark.createDataFrame([("k", i, T0 + timedelta(minutes=40 * i)) for i in range(4)], "key string, event_id int, ts timestamp")
    renewed = {r.event_id: r.cache_hit for r in rq.cache_hits(df, "key", "ts", "event_id").collect()}
    fixed = {r.event_id: r.cache_hit for r in rq.cache_hits(df, "key", "ts", "event_id", renewed_on_read=False).collect()}
    assert renewed == {0: False, 1: True, 2: True, 3: True} and fixed == {0: False, 1: True, 2: False, 3: True}


def test_fixed_windows_stream_equals_batch(spark, tmp_path):
    df = burst(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fl.limited_requests(fl.read_events(spark, str(tmp_path / "in"), df.schema), "who", limit=20)
    fl.run_to_end(fl._start(stream, str(tmp_path / "state"), "append", path=str(tmp_path / "out")))
    got = {r.event_id: r.request_no for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id: r.request_no for r in rq.fixed_windows(df, "who", "ts", "event_id").collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    for n, seconds in enumerate(([0, 10, 100000], [20, 99000], [300000])):
        rows = [(f"{n}{i}", T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = fl.tumbling_counts(fl.read_events(spark, str(tmp_path / "in"), "k string, ts timestamp"), [], width="1 hour", watermark="30 minutes")
        fl.run_to_end(fl._start(counts, str(tmp_path / "state"), "append", path=str(tmp_path / "out")))
    got = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[T0] == 2 and got[T0 + timedelta(hours=27)] == 2


def test_ingest_stream_is_repeatable(spark, tmp_path):
    html = "<html><body><main><h1>Fee table {0}</h1>" + "".join(f"<p>Paragraph {{0}} {i} about the fee of a program and its payment</p>" for i in range(8)) + "</main></body></html>"
    rows = [(i, f"https://x.org/{i}", html.format(i), T0 + timedelta(seconds=i)) for i in range(3)] + [(9, "https://x.org/copy", html.format(0), T0 + timedelta(seconds=9))]
    schema = "page_id long, url string, html string, fetched_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        pages = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        fl.run_to_end(fl.ingest_stream(pages, str(tmp_path / "changes"), str(tmp_path / run)))
        table = fl.current_chunks(spark, str(tmp_path / "changes"))
        assert table.select("source_url").distinct().count() == 3
        assert table.count() == table.select("source_url", "chunk_index").distinct().count()


def test_frontier(spark):
    links = spark.createDataFrame([("https://x.org/a", 0, 3), ("https://x.org/faculty/b", 0, 5), ("https://x.org/a", 4, 1), ("https://x.org/fee", 0, 7), ("https://x.org/known", 0, 1)],
                                  "link string, depth int, priority int")
    known = spark.createDataFrame([("https://x.org/known",)], "url string")
    got = {r.url: (r.depth, r.priority) for r in fr.expand_frontier(links, known).collect()}
    assert got == {"https://x.org/a": (5, 2), "https://x.org/faculty/b": (1, 1), "https://x.org/fee": (1, 2)}
    hosts = spark.createDataFrame([("x.org",)], "host string")
    urls = ["https://x.org/ok", "https://x.org/a.JPG", "https://y.org/ok", "https://x.org/login", "https://x.org/private/1", "https://x.org/p/q/secret"]
    df = spark.createDataFrame([(u,) for u in urls], "link string")
    assert [r.link for r in fr.admit_urls(df, hosts, disallow=["/private", "/p/*/secret"]).collect()] == ["https://x.org/ok"]


def test_failure_categories(spark):
    df = spark.createDataFrame([("HTTP 404",), ("The operation timeout",), ("HTTP 500",), (None,)], "m string")
    assert [r[0] for r in df.select(fr.error_category(F.col("m"))).collect()] == ["404", "timeout", "other", "other"]


def test_text_corpus(spark, tmp_path):
    for folder, name, text in (("cs", "fee-list.txt", "a\nb"), ("bba", "my notes.md", "c"), ("bba", "skip.pdf", "d")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = sorted(tuple(r) for r in readers.read_text_corpus(spark, str(tmp_path)).collect())
    assert got == [("bba", "my notes.md", "My Notes", "c"), ("cs", "fee-list.txt", "Fee List", "a\nb")]


def test_vector_sink_keeps_other_vectors(spark, tmp_path):
    def rows(*r):
        return spark.createDataFrame(list(r), "id string, namespace string, embedding array<float>")
    path = str(tmp_path / "v")
    sinks.write_vectors(rows(*[(str(i), "b", [float(i)]) for i in range(10)], ("1", "a", [1.0])), path, buckets=2)
    sinks.write_vectors(rows(("3", "b", [7.0]), ("3", "b", [6.0]), ("11", "b", [11.0]), ("1", "c", [5.0])), path, buckets=2)
    got = sorted((r.namespace, int(r.id), r.embedding[0]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, 1.0), *[("b", i, 7.0 if i == 3 else float(i)) for i in range(10)], ("b", 11, 11.0), ("c", 1, 5.0)]


def test_repeated_keys_do_not_multiply(spark):
    stored = spark.createDataFrame([("1", "u", "webpage", 0, "h", "n", T0)], "id string, source_url string, source_type string, chunk_index int, content_hash string, namespace string, created_at timestamp")
    new = spark.createDataFrame([("u", "webpage", 0, "h"), ("u", "webpage", 0, "i"), ("v", "webpage", 0, "j"), ("v", "webpage", 0, "j")], "source_url string, source_type string, chunk_index int, content_hash string")
    assert sorted((r.source_url, r.action) for r in up.plan_upsert(new, stored).collect()) == [("u", "update"), ("v", "insert")]
    df = spark.createDataFrame([("1", "a", "b")], "id string, x string, y string")
    assert [tuple(r) for r in ls.patch(df, spark.createDataFrame([("1", "p", None), ("1", "q", None)], "id string, x string, y string"), ["x", "y"]).collect()] == [("1", "q", "b")]
    asked = spark.createDataFrame([("1", False, None, None)], "id string, resolved boolean, resolved_entry_id string, resolved_at timestamp")
    updates = spark.createDataFrame([("1", False, None), ("1", True, "e")], "id string, resolved boolean, resolved_entry_id string")
    assert [(r.resolved, r.resolved_entry_id) for r in ls.resolve_questions(asked, updates, T0).collect()] == [(True, "e")]


def test_listings_have_no_hidden_bound(spark):
    df = spark.range(700).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("u").alias("source_url"),
                                 F.col("id").cast("int").alias("chunk_index"), F.lit(T0).alias("updated_at"))
    assert ls.list_entries(df, limit=650).count() == 650 and ls.chunks_of(df, "u").count() == 700


def test_defaults_compare_whole_texts(spark):
    head = "same opening " * 200
    df = spark.createDataFrame([(1, head + "one"), (2, head + "two"), (3, head + "two")], "page_id long, content string")
    assert dd.drop_near_duplicate_pages(df, order=["page_id"]).count() == 2


def test_patch_and_feedback(spark):
    df = spark.createDataFrame([("1", "a", "b"), ("2", "c", None)], "id string, x string, y string")
    new = spark.createDataFrame([("1", None, "z"), ("9", "q", "q")], "id string, x string, y string")
    assert sorted(tuple(r) for r in ls.patch(df, new, ["x", "y"]).collect()) == [("1", "a", "z"), ("2", "c", None)]
    conv = spark.createDataFrame([("c1", "s1", None), ("c2", "s2", "thumbs_up")], "id string, session_id string, feedback string")
    fb = spark.createDataFrame([("c1", "s1", "thumbs_up", T0), ("c1", "s1", "thumbs_down", T0 + timedelta(1)), ("c1", "s1", "bad", T0 + timedelta(2)), ("c2", "other", "thumbs_down", T0)],
                               "conversation_id string, session_id string, feedback string, created_at timestamp")
    assert sorted(tuple(r) for r in ls.apply_feedback(conv, fb).collect()) == [("c1", "s1", "thumbs_down"), ("c2", "s2", "thumbs_up")]
