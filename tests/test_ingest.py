"""Page versions, removed chunks and the change log; profile and document branches of ingestion."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import upsert as up
from loamgrid.plans.ingest import page_chunks
from loamgrid.streaming import flows as fl

T0 = datetime(2024, 1, 1)
SCHEMA = "page_id long, url string, html string, fetched_at timestamp"


def page(word, paragraphs):
    body = "".join(f"<p>{word} paragraph {i} says what a student has to know, in many words. {'More of it. ' * 60}</p>" for i in range(paragraphs))
    return f"<html><body><main><h1>About {word} things</h1>{body}</main></body></html>"


def row(number, url, word, paragraphs, hour):
    return number, url, page(word, paragraphs), T0 + timedelta(hours=hour)


def words_of(table):
    """Per source: the chunk numbers and the words of the page versions they come from."""
    out = {}
    for r in table.collect():
        found = {w for w in ("first", "second", "third", "other", "older") if w in r.content}
        out.setdefault(r.source_url, []).append((r.chunk_index, found))
    return {u: sorted(c) for u, c in out.items()}


@pytest.mark.parametrize("compact", [False, True])
def test_versions_and_removed_chunks(spark, tmp_path, compact):
    changes = str(tmp_path / "changes")
    write = fl.write_changes(changes, buckets=4)
    a, b = "https://x.org/a", "https://x.org/b"
    write(spark.createDataFrame([row(1, a, "first", 9, 1), row(2, b, "other", 2, 1), row(3, a, "second", 5, 2)], SCHEMA), 0)
    state = words_of(fl.current_chunks(spark, changes))
    second = len(state[a])
    assert all(found == {"second"} for _, found in state[a]) and [n for n, _ in state[a]] == list(range(second)) and second > 1
    assert all(r.keywords for r in fl.current_chunks(spark, changes).collect())
    if compact:
        fl.compact_changes(spark, changes)
    write(spark.createDataFrame([row(4, a, "third", 1, 5), row(5, a, "older", 9, 3)], SCHEMA), 1)
    for _ in range(2):                                       # a batch that is repeated changes nothing
        state = words_of(fl.current_chunks(spark, changes))
        assert state[a] == [(0, {"third"})] and all(found == {"other"} for _, found in state[b])
        write(spark.createDataFrame([row(4, a, "third", 1, 5), row(5, a, "older", 9, 3)], SCHEMA), 1)
    write(spark.createDataFrame([row(6, a, "older", 9, 4), row(7, b, "other", 2, 6)], SCHEMA), 2)      # fetched before what is stored; unchanged
    assert words_of(fl.current_chunks(spark, changes)) == state
    if compact:
        fl.compact_changes(spark, changes)
        assert words_of(fl.current_chunks(spark, changes)) == state
    assert spark.read.parquet(f"{changes}/log").where("batch_id = 2 and action not in ('mark')").count() == 0
    write(spark.createDataFrame([row(8, a, "second", 5, 9)], SCHEMA), 3)                              # longer again
    assert len(words_of(fl.current_chunks(spark, changes))[a]) == second


def test_upsert_takes_whole_versions(spark):
    new = up.stamp_hash(spark.createDataFrame([("u", "w", i, f"one {i}", T0) for i in range(4)] + [("u", "w", i, f"two {i}", T0 + timedelta(hours=1)) for i in range(3)],
                                              "source_url string, source_type string, chunk_index int, content string, fetched_at timestamp")).withColumn("namespace", F.lit("n"))
    old = up.stamp_hash(spark.createDataFrame([(f"id{i}", "u", "w", i, f"zero {i}", "n", T0) for i in range(4)],
                                              "id string, source_url string, source_type string, chunk_index int, content string, namespace string, created_at timestamp"))
    plan = up.plan_upsert(new, old, version=["fetched_at"])
    assert sorted((r.chunk_index, r.content, r.action) for r in plan.collect()) == [(i, f"two {i}", "update") for i in range(3)]
    assert [r.id for r in up.lost_chunks(plan, old).collect()] == ["id3"]


def test_profiles_and_documents(spark):
    profile = "<body><h4>Jo Doe</h4><table><tr><td>Designation: Senior Lecturer</td></tr></table><p>Mail jo.doe@x.org at any time of the week, or come to the office.</p>" + "<!-- " + "x" * 200 + " --></body>"
    rows = [(1, "https://x.org/profile.php?id=4", profile, None), (2, "https://x.org/3cce6efe_fee%20list.pdf", None, "The   fees\n of all programs are listed here. " * 5),
            (3, "https://x.org/page", page("third", 1), None), (4, "https://x.org/short.pdf", None, "too short"), (5, "https://x.org/none", None, None)]
    chunks = page_chunks(spark.createDataFrame(rows, "page_id int, url string, html string, body string"), text="body", with_keywords=False).collect()
    found = {r.parent_page_id: r for r in chunks if r.chunk_index == 0}
    assert set(found) == {"1", "2", "3"}
    assert found["1"].title.startswith("Teacher: Jo Doe [1/") and "jo.doe@x.org" in found["1"].content and found["1"].page_type == "faculty"
    assert found["2"].title.startswith("fee list (PDF) [1/") and found["2"].content.startswith("The fees of all programs")
    assert found["3"].title.startswith("About third things [1/")
