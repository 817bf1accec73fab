"""Resampling, token files, filter audit and the parallel sort against plain Python."""
import glob
import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import filter_audit, regular_sort, target_sampling, token_files
from loamgrid.session import shared_path


@pytest.fixture(scope="module")
def some_labels(spark):
    rows = [(7, 1, 0), (8, 0, 1), (20, 1, 1), (20, 0, 0), (100, None, 1), (101, 1, None), (None, 1, 1), (13, 1, 0), (99999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("n", F.lit("other"))


# ---- parallel sort ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("samples", [1 << 14, 40, 5])
@pytest.mark.parametrize("segment_rows", [50, 100_000])
def test_parallel_sort(spark, samples, segment_rows):
    rng = random.Random(samples)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(-50, 50), rng.randrange(4), i, rng.randrange(1, 9)) for i in range(3000)]
    table = spark.createDataFrame(rows, "a long, b long, i long, w long").repartition(13)
    keys = {"ka": -F.col("a"), "kb": F.col("b")}
    runs = regular_sort.sorted_runs(table, keys, segment_rows, samples)
    by_row, by_weight = regular_sort.segment_sums(runs), regular_sort.segment_sums(runs, "w")
    assert sum(by_row) == 3000 and sum(by_weight) == sum(r[3] for r in rows)
    if samples > 3000:
        assert max(by_row) <= 3000 / len(by_row) + 14 and len(by_row) >= 8        # a key of 40 % of the rows is cut as well
    got = sorted(regular_sort.merged(runs, by_weight, "ahead", weight="w").collect(), key=lambda r: r.ahead)
    assert [(-r.a, r.b) for r in got] == sorted((-a, b) for a, b, _, _ in rows)
    assert sorted(r.i for r in got) == list(range(3000))
    assert [r.ahead for r in got] == [0, *np.cumsum([r.w for r in got])[:-1].tolist()]
    part = regular_sort.merged(runs, by_row, "ahead", most=100, below="rest").collect()
    assert sorted(r.i for r in part) == list(range(3000))
    first = sorted((r for r in part if not r.rest), key=lambda r: r.ahead)
    assert [r.ahead for r in first] == list(range(len(first))) and len(first) >= 100
    assert [(-r.a, r.b) for r in first] == sorted((-a, b) for a, b, _, _ in rows)[:len(first)]


def test_parallel_sort_partitions_are_in_order(spark):
    runs = regular_sort.sorted_runs(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")), {"k": F.col("v")}, 300)
    got = regular_sort.merged(runs, regular_sort.segment_sums(runs), "ahead").withColumn("p", F.spark_partition_id()).collect()
    assert all(r.v == r.ahead for r in got)
    edges = {}
    for r in got:
        edges.setdefault(r.p, []).append(r.v)
    assert len(edges) >= 17 and all(max(edges[a]) < min(edges[b]) for a, b in itertools.pairwise(sorted(edges)))


# ---- resampling ------------------------------------------------------------------------------------------------

def plain_resampling(rows, target, share=(10, 100), least=20, buckets=10_000, max_run=1, seed=2024):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    long = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(long[:share[0] * len(long) // share[1]]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


@pytest.mark.parametrize("kinds", [{}, {"max_run": 3, "share": (1, 2), "buckets": 64}, {"share": (1, 1), "least_words": 0, "segment_rows": 7}, {"share": (0, 1)}])
def test_resampled(spark, edge_docs, edge_rows, kinds):
    target = [edge_rows[3][1], "one two two", "ÉTÉ été", None, ""]
    table = spark.createDataFrame([(t, "x") for t in target], "text string, score string")
    got = target_sampling.resampled(edge_docs, table, **kinds)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}
    plain = {k.replace("least_words", "least"): v for k, v in kinds.items() if k != "segment_rows"}
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_resampling([(i, t) for i, t, _ in edge_rows], target, **plain)


def test_resampling_of_none(spark, edge_docs, edge_rows, no_docs):
    assert target_sampling.resampled(no_docs, no_docs).count() == 0
    got = target_sampling.resampled(edge_docs, no_docs)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_resampling([(i, t) for i, t, _ in edge_rows], [])


def test_features_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(4000)).encode()
    whole = [sorted(f for fs, _ in target_sampling._runs(text, k) for f in fs) for k in (1, 2, 4)]
    monkeypatch.setattr(target_sampling, "PIECE", 100)
    assert len(list(target_sampling._pieces(text))) > 50
    assert [sorted(f for fs, _ in target_sampling._runs(text, k) for f in fs) for k in (1, 2, 4)] == whole


# ---- token files -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


SPECIAL = [(500, "a<|endoftext|>b"), (501, "<|endoftext|>"), (502, "x  <|endoftext|> \n y<|endoftext|><|endoftext|>\t z"), (503, "<|endof text|> <|endoftext|")]


def test_token_files(spark, edge_docs, edge_rows, tokenizer):
    docs = edge_docs.select("doc_id", "text", "lang", "n").union(spark.createDataFrame([(i, t, "en", "x") for i, t in SPECIAL], "doc_id long, text string, lang string, n string"))
    path = shared_path(spark, "tokens")
    token_files.write_tokens(docs, path, file_documents=20)
    want = sorted((i is not None, i or 0, i, array("I", tokenizer.encode(t or "", add_special_tokens=False).ids).tolist() + [2]) for i, t in [(r[0], r[1]) for r in edge_rows] + SPECIAL)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[2] for w in want]
    assert sorted(map(repr, (r.ids for r in got))) == sorted(repr(w[3]) for w in want)
    by_id = {w[2]: w[3] for w in want if [x[2] for x in want].count(w[2]) == 1}
    assert all(r.ids == by_id[r.doc_id] for r in got if r.doc_id in by_id)
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) for r in got])[:-1].tolist()] and all(r.n_tokens == len(r.ids) for r in got)
    sums = sorted(token_files.checksums(token_files.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in sums] == [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]
    # The files, and the rows in each, are in order.
    stored = [row for file in sorted(glob.glob(f"{path}/part-*")) for row in pq.read_table(file, columns=["start"])["start"].to_pylist()]
    assert stored == [r.start for r in got] and len(glob.glob(f"{path}/part-*")) > 3
    # Stretches of the whole sequence.
    line = [x for r in got for x in r.ids]
    for begin, end in ((0, 5), (3, 400), (1000, 1001), (2500, 9000), (len(line) - 3, len(line) + 9), (len(line), len(line) + 1), (7, 7)):
        parts = sorted(token_files.ids_between(spark, path, begin, end).collect(), key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == line[begin:end]
        assert all(line[r.start:r.start + len(r.ids)] == r.ids for r in parts)


def test_token_file_layout(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: (i * F.col("id") % 997).cast("string"))).alias("text"))
    path = shared_path(spark, "tokens")
    token_files.write_tokens(docs.coalesce(1), path, row_group=30_000, page=8_000, page_rows=100)
    files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/part-*"))]
    columns = {files[0].row_group(0).column(c).path_in_schema: files[0].row_group(0).column(c) for c in range(4)}
    assert columns["ids.list.element"].has_dictionary_page and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(columns[c].encodings == ("DELTA_BINARY_PACKED",) and not columns[c].has_dictionary_page for c in ("doc_id", "start", "n_tokens"))
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert max(f.num_row_groups for f in files) > 1                                   # sizes of row groups hold
    narrow = token_files.lengths(spark, path).where("doc_id between 1500 and 1510")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,start:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,1500)" in plan and narrow.count() == 11


def test_token_files_of_none(spark, no_docs):
    path = shared_path(spark, "tokens")
    token_files.write_tokens(no_docs, path)
    assert token_files.read_tokens(spark, path).count() == 0 and token_files.checksums(token_files.read_tokens(spark, path)).count() == 0
    assert token_files.ids_between(spark, path, 0, 10).count() == 0


# ---- filter audit ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_removal_intervals(n):
    orders = list(itertools.permutations(range(n)))
    covered = {(m, s): set() for m in range(1, 1 << n) for s in range(n)}
    for mask, step, a, b in filter_audit.removal_intervals(n):
        assert a < b and covered[mask, step].isdisjoint(range(a, b))
        covered[mask, step] |= set(range(a, b))
    for rank, order in enumerate(orders):
        for mask in range(1, 1 << n):
            gone = next(s for s, f in enumerate(order) if mask >> f & 1)
            assert [rank in covered[mask, s] for s in range(n)] == [s == gone for s in range(n)]


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    fails = []
    for doc_id, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {f for f, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                                   ("D", bool(re.search(r"[#$%&*|]", text))), ("E", doc_id is not None and first[text] < doc_id)) if bad}
        fails.append((source or "", failed, doc_id in good, doc_id in toxic))
    out = []
    for part in sorted({f[0] for f in fails}):
        mine = [f for f in fails if f[0] == part]
        found, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                found.append(["".join(order), part, step, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                              sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        out += [(p, o, s, *rest[:-1], shapley[rest[-1]]) for o, p, s, *rest in found]
    return sorted(out)


def test_interaction_audit(spark, edge_docs, edge_rows, some_labels):
    extra = [(300 + i, t, s) for i, (t, s) in enumerate([("Loud WORDS", "a"), ("50 % off | now " * 20, "b"), ("", ""), (None, "c"), ("x " * 49, ""), ("x " * 50, None)])]
    docs = edge_docs.select("doc_id", "text", "source", "n", "key").union(spark.createDataFrame([(*r, "m", "k") for r in extra], "doc_id long, text string, source string, n string, key string"))
    docs = docs.withColumns({"part": F.lit("other"), "mask": F.lit("other"), "digest": F.lit("other")})
    got = filter_audit.interaction_audit(docs, some_labels)
    want = plain_audit(edge_rows + extra, [tuple(r)[:3] for r in some_labels.collect()])
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 600 * len({r[2] or "" for r in edge_rows + extra})


def test_audit_of_none(edge_docs, no_docs, some_labels):
    assert filter_audit.interaction_audit(no_docs, some_labels).count() == 0
    assert filter_audit.interaction_audit(edge_docs, some_labels.where("false")).agg(F.max("good_lost")).first()[0] == 0
