"""Neighbours, fingerprints, packing, mixing, token counts and url filters against plain Python."""
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.llm import fingerprints, mixing, neighbours, packing, token_counts, tokens, url_filters


# ---- neighbours ------------------------------------------------------------------------------------------------

def vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.6


def brute(ids, data, query, k):
    score = data @ data[query]
    return [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]][:k]


@pytest.mark.parametrize("shard_rows", [500, 5000])
def test_recall(spark, shard_rows):
    data = vectors(2500)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = neighbours.search_every(table, step=20, k=10, shard_rows=shard_rows).toPandas()
    ids, hit = np.arange(len(data)), 0
    for query, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 11)) and query not in set(rows.vec_id)
        assert list(zip(-rows.score, rows.vec_id)) == sorted(zip(-rows.score, rows.vec_id))
        np.testing.assert_allclose(rows.score, data[rows.vec_id] @ data[query], rtol=1e-12)
        hit += len(set(brute(ids, data, query, 10)) & set(rows.vec_id))
    assert got["query_id"].nunique() == 125 and hit >= 0.95 * 1250


def test_odd_vectors(spark):
    """Null, zero, infinite and broken vectors stay out; copies and few rows give all there is, ties by id."""
    good = [(20, [1.0, 0.0]), (21, [2.0, 0.0]), (3, [2.0, 0.0]), (40, [0.0, 1.0]), (40, [0.5, 1.0]), (60, [-1.0, -1.0])]
    bad = [(80, None), (81, [0.0, 0.0]), (100, [float("nan"), 1.0]), (101, [float("inf"), 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in sorted(neighbours.search_every(table, k=3).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {20: [(3, 2.0), (21, 2.0), (40, 0.0)], 40: [(3, 0.0), (20, 0.0), (21, 0.0)], 60: [(20, -1.0), (40, -1.0), (3, -2.0)]}
    assert neighbours.search_every(table.where("vec_id = 20")).count() == 0
    assert neighbours.search_every(table.where("false")).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1500)] + [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(1500, 1700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search_every(table, step=400, k=20, shard_rows=400).toPandas().sort_values(["query_id", "rank"])
    data, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for query, found in got.groupby("query_id"):
        assert list(found.vec_id) == [ids[i] for i in brute(ids, data, int(query), 20)]


# ---- fingerprints ----------------------------------------------------------------------------------------------

def test_syncmers_are_closed():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdé ") for _ in range(700))
    hashes, places = fingerprints.syncmers(text, 12, 4)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    inner = fingerprints._stretch_hashes(fingerprints.mix(points + fingerprints._ODD), 4)
    assert len({text[i:i + 4] for i in range(697)}) == len(set(inner.tolist()))
    want = [i for i in range(len(text) - 11) if min(inner[i:i + 9]) in (inner[i], inner[i + 8])]
    assert places.tolist() == want
    assert len({(text[i:i + 12], h) for i, h in zip(want, hashes.tolist())}) == len({text[i:i + 12] for i in want})


def test_syncmers_by_stretches(monkeypatch):
    text = "".join(random.Random(9).choice("abcdefg ") for _ in range(5000))
    whole = fingerprints.syncmers(text)
    monkeypatch.setattr(fingerprints, "STRETCH", 128)
    parts = fingerprints.syncmers(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_fingerprints(edge_docs, edge_rows):
    rows = sorted([(i if i is not None else -(2**63), t or "", i) for i, t, _ in edge_rows])
    want = []
    for k, (_, text, doc_id) in enumerate(rows):
        changed = fingerprints.edited(text, rows[(k + 1) % len(rows)][1])
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.fingerprint(text)))
    got = fingerprints.fingerprints(edge_docs).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.fingerprints(edge_docs.where("doc_id = 9")).collect()[0].near_next == 1.0


def test_fingerprints_of_none(no_docs):
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_likeness():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    text, other = prose(800), prose(800)
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(text), f(text)) == 1.0 and fingerprints.likeness(f(""), f("")) == 1.0
    assert fingerprints.likeness(f(text), f("")) == 0.0 and fingerprints.likeness(f(text), f(other)) < 0.05
    assert fingerprints.likeness(f(text), f("new words in front " + text)) > 0.9
    assert 0.3 < fingerprints.likeness(f(text), f(fingerprints.edited(text, other))) < 0.7
    parts = text.split(" ")
    rng.shuffle(parts)
    assert fingerprints.likeness(f(text), f(" ".join(parts))) < 0.2


# ---- packing ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB1é'st \n\t\r\x0b\x1c\x85   <|>\U0001f600"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(tokenizer, encoder, text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("by_word", [True, False])
@pytest.mark.parametrize("width", [2, 4])
def test_added_tokens_are_ids(tokenizer, by_word, width):
    added = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added, by_word, width)
    for text in ("a<|endoftext|>b", "<|endoftext|>", " x  <|endoftext|> \n y\t<|endoftext|><|endoftext|>'s", "<|endoftext", "", "plain words"):
        assert np.frombuffer(encoder.ids(text), f"<u{width}").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_a_long_text(tokenizer, encoder, monkeypatch):
    text = "a few words,\nand 12 more  of  them; " * 300
    monkeypatch.setattr(tokens, "STRETCH", 100)
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity, most_open, merged", [(2048, 8, 64), (64, 3, 2), (2, 1, 1)])
def test_packing(edge_docs, edge_rows, tokenizer, capacity, most_open, merged):
    pieces = packing.pack(edge_docs.repartition(5), capacity, most_open, merged).toPandas()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, _ in edge_rows]
    want = sorted((str(i), len(x)) for (i, *_), x in zip(edge_rows, ids))
    for doc_id, rows in pieces.groupby(pieces.doc_id.astype("Int64").astype(str).replace("<NA>", "None")):
        covered = {}
        for r in rows.itertuples():
            assert 0 < r.length <= capacity and any(
                len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                for (i, *_), x in zip(edge_rows, ids) if str(i) == doc_id)
            covered[r.doc_tokens] = covered.get(r.doc_tokens, 0) + r.length
        assert sum(covered.values()) == sum(n for i, n in want if i == doc_id)
    short = 0
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1].tolist()] and rows.length.sum() <= capacity
        short += rows.length.sum() < capacity
    assert short <= math.ceil(5 / merged)


def test_packing_none(no_docs):
    assert packing.pack(no_docs).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------------------

def targets(sizes):
    """Targets by the rule: excess over twice a source's size is shared again by weight until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest, w = whole - sum(2 * sizes[s] for s in full), sum(weight[s] for s in open_)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        above = {s for s in open_ if out[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return out
        full |= above


def test_mixing(edge_docs, edge_rows):
    sizes = {}
    for _, t, s in edge_rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = targets(sizes)
    rows = mixing.planned(edge_docs).collect()
    assert len(rows) == len(edge_rows) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate + 1e-12), math.ceil(rate - 1e-12)) and r.size == len((r.text or "").encode().split())
    assert mixing.planned(edge_docs).orderBy("doc_id", "text").collect() == mixing.planned(edge_docs.repartition(3)).orderBy("doc_id", "text").collect()
    made = mixing.mixed(edge_docs)
    assert made.columns == edge_docs.columns and made.count() == sum(r.copies for r in rows)


def test_mixing_comes_near(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(50, 150)), f"s{i % 4}" if i % 3 else "big") for i in range(6000)], "doc_id long, text string, source string")
    for r in mixing.planned(docs).groupBy("source").agg({"target": "max", "size": "count"}).collect():
        taken = mixing.planned(docs).where(mixing.F.col("source") == r.source).agg(mixing.F.sum(mixing.F.col("size") * mixing.F.col("copies"))).first()[0]
        assert taken == pytest.approx(r["max(target)"], rel=0.05)


def test_mixing_none(no_docs):
    assert mixing.planned(no_docs).count() == 0
    assert mixing.planned(no_docs.sparkSession.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).agg({"copies": "sum"}).first()[0] == 0


# ---- token counts ----------------------------------------------------------------------------------------------

def unigram(words):
    from tokenizers import Tokenizer, models, pre_tokenizers
    out = Tokenizer(models.Unigram([("<unk>", -100.0), *words.pieces], 0, False))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.SPACE, prepend_scheme="always", split=True)
    return out


@pytest.fixture(scope="module")
def public_words():
    return token_counts.vocabulary()


def test_token_counts(edge_docs, edge_rows, public_words):
    exact = unigram(public_words)
    got = sorted([(r.doc_id, r.n_chars, r.n_tokens) for r in token_counts.token_counts(edge_docs).collect()], key=repr)
    assert got == sorted([(i, len(t or ""), len(exact.encode(t or "").ids)) for i, t, _ in edge_rows], key=repr)


def test_token_counts_none(no_docs):
    assert token_counts.token_counts(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd xé\n▁", max_size=30))
def test_ties_as_in_the_tokenizer(text):
    """A vocabulary full of equal sums and unknown characters."""
    pieces = [(p, -float(len(p))) for p in ("a", "b", "ab", "ba", "abc", "bc", "c", "▁a", "▁", "aab", "cab")]
    words = token_counts.Vocabulary(pieces, min(s for _, s in pieces))
    assert token_counts.Counter(words).count(text) == len(unigram(words).encode(text).ids)


# ---- url filters -----------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/en", "https://x.net", "https://x.net/", "http://q.example.com/de/1", "http://example.com/en/://b.org/fr/",
        "https://notexample.com/de/", "ftp://w.ORG/fr/a", "//b.org/fr/", "https://b.org#/fr/", "https://b.org/fr?x", "http://ÄÖ.org/fr/ü\nx", "https://org/fr/", "http://b.com/x/"]


def rule_of(host, path):
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def parts(url):
    import re
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ranks(edges, seeds, way, damping=0.85, rounds=20):
    out = {}
    for (a, b), w in edges.items():
        a, b = (a, b) if way == 0 else (b, a)
        out.setdefault(a, {})[b] = w
    score = dict(seeds)
    for _ in range(rounds):
        next_ = {h: (1 - damping) * s for h, s in seeds.items()}
        for a, s in score.items():
            for b, w in out.get(a, {}).items():
                next_[b] = next_.get(b, 0) + damping * s * w / sum(out[a].values())
        score = next_
    return score


def test_url_filters(spark):
    html = ["<a href='http://good.org/'>x</a><img src=//bad.net/i.png>", None, '<A HREF="https://b.com/">y</A> http://none.com', '<a href="/own">z</a><a href="http://b.com/x">', ""]
    urls = URLS + ["https://good.org/fr/", "http://bad.net/", "http://b.com/"] * 3
    rows = [(k, u, html[k % len(html)], "r") for k, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()}
    links, hosts, ruled = {}, set(), {}
    import re
    for _, u, h, _ in rows:
        host, path = parts(u)
        hosts.add(host)
        for t in re.findall(url_filters.HREF, h or ""):
            t = parts("x://" + t.split("//", 1)[1])[0]
            if host and t and t != host:
                links[host, t] = links.get((host, t), 0) + 1
                hosts.add(t)
        rule = rule_of(host, path)
        ruled.setdefault(host, []).append(rule.verdict if rule else "")
    family = set()
    for h in hosts:
        if h.count(".") > 1 and h.split(".", 1)[0]:
            family |= {(h, h.split(".", 1)[1]), (h.split(".", 1)[1], h)}
    for pair in family:
        links[pair] = links.get(pair, 0) + 1
    score = []
    for way, word in ((0, "allow"), (1, "block")):
        share = {h: v.count(word) / len(v) for h, v in ruled.items() if h and word in v}
        score.append(ranks(links, {h: s / sum(share.values()) for h, s in share.items()}, way))
    for k, u, *_ in rows:
        host, path = parts(u)
        rule, r = rule_of(host, path), got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        trust, distrust = (s.get(host, 0.0) for s in score)
        assert r.trust == pytest.approx(trust, abs=1e-12) and r.distrust == pytest.approx(distrust, abs=1e-12)
        assert r.verdict == (rule.verdict if rule else "block" if distrust - trust > 0.5 * (distrust + trust) else "allow")


def test_url_filters_none(spark):
    assert url_filters.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_are_blocked_by_amount(spark):
    """A host with few blocked pages stays open, one that links to blocked hosts only does not, and subdomains meet in hosts without pages."""
    urls = [f"https://blog.example.com/{'de' if k < 2 else 'en'}/{k}" for k in range(16)] + [f"http://bad{k}.net/" for k in range(3)] + ["https://hub.info/x", "https://other.info/x"]
    rows = [(k, u, "".join(f"<a href='http://bad{j}.net/'>" for j in range(3)) if "hub" in u else "") for k, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filters.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), least=url_filters.LEAST).collect()}
    assert [got[k].verdict for k in range(len(urls))] == ["block"] * 2 + ["allow"] * 14 + ["block"] * 3 + ["block", "allow"]


def test_family_edges_of_every_level(spark):
    pages = spark.createDataFrame([("a.b.c.d.com", ""), ("x.c.d.com", ""), ("com", "")], "host string, html string")
    got = {(r.src, r.dst) for r in url_filters.host_edges(pages).collect()}
    up = {("a.b.c.d.com", "b.c.d.com"), ("b.c.d.com", "c.d.com"), ("x.c.d.com", "c.d.com"), ("c.d.com", "d.com")}
    assert got == up | {(b, a) for a, b in up}
