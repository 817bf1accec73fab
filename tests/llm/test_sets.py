"""N-gram Jaccard join, substring dedup, connected components and word hashes against plain Python."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.llm import jaccard_join, repeats, words
from loamgrid.llm.shared import Sieve, components


def split(text):
    return (text or "").encode().split()


def removed(rows, length):
    """Words left and gone by the definition; rows of one id are not earlier than each other."""
    earliest, out = {}, []
    for i, t, *_ in rows:
        w, key = split(t), i if i is not None else -(2**63)
        for s in range(len(w) - length + 1):
            window = tuple(w[s:s + length])
            earliest[window] = min(earliest.get(window, key), key)
    for i, t, *_ in rows:
        w, key, seen = split(t), i if i is not None else -(2**63), set()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            window = tuple(w[s:s + length])
            if earliest[window] < key or window in seen:
                gone[s:s + length] = [True] * length
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def linked(rows, size, similar, out_of):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and out_of * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for (i, *_), s in zip(rows, sets)]


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("first, length", [(10, 20), (5, 20), (3, 6)])
def test_repeats(edge_docs, edge_rows, first, length):
    got = repeats.without_repeats(edge_docs, length=length, first=first, bits=16)
    assert in_order(got.collect()) == in_order(removed(edge_rows, length))


def test_repeats_texts(edge_docs, edge_rows):
    got = repeats.without_repeats(edge_docs, texts=True)
    assert got.columns == [c for c in edge_docs.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    for row in got.collect():
        if row.n_removed == 0:
            assert (row.doc_id, row.text) in {(i, t) for i, t, _ in edge_rows}
        else:
            assert len(split(row.text)) == row.n_words - row.n_removed


def test_repeat_levels_end(edge_docs, edge_rows):
    levels = repeats.repeat_levels(edge_docs, first=10, bits=20)
    assert [n for n, _ in levels] == [10 * 2**k for k in range(len(levels))] and levels[-1][1] == 0
    for length, n in levels[1:]:
        seen = {}
        for _, t, *_ in edge_rows:
            w = split(t)
            for s in range(len(w) - length + 1):
                seen[tuple(w[s:s + length])] = seen.get(tuple(w[s:s + length]), 0) + 1
        assert n == sum(c > 1 for c in seen.values())


def test_repeats_reject_lengths(edge_docs):
    with pytest.raises(ValueError):
        repeats.without_repeats(edge_docs, length=30, first=10)


@pytest.mark.parametrize("size, similar, out_of", [(3, 90, 100), (5, 8, 10), (2, 1, 2)])
def test_jaccard_components(edge_docs, edge_rows, size, similar, out_of):
    got = jaccard_join.jaccard_components(edge_docs, size, similar, out_of, bits=20)
    assert in_order(got.collect()) == in_order(linked(edge_rows, size, similar, out_of))


def test_jaccard_many_near_copies(spark):
    """Chains and clusters of edited copies, with links between components found only by the second pass."""
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 25)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(60)}"
            rows.append((n, " ".join(base)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, similar, out_of in ((1, 8, 10), (2, 7, 10), (3, 90, 100)):
        assert in_order(jaccard_join.jaccard_components(docs, size, similar, out_of).collect()) == in_order(linked(rows, size, similar, out_of))


def with_links(rows, size, similar, out_of):
    """Links of each row by comparing all pairs of rows."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    n = [sum(a != b and rows[a][0] is not None and rows[b][0] is not None and bool(sets[a]) and bool(sets[b]) and out_of * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])
             for b in range(len(rows))) for a in range(len(rows))]
    return [(*row, k) for row, k in zip(linked(rows, size, similar, out_of), n)]


@pytest.mark.parametrize("size, similar, out_of", [(1, 8, 10), (2, 7, 10), (3, 90, 100)])
def test_jaccard_links(spark, edge_rows, size, similar, out_of):
    """All links within groups of near copies count, of chains, of one hub and across hubs, and of rows that share a doc_id with different texts."""
    rng = random.Random(7)
    rows = [(i, t) for i, t, *_ in edge_rows]
    for _ in range(10):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 25)):
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(60)}"
            rows.append((1000 + len(rows) // 2 * 2 if rng.random() < 0.1 else 1000 + len(rows), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = with_links(rows, size, similar, out_of)
    assert max(n for *_, n in want) > 2
    assert in_order(jaccard_join.jaccard_links(docs, size, similar, out_of, bits=20).collect()) == in_order(want)


def test_first_of_each(edge_docs, edge_rows):
    want = {(i, n, c) for i, n, c in linked(edge_rows, 5, 8, 10) if i is None or c == i}
    got = jaccard_join.first_of_each(edge_docs)
    assert got.columns[0] == "doc_id" and set(got.columns) == set(edge_docs.columns)
    assert {r.doc_id for r in got.collect()} == {i for i, *_ in want}


def test_empty_tables(no_docs):
    assert repeats.without_repeats(no_docs).count() == 0
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


texts = st.lists(st.one_of(st.none(), st.text(alphabet="abé \t\n\x0b\x1c ", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(texts, st.booleans())
def test_words(column, lower):
    """Hashes are equal where words are; no word runs over the end of a text."""
    got, want = [], []
    for w in words.words_of(pa.array(column, pa.string()), lower):
        got += [w.hashes[a:b].tolist() for a, b in zip(w.bounds, w.bounds[1:])]
    want = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in column]
    assert [len(x) for x in got] == [len(x) for x in want]
    pairs = {(w, h) for x, y in zip(want, got) for w, h in zip(x, y)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + "  " + "y" * 900
    whole = next(words.words_of(pa.array([text])))
    monkeypatch.setattr(words, "PIECE", 256)
    parts = list(words.words_of(pa.array(["x y", text, None, "z"])))
    assert [len(w.bounds) - 1 for w in parts] and sum(len(w.bounds) - 1 for w in parts) == 4
    long = next(w for w in parts if len(w.hashes) > 1000)
    row = 1 - long.first
    assert (long.hashes[long.bounds[row]:long.bounds[row + 1]] == whole.hashes).all()


def test_joined_tells_orders_apart():
    h = words.mix(np.arange(1, 200, dtype=np.uint64) % np.uint64(7))
    for length in (1, 2, 3, 5, 20):
        made = words.joined(h, length)
        names = [tuple(h[i:i + length]) for i in range(len(h) - length + 1)]
        assert len(made) == len(names) and len({(n, m) for n, m in zip(names, made.tolist())}) == len(set(names)) == len(set(made.tolist()))


def test_sieve():
    members = words.mix(np.arange(1000, dtype=np.uint64))
    bits = np.zeros(1 << 10, np.uint64)
    at = members >> np.uint64(48)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    sieve = Sieve(16, bits)
    assert sieve.holds(members).all() and sieve.holds(words.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))).mean() < 0.1
