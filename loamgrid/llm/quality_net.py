"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become symbols: the byte, and whether the bytes before it repeat at a short distance.  Learned filters of ``WIDTH`` symbols run over a whole document; in overlapping
chunks the strongest answer of each filter is kept (max-pooling), a hidden layer looks at each chunk, and the strongest and the mean of its answers over all
chunks give one probability."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.labelled import held_out, sample
from loamgrid.llm.words import buffers

WIDTH, STRIDE, HOP = 8, 2, 256       # a chunk is two hops
FILTERS, DEEP, EMBED, STATES = 24, 16, 10, 3
LAGS, SHORT, LONG = range(2, 41), 12, 48
EACH, CHUNKS, ROUNDS = 900, 16, 7    # documents of a class, chunks of a document and rounds to learn from
STRETCH = 256 * HOP
THRESHOLD, FOLDS, FOLD = 0.3, 5, 0


class Net(NamedTuple):
    embed: np.ndarray                # 256 x EMBED
    state: np.ndarray                # STATES x EMBED
    filters: np.ndarray              # WIDTH x EMBED x FILTERS
    bias: np.ndarray
    deep: np.ndarray                 # FILTERS x DEEP
    deep_bias: np.ndarray
    last: np.ndarray                 # 2 * DEEP
    last_bias: np.ndarray

    def tables(self) -> np.ndarray:
        """Answers of each filter place to each symbol: WIDTH x (STATES * 256) x FILTERS."""
        inputs = (self.state[:, None, :] + self.embed[None, :, :]).reshape(-1, EMBED)
        return np.einsum("se,wef->wsf", inputs, self.filters, optimize=True).astype(np.float32)


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes as 0-255, plus 256 where the last ``SHORT`` bytes repeat at one of the lags, plus 512 where the last ``LONG`` do."""
    n = len(data)
    out = data.astype(np.uint16)
    short, long = np.zeros(n, bool), np.zeros(n, bool)
    for lag in LAGS:
        if n - lag < SHORT:
            break
        same = data[lag:] == data[:-lag]
        run, have = same, 1
        for width, marks in ((SHORT, short), (LONG, long)):
            while have < width and len(run) > 0:
                step = min(have, width - have)
                run, have = run[step:] & run[:-step] if len(run) > step else run[:0], have + step
            if len(run):
                marks[n - len(run):] |= run
    out[short] += np.uint16(256)
    out[long] += np.uint16(256)
    return out


def _blocks(marks: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Strongest answer of each filter within each hop of symbols (padded by zeros): hops x FILTERS."""
    hops = max(1, -(-len(marks) // HOP))
    padded = np.zeros(hops * HOP + WIDTH, np.uint16)
    padded[:len(marks)] = marks
    out = np.empty((hops, tables.shape[2]), np.float32)
    for a in range(0, hops, 64):
        b = min(hops, a + 64)
        answers = tables[0][padded[a * HOP:b * HOP:STRIDE]]
        for j in range(1, WIDTH):
            answers += tables[j][padded[a * HOP + j:b * HOP + j:STRIDE]]
        out[a:b] = answers.reshape(b - a, HOP // STRIDE, -1).max(axis=1)
    return out


def score(data: np.ndarray, net: Net, tables: np.ndarray) -> float:
    """Log odds of a document's bytes, taken whole, some hops at a time."""
    blocks = []
    for begin in range(0, max(1, len(data)), STRETCH):
        before = min(begin, LONG + max(LAGS))
        marks = symbols(data[begin - before:begin + STRETCH + WIDTH])[before:]
        blocks.append(_blocks(marks, tables)[:max(1, min(STRETCH, len(data) - begin) + HOP - 1) // HOP or 1])
    hops = np.concatenate(blocks)
    chunks = np.maximum(hops[:-1], hops[1:]) if len(hops) > 1 else hops
    deep = np.maximum(np.maximum(chunks + net.bias, 0) @ net.deep + net.deep_bias, 0)
    return float(np.concatenate((deep.max(axis=0), deep.mean(axis=0))) @ net.last + net.last_bias[0])


def _first_net(rng: np.random.Generator) -> Net:
    embed = rng.normal(0, 0.1, (256, EMBED))
    for place, low, high in ((0, 97, 123), (1, 65, 91), (2, 48, 58), (3, 128, 256), (4, 9, 33)):       # letters, capitals, digits, beyond ASCII, white
        embed[low:high, place] += 1
    embed[33:48, 5] += 1
    embed[58:65, 5] += 1
    state = np.zeros((STATES, EMBED))
    state[1, 6], state[2, 7] = 1, 1
    return Net(embed, state, rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, (FILTERS, DEEP)),
               np.zeros(DEEP) + 0.1, rng.normal(0, 0.2, 2 * DEEP), np.zeros(1))


def learn(chunks: list[np.ndarray], ys: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Net:
    """Fits a net to documents given as arrays of chunks (chunks x (2 * HOP + WIDTH) symbols) by Adam on the log loss; classes weigh alike."""
    rng = np.random.default_rng(seed)
    net = _first_net(rng)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    weight = np.where(ys == 1, 0.5 / max(1, (ys == 1).sum()), 0.5 / max(1, (ys == 0).sum())) * len(ys)
    order, step = np.arange(len(ys)), 0
    for epoch in range(rounds):
        rng.shuffle(order)
        for a in range(0, len(order), 32):
            chosen = order[a:a + 32]
            grads = _gradients(net, [chunks[i] for i in chosen], ys[chosen], weight[chosen])
            step += 1
            rate = 0.01 * min(1.0, step / 20) * (1 - epoch / (rounds + 1))
            for p, g, (m, v) in zip(net, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _gradients(net: Net, chunks: list[np.ndarray], ys: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    tables = net.tables()
    marks = np.concatenate(chunks)                                           # all chunks of these documents
    ends = np.cumsum([len(c) for c in chunks])
    starts = np.concatenate(([0], ends[:-1]))
    span = 2 * HOP
    answers = tables[0][marks[:, 0:span:STRIDE]]
    for j in range(1, WIDTH):
        answers += tables[j][marks[:, j:span + j:STRIDE]]
    at = answers.argmax(axis=1)                                              # chunks x FILTERS
    pooled = np.take_along_axis(answers, at[:, None, :], 1)[:, 0, :] + net.bias
    active = np.maximum(pooled, 0)
    inner = active @ net.deep + net.deep_bias
    deep = np.maximum(inner, 0)
    top = np.array([s + deep[s:e].argmax(axis=0) for s, e in zip(starts, ends)])                       # documents x DEEP
    joined = np.concatenate((np.take_along_axis(deep, top, 0), np.add.reduceat(deep, starts) / (ends - starts)[:, None]), axis=1)
    odds = joined @ net.last + net.last_bias[0]
    d_odds = (1 / (1 + np.exp(-odds)) - ys) * weight / len(ys)
    d_joined = d_odds[:, None] * net.last
    d_deep = np.repeat(d_joined[:, DEEP:] / (ends - starts)[:, None], ends - starts, axis=0)
    np.add.at(d_deep, (top, np.arange(DEEP)), d_joined[:, :DEEP])
    d_inner = d_deep * (inner > 0)
    d_pooled = (d_inner @ net.deep.T) * (pooled > 0)
    # Through the tables: each filter answers at one place of each chunk.
    size = STATES * 256
    d_tables = np.empty((WIDTH, size, FILTERS))
    rows = np.arange(len(marks))[:, None]
    for j in range(WIDTH):
        where = marks[rows, at * STRIDE + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
        d_tables[j] = np.bincount(where.ravel(), d_pooled.ravel(), size * FILTERS).reshape(size, FILTERS)
    inputs = (net.state[:, None, :] + net.embed[None, :, :]).reshape(-1, EMBED)
    d_filters = np.einsum("se,wsf->wef", inputs, d_tables, optimize=True)
    d_inputs = np.einsum("wsf,wef->se", d_tables, net.filters, optimize=True).reshape(STATES, 256, EMBED)
    return [d_inputs.sum(axis=0), d_inputs.sum(axis=1), d_filters, d_pooled.sum(axis=0), active.T @ d_inner, d_inner.sum(axis=0),
            d_odds @ joined, np.array([d_odds.sum()])]


def _chunks(data: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` overlapping chunks of a document's symbols, evenly spread."""
    marks = symbols(data)
    hops = max(1, -(-len(marks) // HOP))
    padded = np.zeros((hops + 1) * HOP + WIDTH, np.uint16)
    padded[:len(marks)] = marks
    begins = np.unique(np.linspace(0, max(0, hops - 2), min(most, max(1, hops - 1))).astype(int)) * HOP
    return np.stack([padded[b:b + 2 * HOP + WIDTH] for b in begins])


def fitted(docs: DataFrame, labels: DataFrame, each: int = EACH, folds: int = FOLDS, fold: int = FOLD) -> tuple[Net | None, float]:
    """A net learned from at most ``each`` documents of each class, and the log odds to add: the classes' true shares, which the sample evens out.

    Without documents of both classes there is no net, and the odds are those of the labels."""
    rows, counts = sample(docs, labels, "quality", each, folds, fold)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds = buffers(batch.column("text"))
        parts = [_chunks(data[a:b], CHUNKS).tobytes() for a, b in zip(bounds, bounds[1:])]
        return pa.record_batch([pa.array(parts, pa.binary()), batch.column("y")], names=["chunks", "y"])

    found = rows.mapInArrow(lambda batches: (cut(b) for b in batches if b.num_rows), "chunks binary, y int").toArrow()
    odds = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    ys = found["y"].to_numpy()
    if len(set(ys.tolist())) < 2:
        return None, odds
    chunks = [np.frombuffer(c, np.uint16).reshape(-1, 2 * HOP + WIDTH) for c in found["chunks"].to_pylist()]
    order = sorted(range(len(ys)), key=lambda i: (chunks[i].tobytes(), int(ys[i])))                     # as rows come in any order
    return learn([chunks[i] for i in order], ys[order].astype(float)), odds


def scored(docs: DataFrame, net: Net | None, odds: float, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs (doc_id, text, ...)``, or with ``keep`` the rows of ``docs`` that are predicted 1.

    Scores come from the whole text alone; null counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast((net, net.tables() if net else None))
    docs = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = held.value
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            raw = [score(data[a:b], model, tables) for a, b in zip(bounds.tolist(), bounds[1:].tolist())] if model else [0.0] * batch.num_rows
            scores = 1 / (1 + np.exp(-np.clip(np.array(raw) + odds, -40, 40)))
            if keep:
                yield batch.filter(pa.array(scores >= threshold))
            else:
                yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                                      names=["doc_id", "score", "predicted"])
    return docs.mapInArrow(run, docs.schema if keep else "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; learned without the rows held out."""
    net, odds = fitted(docs, labels, folds=folds, fold=fold)
    return scored(docs, net, odds).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
