"""Toxic spans by a linear-chain conditional random field.

Tokens (runs of letters and digits, lower-cased) have features: themselves, their first four to six bytes, their last three; each is hashed into one table of
weights.  A chain of two states, clean and toxic, joins them.  Forward and backward sums give every token's marginal; a document's score
comes from its strongest marginal and their sum, over the whole text.

Learning takes labelled tokens.  Where only documents are labelled, ``token_labels`` finds the fewest features that explain the toxic ones and
occur in no clean one, and labels the tokens that have them."""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.labelled import held_out, sample
from loamgrid.llm.words import LOWER, PIECE, RunningHash, buffers, mix, spans

BITS = 18
PREFIXES, SUFFIX = (4, 5, 6), 3
EACH, LONGEST, ROUNDS = 800, 8_000, 30    # documents of a class, their bytes at most, and rounds to learn from
THRESHOLD, FOLDS, FOLD = 0.3, 4, 2
N_FEATURES = 2 + len(PREFIXES)
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Tokens(NamedTuple):
    """Tokens of some rows in one array: features (tokens x N_FEATURES, 0 for none), bounds per row, and places in the bytes of the rows."""
    features: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Field(NamedTuple):
    weights: np.ndarray              # 2**BITS; the first is not used
    bias: float
    steps: np.ndarray                # log weights of clean-clean, clean-toxic, toxic-clean, toxic-toxic
    scale: np.ndarray                # of a document: constant, strongest marginal, log of the sum


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    """Tokens of the rows whose bytes lie between ``bounds``; a token never runs on into the next row."""
    part = LOWER[data[bounds[0]:bounds[-1]]]
    inner = bounds - bounds[0]
    starts, ends = spans(part, _APART)
    crossing = np.searchsorted(inner, starts, "right") != np.searchsorted(inner, ends - 1, "right")
    if crossing.any():                                                        # cut tokens that touch without white between rows
        cuts = inner[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(part))])
        inside = cuts[~_APART[part[cuts]] & ~_APART[part[cuts - 1]]]
        starts, ends = np.sort(np.concatenate((starts, inside))), np.sort(np.concatenate((ends, inside)))
    running = RunningHash(part)
    length = ends - starts
    features = np.zeros((len(starts), N_FEATURES), np.int32)
    top = np.uint64(64 - BITS)
    for column, (salt, width) in enumerate(((1, None), *((k + 10, k) for k in PREFIXES), (5, -SUFFIX))):
        fits = length > abs(width) if width else np.ones(len(starts), bool)
        a = starts[fits] if width is None or width > 0 else ends[fits] - SUFFIX
        b = ends[fits] if width is None or width < 0 else starts[fits] + width
        features[fits, column] = np.maximum(1, mix(running.of(a, b) + np.uint64(salt)) >> top).astype(np.int32)
    return Tokens(features, np.searchsorted(starts, inner).astype(np.int64), starts + bounds[0], ends + bounds[0])


def _step(odds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Log odds of toxic for the next token, by the chain alone, given those of this one."""
    return np.logaddexp(odds + steps[3], steps[1]) - np.logaddexp(odds + steps[2], steps[0])


def marginals(emission: np.ndarray, bounds: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of toxic for every token, and its forward and backward parts; all rows advance together."""
    lengths = np.diff(bounds)
    rows = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[rows], -np.arange(int(lengths.max(initial=0))), "left")          # rows longer than each place
    first, last = bounds[:-1][rows], bounds[1:][rows] - 1
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    now = np.empty(0)
    for t, n in enumerate(active.tolist()):
        at = first[:n] + t
        now = emission[at] + (_step(now[:n], steps) if t else 0.0)
        forward[at] = now
    turned = steps[[0, 2, 1, 3]]
    for t, n in enumerate(active.tolist()):
        at = last[:n] - t
        now = _step(now[:n], turned) if t else np.zeros(n)
        backward[at] = now
        now = now + emission[at]
    return forward + backward, forward, backward


def _emission(field: Field, features: np.ndarray) -> np.ndarray:
    out = np.full(len(features), field.bias)
    for column in range(features.shape[1]):
        out += field.weights[features[:, column]]
    return out


def learn(tokens: Tokens, tags: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Fits weights and steps to labelled tokens by gradient steps (Adam) on the conditional log likelihood."""
    weights, bias, steps = np.zeros(1 << BITS), np.array([-2.0]), np.zeros(4)
    params = [weights, bias, steps]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    features, n = tokens.features, max(1, len(tags))
    follows = np.ones(len(tags), bool)
    follows[tokens.bounds[:-1][tokens.bounds[:-1] < len(tags)]] = False                                # has a token before it in its row
    second = np.flatnonzero(follows)
    seen = np.bincount(2 * tags[second - 1] + tags[second], minlength=4)
    for step in range(1, rounds + 1):
        field = Field(weights, float(bias[0]), steps, np.zeros(3))
        emission = _emission(field, features)
        odds, forward, backward = marginals(emission, tokens.bounds, steps)
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        pair = np.stack([np.zeros(len(second)) + steps[0], steps[1] + emission[second] + backward[second], steps[2] + forward[second - 1],
                         steps[3] + forward[second - 1] + emission[second] + backward[second]])
        pair = np.exp(pair - pair.max(axis=0))
        expected = (pair / pair.sum(axis=0)).sum(axis=1)
        gap = (p - tags) * (1 + 4 * tags)                                                             # the few toxic tokens weigh more
        d_weights = np.zeros(1 << BITS)
        for column in range(N_FEATURES):
            d_weights += np.bincount(features[:, column], gap, 1 << BITS)
        d_weights[0] = 0
        grads = [d_weights / n + 1e-7 * weights, np.array([gap.sum() / n]), (expected - seen) / n + 1e-4 * steps]
        for x, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Field(weights, float(bias[0]), steps, np.zeros(3))


def token_labels(tokens: Tokens, ys: np.ndarray) -> np.ndarray:
    """Tags for the tokens of documents that are labelled as wholes: greedily the features that occur in most of the toxic documents not yet explained,
    and (almost) only there."""
    rows = np.repeat(np.arange(len(ys)), np.diff(tokens.bounds))
    cuts = tokens.bounds.tolist()
    each = [np.unique(tokens.features[a:b]) for a, b in zip(cuts, cuts[1:])]                            # a document's features
    doc, feature = np.repeat(np.arange(len(ys)), [len(x) for x in each]), np.concatenate(each)
    doc, feature = doc[feature > 0], feature[feature > 0]
    toxic = ys[doc] == 1
    clean = np.bincount(feature[~toxic], minlength=1 << BITS) * ((ys == 1).sum() / max(1, (ys == 0).sum()))
    doc, feature, chosen = doc[toxic], feature[toxic], []
    least = max(2, 0.004 * (ys == 1).sum())
    while len(doc):
        gain = np.bincount(feature, minlength=1 << BITS) - 10 * clean
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        left = ~np.isin(doc, doc[feature == best])
        doc, feature = doc[left], feature[left]
    return (np.isin(tokens.features, chosen).any(axis=1) & (ys[rows] == 1)).astype(np.int64)


def _summary(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row: 1, the strongest marginal's log odds, the log of 1 + the sum of marginals."""
    out = np.tile([1.0, -12.0, 0.0], (len(bounds) - 1, 1))
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        out[filled, 1] = np.clip(np.maximum.reduceat(odds, bounds[:-1][filled]), -12, 12)
        out[filled, 2] = np.log1p(np.add.reduceat(p, bounds[:-1][filled]))
    return out


def _logistic(x: np.ndarray, ys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - ys)) + 1e-3 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
    return w


def fitted(docs: DataFrame, labels: DataFrame, each: int = EACH, folds: int = FOLDS, fold: int = FOLD) -> Field:
    """A field learned from at most ``each`` documents of each class; with one class only, a constant."""
    rows, counts = sample(docs, labels, "toxic", each, folds, fold, LONGEST)
    found = rows.toArrow()
    found = found.take(pa.compute.sort_indices(found, [("text", "ascending")])) if found.num_rows else found
    ys = found["y"].to_numpy()
    natural = {y: (counts.get(y, 0) + 0.5) / max(1, int((ys == y).sum())) for y in (0, 1)}
    if len(set(ys.tolist())) < 2:
        return Field(np.zeros(1 << BITS), -12.0, np.zeros(4), np.array([np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)), 0, 0]))
    tokens = tokens_of(*buffers(found["text"]))
    field = learn(tokens, token_labels(tokens, ys))
    odds, _, _ = marginals(_emission(field, tokens.features), tokens.bounds, field.steps)
    weight = np.where(ys == 1, natural[1], natural[0])
    return field._replace(scale=_logistic(_summary(odds, tokens.bounds), ys, weight / weight.mean()), weights=field.weights.astype(np.float32))


def tagged(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, spans`` for every row of ``docs (doc_id, text, ...)``.

    ``spans`` are the offsets (code points, end excluded) of tokens that are toxic rather than not.  Null and empty texts have no token: their score is that of the
    absence of any sign."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PIECE, "right")) - 1)
                tokens = tokens_of(data, bounds[a:b + 1])
                odds, _, _ = marginals(_emission(model, tokens.features), tokens.bounds, model.steps)
                scores = 1 / (1 + np.exp(-np.clip(_summary(odds, tokens.bounds) @ model.scale, -40, 40)))
                hits = np.flatnonzero(odds > 0)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for i, row in zip(hits.tolist(), (np.searchsorted(tokens.bounds, hits, "right") - 1).tolist()):
                    begin = int(bounds[a + row])
                    start = len(bytes(data[begin:tokens.starts[i]]).decode("utf-8", "replace"))
                    found[row].append({"start": start, "end": start + len(bytes(data[tokens.starts[i]:tokens.ends[i]]).decode("utf-8", "replace"))})
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)),
                                       pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "score", "predicted", "spans"])
                a = b
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs``; learned without the rows held out."""
    return tagged(docs, fitted(docs, labels, folds=folds, fold=fold)).select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted", "spans")
