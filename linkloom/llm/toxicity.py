"""Toxicity categories by a classifier chain of linear models.

Categories are predicted in the order of CATEGORIES: junk (label quality 0), toxic (label toxic 1) and
severe (a toxic row with at least SEVERE_HITS distinct words that training finds in toxic rows only).
Each later model also gets the log-odds of the earlier categories; in training these come out of fold,
so that no model learns to trust an earlier one's memory. Features are the presence of words and of
their first four and five bytes, chosen by a chi-square score from a bounded sample of labelled rows
(SAMPLE a class, of texts up to SAMPLE_CHARS characters); they are 64-bit hashes, so features don't
collide. Scoring is one narrow pass over whole texts.

Defined results: a null or empty text has no features and gets the models' base rates. Without rows of
both classes a category's probability is its share in the sample. Repeated rows score alike, null ids
are ordinary rows (never trained on), and an empty table gives an empty result. An id with conflicting
labels is never trained on, and of texts that share an id the smallest is. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mix, text_blocks, word_hashes
from linkloom.llm.quality_classifier import held_out

CATEGORIES = ("junk", "toxic", "severe")
SAMPLE, SAMPLE_CHARS = 2500, 30_000
FEATURES, FOLDS, SEVERE_HITS = 2048, 5, 4
TOXIC_AT = 0.5
_LETTER = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _word_starts(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Hash of each word's first bytes; words shorter than size give their whole."""
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    at = np.flatnonzero(first)
    ends = np.concatenate([data, np.zeros(size, np.uint8)])
    stop = offsets[np.searchsorted(offsets, at, "right")]
    out = np.full(len(at), size, np.uint64)
    alive = np.ones(len(at), bool)
    with np.errstate(over="ignore"):
        for j in range(size):
            byte = ends[at + j]
            alive &= _LETTER[byte] & (at + j < stop)
            lower = byte + 32 * ((byte >= 65) & (byte <= 90)).astype(np.uint8)
            out = np.where(alive, (out << np.uint64(8)) | lower.astype(np.uint64), out)
    return mix(out, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of all words of a block and of their beginnings, with repeats."""
    words, starts = word_hashes(data, offsets, lower=True, is_word=_LETTER)
    if not len(words):
        return np.zeros(0, np.int64), words
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.tile(text, 3), np.concatenate([words, _word_starts(data, offsets, 4), _word_starts(data, offsets, 5)])


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            text, hashes = features(data, offsets)
            lists = [np.unique(hashes[text == i]).view(np.int64) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in (0, 2, 3)] + [pa.array(lists, pa.list_(pa.int64()))], ["k", "junk", "toxic", "f"])


@dataclass
class Chain:
    """hashes: sorted features; weights: features x categories; links[j, i]: weight of category i's log-odds in j."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """From each text's summed feature weights, category by category down the chain."""
        out = np.zeros_like(linear)
        odds = np.zeros_like(linear)
        for j in range(linear.shape[1]):
            z = np.clip(linear[:, j] + self.bias[j] + odds[:, :j] @ self.links[j, :j], -30, 30)
            odds[:, j] = np.clip(z, -6, 6)
            out[:, j] = 1 / (1 + np.exp(-z))
        return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 80, ridge: float = 3e-4, rate: float = 4.0) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient descent with per-column steps; last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1], np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        w[-1] = np.log(share / (1 - share))
        return w
    scale = rate / (np.sqrt((x * x).mean(0)) + 0.05)
    v = np.zeros_like(w)
    for _ in range(rounds):
        look = w + 0.9 * v
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ look, -30, 30))) - y) / len(y) + ridge * look * (np.arange(len(w)) < len(w) - 1)
        v = 0.9 * v - scale * 0.1 * g
        w = w + v
    return w


def train(rows: list[tuple[np.ndarray, int, int]]) -> Chain:
    """rows: (distinct feature hashes, junk, toxic)."""
    n = len(rows)
    labels = np.array([[r[1], r[2]] for r in rows], np.float32).reshape(n, 2)
    owner = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    every = np.concatenate([r[0] for r in rows]).astype(np.uint64) if n else np.zeros(0, np.uint64)
    names, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, minlength=len(names)).astype(float)
    best = np.zeros(len(names))
    with_label = []
    for c in range(2):
        pos = np.bincount(at, weights=labels[owner, c] if n else None, minlength=len(names)) if n else np.zeros(0)
        with_label.append(pos)
        share = float(labels[:, c].mean()) if n else 0.5
        if 0 < share < 1:
            chi = (pos - total * share) ** 2 / (total * share * (1 - share)) * (total >= 3)
            rank = np.empty(len(names))
            rank[np.lexsort((names, -chi))] = np.arange(len(names))
            best = np.maximum(best, np.where(chi > 0, 1 / (1 + rank), 0))
    chosen = np.sort(names[np.lexsort((names, -best))[:FEATURES]])
    x = np.zeros((n, len(chosen)), np.float32)
    if len(chosen):
        place = np.minimum(np.searchsorted(chosen, every), len(chosen) - 1)
        hit = chosen[place] == every
        x[owner[hit], place[hit]] = 1
        only = np.isin(chosen, names[(with_label[1] == total) & (total >= 5)])
        hits = x[:, only].sum(1)
    else:
        hits = np.zeros(n)
    y = np.column_stack([labels, (labels[:, 1] > 0) & (hits >= SEVERE_HITS)]).astype(np.float32)
    k = y.shape[1]
    fold = np.arange(n) % FOLDS
    odds = np.zeros((n, 0), np.float32)
    weights, bias, links = np.zeros((len(chosen), k), np.float32), np.zeros(k), np.zeros((k, k))
    for j in range(k):
        inputs = np.hstack([x, odds / 6])
        w = logistic(inputs, y[:, j])
        weights[:, j], links[j, :j], bias[j] = w[: len(chosen)], w[len(chosen) : -1] / 6, w[-1]
        out = np.zeros(n, np.float32)
        for f in range(FOLDS):
            part = fold == f
            w = logistic(inputs[~part], y[~part, j])
            out[part] = inputs[part] @ w[:-1] + w[-1]
        odds = np.hstack([odds, np.clip(out, -6, 6)[:, None]])
    return Chain(chosen, weights, bias, links)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Chain:
    rows = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col("toxic").isin(0, 1)).select(F.col(key).alias("k"), F.coalesce(1 - F.col("quality"), F.lit(0)).cast("int").alias("junk"), F.col("toxic").cast("int").alias("toxic"))
    both = F.struct("junk", "toxic")
    rows = rows.groupBy("k").agg(F.min(both).alias("label"), F.max(both).alias("other")).where("label = other").select("k", "label.*")
    ids = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("k"), "k").limit(per_class) for c in (0, 1)]
    ids = ids[0].unionByName(ids[1])  # at most 2 x per_class ids
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") <= chars)
    once = texts.join(F.broadcast(ids), "k").groupBy("k", "junk", "toxic").agg(F.min("t").alias("t"))
    sample = once.select("k", "t", "junk", "toxic").mapInArrow(_sampler, f"k {docs.schema[key].dataType.simpleString()}, junk int, toxic int, f array<bigint>")
    table = sample.toArrow().combine_chunks()  # bounded: SAMPLE rows a class of SAMPLE_CHARS
    k, junk, toxic = (table.column(c).to_pylist() for c in ("k", "junk", "toxic"))
    lists = [x.values.to_numpy()[p:q].view(np.uint64) for x in table.column("f").chunks for p, q in zip(x.offsets.to_numpy()[:-1].tolist(), x.offsets.to_numpy()[1:].tolist(), strict=True)]
    order = sorted(range(len(k)), key=lambda i: (k[i], lists[i].tobytes()))
    return train([(lists[i], junk[i], toxic[i]) for i in order])


def scorer(model: Chain):
    gate = np.zeros(1 << 16, bool)
    gate[(model.hashes >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                text, hashes = features(data, offsets)
                maybe = gate[(hashes >> np.uint64(48)).astype(np.int64)]
                text, hashes = text[maybe], hashes[maybe]
                linear = np.zeros((b - a, len(CATEGORIES)))
                if len(model.hashes) and len(hashes):
                    place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
                    hit = model.hashes[place] == hashes
                    present = np.unique(text[hit] * len(model.hashes) + place[hit])
                    np.add.at(linear, present // len(model.hashes), model.weights[present % len(model.hashes)])
                p = model.probabilities(linear)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(p[:, j], pa.float64()) for j in range(p.shape[1]))], ["key", *CATEGORIES])

    return run


def score(docs: DataFrame, model: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, p_<category> for each, is_toxic."""
    schema = ", ".join([f"key {docs.schema[key].dataType.simpleString()}", *(f"{c} double" for c in CATEGORIES)])
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scorer(model), schema)
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), *(F.col(c).alias(f"p_{c}") for c in CATEGORIES), (F.col("toxic") >= TOXIC_AT).alias("is_toxic"))
