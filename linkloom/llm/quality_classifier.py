"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded and run through learned filters; each filter is max-pooled over chunks of 1,024 bytes
that overlap by half and cover the whole document; the mean, the largest and the smallest pooled value of
each filter over a document's chunks give one probability. The network is trained on the driver from a
bounded sample of labelled rows (at most SAMPLE a class, of texts up to SAMPLE_CHARS), taken in hash
order so that reruns agree. Scoring is one narrow pass over the whole text of every row.

Defined results: a null or empty text is scored as one chunk of zero bytes. A label table without both
classes gives every row the share of 1s (0.5 without any). Repeated rows score alike; null ids are
ordinary rows that are never trained on; an id with conflicting labels is never trained on, and of texts
that share an id the smallest is; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import text_blocks, tidy

SAMPLE, SAMPLE_CHARS = 600, 30_000
WIDTH, STRIDE, SEGMENT = 6, 2, 512
EMBED, FILTERS = 6, 24
EPOCHS, RATE, BATCH = 6, 0.02, 24
ACCEPT_AT = 0.3


def held_out(key: Column) -> Column:
    """True for the rows labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class ByteNet:
    """Parameters and arithmetic of the network."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "head": np.zeros(3 * FILTERS, np.float32),
            "head_bias": np.zeros(1, np.float32),
        }

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Bytes of each window, one row a window; texts shorter than a window are padded with zero bytes."""
        if len(data) < WIDTH:
            data = np.concatenate([data, np.zeros(WIDTH - len(data), np.uint8)])
        elif (len(data) - WIDTH) % STRIDE:
            data = np.concatenate([data, np.zeros(1, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        return self.p["embed"][rows].reshape(len(rows), -1) @ self.p["filters"] + self.p["bias"]

    def pooled(self, data: np.ndarray, place: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Chunk maxima (chunks x filters), the windows they come from, all windows."""
        rows = self.windows(data)
        per = SEGMENT // STRIDE
        tops, at = [], []
        for s in range(0, len(rows), per * 64):
            out = self.convolve(rows[s : s + per * 64])
            for a in range(0, len(out), per):
                part = out[a : a + per]
                tops.append(part.max(0))
                if place:
                    at.append(part.argmax(0) + s + a)
        tops = np.array(tops)
        if len(tops) == 1:
            return np.maximum(tops, 0), np.array(at) if place else None, rows
        later = tops[1:] > tops[:-1]
        where = np.where(later, np.array(at)[1:], np.array(at)[:-1]) if place else None
        return np.maximum(np.maximum(tops[1:], tops[:-1]), 0), where, rows

    def combine(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)])

    def probability(self, data: np.ndarray) -> float:
        z = float(self.combine(self.pooled(data)[0]) @ self.p["head"] + self.p["head_bias"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradients(self, data: np.ndarray, label: float, weight: float) -> dict[str, np.ndarray]:
        """Cross-entropy gradients; maxima pass theirs only to the windows they come from."""
        chunks, where, rows = self.pooled(data, place=True)
        x = self.combine(chunks)
        z = float(x @ self.p["head"] + self.p["head_bias"][0])
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        head = self.p["head"].reshape(3, FILTERS) * d
        g = np.repeat(head[:1] / len(chunks), len(chunks), 0)
        f = np.arange(FILTERS)
        np.add.at(g, (chunks.argmax(0), f), head[1])
        np.add.at(g, (chunks.argmin(0), f), head[2])
        g = g * (chunks > 0)
        used = rows[where]  # chunks x filters x WIDTH
        emb = self.p["embed"][used].reshape(*used.shape[:2], -1)
        back = g[:, :, None] * self.p["filters"].T[None]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, used.reshape(-1), back.reshape(-1, EMBED))
        return {"embed": embed, "filters": np.einsum("cf,cfk->kf", g, emb), "bias": g.sum(0), "head": d * x, "head_bias": np.array([d], np.float32)}


def train(texts: list[bytes], labels: list[int]) -> ByteNet | float:
    """Adam on shuffled batches with balanced classes; a plain share where a class is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    net = ByteNet()
    data = [np.frombuffer(t, np.uint8) for t in texts]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    r = np.random.Generator(np.random.PCG64(11))
    step = 0
    epochs = max(EPOCHS, min(60, 7_200 // len(y)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.001
        for part in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
            total = {k: 1e-4 * v for k, v in net.p.items()}
            for i in part.tolist():
                for k, g in net.gradients(data[i], float(y[i]), float(weight[i]) / len(part)).items():
                    total[k] = total[k] + g
            step += 1
            for k, g in total.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, text: str = "text", key: str = "doc_id", per_class: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most per_class rows of each class (0 and 1), in hash order, none of them held out: key, label, text."""
    rows = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(target).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(target).alias("label"), F.max(target).alias("other")).where("label = other").drop("other")
    order = F.xxhash64(F.col("k"), F.lit(target))
    ids = [rows.where(F.col("label") == c).orderBy(order, "k").limit(per_class) for c in (0, 1)]
    ids = ids[0].unionByName(ids[1])  # at most 2 x per_class ids
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= chars)
    return texts.join(F.broadcast(ids), "k").groupBy("k", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", key: str = "doc_id") -> ByteNet | float:
    rows = labelled_sample(docs, labels, target, text, key).collect()  # bounded: SAMPLE rows a class of SAMPLE_CHARS
    rows.sort(key=lambda r: (r["k"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows])


def scorer(model: ByteNet | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            for a, b, data, offsets in text_blocks(batch.column(1)):
                if isinstance(model, float):
                    p = np.full(b - a, model)
                else:
                    p = np.array([model.probability(data[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), pa.array(p, pa.float64())], ["key", "score"])

    return run


def score(docs: DataFrame, model: ByteNet | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted for every row."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(scorer(model)), f"key {kind}, score double")
    return out.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= ACCEPT_AT).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: ByteNet | float, text: str = "text") -> DataFrame:
    """The rows of docs that the network accepts, with docs' columns, in one narrow pass."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, data, offsets in text_blocks(batch.column(at)):
                if isinstance(model, float):
                    keep += [model >= ACCEPT_AT] * (b - a)
                else:
                    keep += [model.probability(data[x:y]) >= ACCEPT_AT for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
