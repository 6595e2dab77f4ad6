"""Chroma audio fingerprints of a media column, and the alignment of recordings.

A recording (WAV bytes, or bare 8-bit mono samples) is cut into overlapping frames; each frame's spectrum
is folded into twelve pitch classes. Sixteen filters, differences of rectangles taken from an integral
image of the pitch-class frames, are each quantised to two bits; together they pack one 32-bit code a
frame. Recordings are aligned by the histogram of offsets at which they share codes, and the best offset
is judged by the share of differing bits over the whole overlap.

The search takes as queries the recordings whose id is divisible by QUERY_STEP and looks all recordings
up. Queries of equal codes form a class, named by its smallest id. The index holds every code and position
of every class; it goes to the executors in blocks of about BLOCK codes, and each recording meets each
block where it lies, in runs of about CHUNK votes: rows are never dealt by code, and none is left out.

A pair is judged at its best shift: most votes, then fewest bit errors. It needs MIN_VOTES votes, or as many
as the shorter recording has codes. `matches` holds all aligned classes of a recording and `query_class`
is the class of a query, so `matches` joined with the classes of the queries gives all aligned pairs; a
query's own class is among its matches where it has another member. The other columns give the best match.

Defined results: a null or empty recording has no codes and no match. Audio shorter than one filter
window is padded with silence to give one code. Null ids can't be queries or be looked up. Rows that
repeat an id are looked up together, each compared by its own codes. An id that is no whole number is as
good as null to the search. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import discard, materialize

RATE, FRAME, HOP = 8000, 256, 64
SPAN = 8
QUERY_STEP = 100
MIN_VOTES, MAX_BIT_ERRORS = 3, 0.2
#: Query codes in one block of the index, and votes or frames compared at once.
BLOCK, CHUNK = 1 << 21, 1 << 21


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width in frames) of the sixteen filters, by rule."""
    return [(i % 4, 5 * i % 12, 4 + 2 * (i % 4), 2 + 2 * (i // 2 % 4)) for i in range(16)]


def _chroma_matrix(rate: int) -> np.ndarray:
    frequency = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(frequency), 12), np.float32)
    with np.errstate(divide="ignore"):
        pitch = np.round(12 * np.log2(np.maximum(frequency, 1e-9) / 440)).astype(int) % 12
    for i in range(1, len(frequency)):
        out[i, pitch[i]] = 1
    return out


_WINDOW = np.hanning(FRAME).astype(np.float32)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate from WAV bytes (8 or 16 bit PCM), else from bare 8-bit samples."""
    if len(data) >= 44 and data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, channels, rate, bits = 12, 1, RATE, 8
        while at + 8 <= len(data):
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"fmt " and at + 24 <= len(data):
                _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if name == b"data":
                raw = data[at + 8 : at + 8 + size]
                width = max(1, bits // 8) * max(1, channels)
                raw = raw[: len(raw) // width * width]
                x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768 if bits == 16 else np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
                return x.reshape(-1, max(1, channels)).mean(1), rate
            at += 8 + size + (size & 1)
    return np.frombuffer(data, np.uint8).astype(np.float32) / 128 - 1, RATE


def fingerprint(samples: np.ndarray, rate: int = RATE, _matrix: dict = {}) -> np.ndarray:  # noqa: B006 the cache is meant to last
    """One unsigned 32-bit code a frame position."""
    if not len(samples):
        return np.zeros(0, np.uint32)
    least = FRAME + (SPAN - 1) * HOP
    if len(samples) < least:
        samples = np.concatenate([samples, np.zeros(least - len(samples), np.float32)])
    if rate not in _matrix:
        _matrix[rate] = _chroma_matrix(rate)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    chroma = np.empty((len(frames), 12), np.float32)
    for a in range(0, len(frames), 2048):
        chroma[a : a + 2048] = np.abs(np.fft.rfft((frames[a : a + 2048] - frames[a : a + 2048].mean(1, keepdims=True)) * _WINDOW)).astype(np.float32) @ _matrix[rate]
    chroma /= chroma.sum(1, keepdims=True) + 1e-6
    image = np.zeros((len(chroma) + 1, 25))
    image[1:, 1:] = np.concatenate([chroma, chroma], 1).cumsum(0).cumsum(1)
    n = len(chroma) - SPAN + 1

    def box(t: int, w: int, y: int, h: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + w : t + w + n]
        return b[:, y + h] - b[:, y] - a[:, y + h] + a[:, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in _filters():
        if kind == 0:
            plus, minus = box(0, w, y, h // 2), box(0, w, y + h // 2, h // 2)
        elif kind == 1:
            plus, minus = box(0, w // 2, y, h), box(w // 2, w // 2, y, h)
        elif kind == 2:
            plus = box(0, w // 2, y, h // 2) + box(w // 2, w // 2, y + h // 2, h // 2)
            minus = box(w // 2, w // 2, y, h // 2) + box(0, w // 2, y + h // 2, h // 2)
        else:
            q = h // 4 or 1
            plus, minus = box(0, w, y + q, h - 2 * q), box(0, w, y, q) + box(0, w, y + h - q, q)
        x = (plus - minus) / (plus + minus + 1e-9)
        level = (x > -0.2).astype(np.uint32) + (x > 0) + (x > 0.2)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            codes = [fingerprint(*decode(x or b"")).astype("<u4") for x in part.column(1).to_pylist()]
            crc = [zlib.crc32(c.tobytes()) for c in codes]
            name = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in codes]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(np.concatenate(codes).view(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(crc, pa.int64()), pa.array(name, pa.binary()), part.column(2)], ["key", "codes", "crc", "print", "id"])


def fingerprints(media: DataFrame, content: str, key: str) -> DataFrame:
    """key, codes (array of 32-bit integers), crc, print (128-bit hash of the codes), id (the key as a whole number). A text column is taken as its UTF-8 bytes."""
    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("b"), F.col(key).try_cast("bigint").alias("id")).mapInArrow(_fingerprints, f"key {kind}, codes array<int>, crc bigint, print binary, id bigint")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists as unsigned codes, and where each list starts (one more entry than lists)."""
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    return np.array(column.flatten(), np.int32).view(np.uint32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes, the list and the place in it of each entry."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Cuts a sequence of sizes into runs of about CHUNK in sum, of one entry at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        yield slice(a, b)
        a = b


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


class _Index:
    """Every (code, query, position) of a block of query classes: low and high id, print, codes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, prints: list[bytes], flat: np.ndarray, starts: np.ndarray):
        self.low, self.high, self.flat, self.starts = low, high, flat, starts
        self.classes = {p: i for i, p in enumerate(prints)}
        self.sizes = np.diff(starts)
        order = np.argsort(flat, kind="stable")
        self.codes = flat[order]
        self.query, self.at = (x[order] for x in _spread(self.sizes))

    def search(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(recording, query, shift, votes, bit error rate) of each pair at its best shift, in order of recording and query."""
        sizes = np.diff(starts)
        most, n = int(sizes.max(initial=0)), len(self.sizes)
        width = most + int(self.sizes.max(initial=0)) + 1
        low, high = np.searchsorted(self.codes, flat, "left"), np.searchsorted(self.codes, flat, "right")
        met = np.flatnonzero(high > low)
        rec, pos = (x[met] for x in _spread(sizes))
        low, hits = low[met], (high - low)[met]
        out, keys, counts = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for run in _runs(hits):
            of, place = _spread(hits[run])
            entry = low[run][of] + place
            new = (rec[run][of] * n + self.query[entry]) * width + self.at[entry] - pos[run][of] + most
            keys, counts = _tally(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
            done = int(np.searchsorted(keys, rec[run][-1] * n * width))  # the last recording may go on in the next run
            out.append(self._best(keys[:done], counts[:done], n, width, most, flat, starts))
            keys, counts = keys[done:], counts[done:]
        out.append(self._best(keys, counts, n, width, most, flat, starts))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _best(self, keys: np.ndarray, votes: np.ndarray, n: int, width: int, most: int, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        pair, shift = keys // width, keys % width - most
        rec, query = pair // max(n, 1), pair % max(n, 1)
        sizes = np.diff(starts)
        enough = votes >= np.minimum(MIN_VOTES, np.minimum(sizes[rec], self.sizes[query]))
        pair, shift, votes = pair[enough], shift[enough], votes[enough]
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        if len(heads):
            top = votes == np.repeat(np.maximum.reduceat(votes, heads), np.diff(np.append(heads, len(pair))))
            pair, shift, votes = pair[top], shift[top], votes[top]
        rec, query = pair // max(n, 1), pair % max(n, 1)
        first = np.maximum(0, -shift)
        overlap = np.minimum(sizes[rec] - first, self.sizes[query] - first - shift)
        wrong = np.zeros(len(pair), np.int64)
        for run in _runs(overlap):
            of, place = _spread(overlap[run])
            here, there = flat[(starts[rec] + first)[run][of] + place], self.flat[(self.starts[query] + first + shift)[run][of] + place]
            wrong[run] = np.bincount(of, np.bitwise_count(here ^ there), len(overlap[run]))
        rate = wrong / (overlap * 32.0)
        order = np.lexsort((shift, rate, pair))
        order = order[np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))] if len(pair) else order
        return rec[order], query[order], shift[order], votes[order], rate[order]


_MATCH = pa.struct([("match_id", pa.int64()), ("frame_offset", pa.int64()), ("votes", pa.int64()), ("bit_error_rate", pa.float64())])


def _searcher(block: Broadcast, step: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(*block.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(4)
                known = np.array(ids.is_valid())
                keys = np.array(ids.fill_null(0), np.int64)
                rec, query, shift, votes, rate = index.search(*_lists(part.column(1)))
                match = np.where(index.low[query] != keys[rec], index.low[query], index.high[query])
                keep = known[rec] & (match != keys[rec])
                order = np.flatnonzero(keep)
                order = order[np.lexsort((match[order], rate[order], -votes[order], rate[order] > MAX_BIT_ERRORS, rec[order]))]
                rec, query, match, shift, votes, rate = (x[order] for x in (rec, query, match, shift, votes, rate))
                has = np.zeros(part.num_rows, bool)
                has[rec] = True
                heads = np.searchsorted(rec, np.flatnonzero(has))
                at = np.zeros(part.num_rows, np.int64)
                at[has] = heads
                best = pa.array([{"match_id": match[i], "frame_offset": shift[i], "votes": votes[i], "bit_error_rate": rate[i]} if h else None for i, h in zip(at.tolist(), has.tolist(), strict=True)], _MATCH)
                near = rate <= MAX_BIT_ERRORS
                ends = np.concatenate([[0], np.cumsum(np.bincount(rec[near], minlength=part.num_rows))])
                pairs = pa.StructArray.from_arrays([pa.array(x) for x in (index.low[query][near], shift[near], votes[near], rate[near])], ["query_class", "frame_offset", "votes", "bit_error_rate"])
                asks = (known & (keys % step == 0)).tolist()
                own = [index.classes.get(p) if q else None for p, q in zip(part.column(3).to_pylist(), asks, strict=True)]
                own = pa.array([None if i is None else int(index.low[i]) for i in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, own, best, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*part.schema.names, "new_class", "new_best", "new_matches"])

    return search


def _blocks(asked: DataFrame) -> Iterator[tuple]:
    """The query classes in blocks of about BLOCK codes, one block at least."""
    total = asked.agg(F.sum(F.size("codes"))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    for b in range(n):
        t = asked.where(F.pmod(F.xxhash64("print"), F.lit(n)) == b).toArrow().combine_chunks()
        low, high, prints, codes = (t.column(c).combine_chunks() for c in ("low", "high", "print", "codes"))
        yield (np.array(low.cast(pa.int64())), np.array(high.cast(pa.int64())), prints.to_pylist(), *_lists(codes))


def align(media: DataFrame, content: str, key: str, step: int = QUERY_STEP) -> DataFrame:
    """One row a recording: its best other query recording, the offset in frames, votes and bit errors; query_class and matches as told above."""
    spark = media.sparkSession
    kind = media.schema[key].dataType.simpleString()
    asked = fingerprints(media.where(F.col(key).try_cast("bigint") % step == 0), content, key).where(F.size("codes") > 0)
    asked = materialize(asked.groupBy("print").agg(F.first("codes").alias("codes"), F.min("id").alias("low"), F.max("id").alias("high")), "asked")
    match = "struct<match_id:bigint,frame_offset:bigint,votes:bigint,bit_error_rate:double>"
    rank = lambda s: F.struct(s["bit_error_rate"] <= MAX_BIT_ERRORS, s["votes"], -s["bit_error_rate"], -s["match_id"])
    out = rows = None
    for block in _blocks(asked):
        before, rows = rows, fingerprints(media, content, key) if out is None else materialize(out, "matches")
        if before is not None and "matches" in before.columns:
            discard(before)
        form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        found = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(block), step), f"{form}, new_class bigint, new_best {match}, new_matches array<{match.replace('match_id', 'query_class')}>")
        if out is not None:
            found = found.withColumns({"new_class": F.coalesce("query_class", "new_class"), "new_matches": F.concat("matches", "new_matches"), "new_best": F.when(F.col("best").isNull() | (rank(F.col("new_best")) > rank(F.col("best"))), F.col("new_best")).otherwise(F.col("best"))})
        out = found.select("key", "codes", "crc", "print", "id", F.col("new_class").alias("query_class"), F.col("new_best").alias("best"), F.col("new_matches").alias("matches"))
    aligned = F.coalesce(F.col("best.bit_error_rate") <= MAX_BIT_ERRORS, F.lit(False))
    return out.select(F.col("key").alias(key), F.size("codes").cast("long").alias("n_codes"), F.col("crc").alias("codes_crc32"), F.col("best.match_id").cast(kind).alias("match_id"), "best.frame_offset", "best.votes", "best.bit_error_rate", aligned.alias("aligned"), F.col("query_class").cast(kind).alias("query_class"), "matches")
