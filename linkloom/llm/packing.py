"""Order-preserving packing of token streams into sequences of at most CAPACITY tokens.

Each task streams its texts in order, encodes them and cuts the stream by dynamic programming: cut points
are the ends of documents and sentences, and every token where no sentence ends within reach; a window
costs its padding plus a penalty for what its cut splits (nothing at a document's end, little at a
sentence's, more elsewhere). The best earlier cut for each point is the front of a monotone queue over
the points in reach, so the work is linear. The stream is settled block by block and memory is bounded
by a block and the longest text. The last window of a task may be cut at powers of two, which need no
padding. There is no shuffle, and a lost task is simply run again.

Encoding gives the tokenizer's own ids. A block of texts is cut into units as whole arrays: runs of ASCII
letters, single digits and runs of other characters, or a whole word where it holds anything else. Units are
told apart by 64-bit hashes; new ones of plain ASCII go through byte-pair merging vectorised over all of a
length at once, other words through the tokenizer itself, and what was found is kept for the next blocks.

Defined results: a null or empty text is one piece, the end id alone. Null ids and repeated rows are
packed like any row, each on its own. An empty table gives an empty result. Sequence numbers are unique:
the task's number times 2^33 plus a running number.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import BYTE_CODES, LOWER_BYTES, mix, powers, text_blocks, tidy

CAPACITY, END = 2048, 1
SENTENCE_PENALTY, INSIDE_PENALTY = 4, 48
BLOCK_TOKENS = 1 << 19
READ_BYTES = 1 << 19
CACHE_UNITS, SMALL_PART, LONGEST_UNIT = 1_000_000, 60_000, 64
#: Units of up to so many bytes are merged together.
WIDTHS = (3, 6, 9, 12, 18, 32)
#: What a byte is to the cutting of units: between words, a letter, a digit, anything else, or unfit for it.
_BETWEEN, _LETTER, _DIGIT, _OTHER, _UNFIT = range(5)
_KIND = np.full(256, _UNFIT, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[9, 10, 13, 32]] = _BETWEEN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[39, 60]] = _UNFIT  # the apostrophe begins pieces of its own, "<" the names of special tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to the ids of a tokenizer file of byte-pair merges with word ends."""

    #: Fixed value: the tokenizer's own pattern of pieces.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
    PLAIN = regex.compile(r"[!-;=-~\xa1-\xac\xae-ȳ]+")
    SLOTS = 1 << 18

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab = spec["vocab"]
        self.suffix = spec["end_of_word_suffix"]
        bytes_as = self._byte_names()
        self.first = np.array([vocab[bytes_as[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[bytes_as[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(keys))[order], made
        slot = self._slot(self.keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.ranks = self.keys[by], self.ranks[by]
        self.starts = np.searchsorted(slot[by], np.arange(self.SLOTS + 1))
        self.deepest = int(np.diff(self.starts).max())
        self.keys = np.append(self.keys, np.full(self.deepest, -1))
        self.ranks = np.append(self.ranks, np.zeros(self.deepest, np.int64))
        self.stops = np.array(sorted({vocab[x + self.suffix] for x in ".!?" if x + self.suffix in vocab} | {vocab[x] for x in (".</w>", "!</w>", "?</w>") if x in vocab}), np.uint32)
        self.is_stop = np.zeros(max(self.whole.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.is_stop[self.stops] = True
        self._forget()

    def _forget(self) -> None:
        """Empties the table of known units: a large and a small part, each of sorted hashes with the place and number of their ids."""
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts = [nothing, nothing]
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of units; number -1 where a unit is not known."""
        at, count = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1)
        for known, places, counts in self.parts:
            if len(known):
                where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[where] == hashes
                at[hit], count[hit] = places[where[hit]], counts[where[hit]]
        return at, count

    def _keep(self, hashes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Adds units to the small part of the table, which goes into the large one as it grows."""
        at = self.used + np.cumsum(count) - count
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        new = (hashes, at, count)
        for level in (1, 0):
            new = tuple(np.concatenate(x) for x in zip(self.parts[level], new, strict=True))
            by = np.argsort(new[0])
            new = tuple(x[by] for x in new)
            if level == 1 and len(by) < SMALL_PART:
                self.parts[1] = new
                return
        empty = tuple(x[:0] for x in new)
        self.parts = [new, empty]

    @staticmethod
    def _byte_names() -> list[str]:
        """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
        out, extra = [], 0
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                out.append(chr(b))
            else:
                out.append(chr(256 + extra))
                extra += 1
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 18)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a large number where there is none."""
        keys = a << 20 | b
        at = self.starts[self._slot(keys)]
        out = np.full(len(keys), 1 << 30)
        left = np.arange(len(keys))
        for _ in range(self.deepest):  # entries of one slot stand together
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.ranks[at[hit]]
            more = ~hit
            left, at = left[more], at[more] + 1
            if not len(left):
                break
        return out

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units given as rows of bytes, of which each has its size, and their numbers: the best-ranked pair goes next, leftmost first."""
        n, length = data.shape
        every = np.arange(n)
        ids = self.first[data]
        ids[every, size - 1] = self.last[data[every, size - 1]]
        size = size.copy()
        if length > 1:
            ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, -1)
            ranks[np.arange(length - 1)[None, :] >= (size - 1)[:, None]] = 1 << 30
            live = np.flatnonzero(size > 1)
            while len(live):
                r = ranks[live]
                at = r.argmin(1)
                best = r[np.arange(len(live)), at]
                go = best < 1 << 30
                live, at, best = live[go], at[go], best[go]
                if not len(live):
                    break
                cols = np.arange(length)[None, :]
                shift = np.minimum(cols + (cols > at[:, None]), length - 1)
                rows = np.take_along_axis(ids[live], shift, 1)
                rows[np.arange(len(live)), at] = self.made[best]
                ids[live] = rows
                size[live] -= 1
                left = size[live]
                moved = np.minimum(np.arange(length - 1)[None, :] + (np.arange(length - 1)[None, :] >= at[:, None]), length - 2)
                rr = np.take_along_axis(ranks[live], moved, 1)
                rr[np.arange(length - 1)[None, :] >= (left - 1)[:, None]] = 1 << 30
                for side in (at - 1, at):
                    ok = np.flatnonzero((side >= 0) & (side + 1 < left))
                    rr[ok, side[ok]] = self._rank(rows[ok, side[ok]], rows[ok, side[ok] + 1])
                ranks[live] = rr
        return ids, size

    def _by_width(self, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Which units go through merging together, and in rows of how many bytes."""
        low = 0
        for width in (*WIDTHS, max(int(lengths.max(initial=0)), WIDTHS[-1])):
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(which):
                yield width, which

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each unit, as bytes."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for width, which in self._by_width(lengths):
            rows = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in which.tolist()]), np.uint8).reshape(-1, width)
            ids, size = self.merge(rows, lengths[which])
            flat = ids.astype(np.uint32).tobytes()
            for k, (i, n) in enumerate(zip(which.tolist(), size.tolist(), strict=True)):
                out[i] = flat[4 * k * width : 4 * (k * width + n)]
        return out

    def _is_plain(self, word: str) -> bool:
        if len(word) > 64:
            return False
        if word.isascii():
            return word.isprintable() and "<" not in word
        return bool(self.PLAIN.fullmatch(word))

    def _whole_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that were not cut into units."""
        found: dict[str, bytes] = {}
        plain, other = [], []
        for w in words:
            (plain if self._is_plain(w) else other).append(w)
        if other:
            for w, e in zip(other, self.whole.encode_batch(other, add_special_tokens=False), strict=True):
                found[w] = np.array(e.ids, np.uint32).tobytes()
        if plain:
            pieces = self.PIECES.findall("\n".join(plain).lower())
            unique = list(set(pieces) - {"\n"})
            ids = dict(zip(unique, self.merge_words([u.encode() for u in unique]), strict=True))
            ids["\n"] = b""
            cuts = [-1, *[i for i, p in enumerate(pieces) if p == "\n"], len(pieces)]
            every = [ids[p] for p in pieces]
            for w, a, b in zip(plain, cuts[:-1], cuts[1:], strict=True):
                found[w] = b"".join(every[a + 1 : b])
        return [found[w] for w in words]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, whole: np.ndarray) -> None:
        """Adds units to the table: their hashes, places in data, lengths, and whether they are uncut words."""
        new_ids, counts, order = [], [], []
        for width, which in self._by_width(np.where(whole, 0, lengths)):
            places = np.minimum(begins[which][:, None] + np.arange(width), len(data) - 1)
            ids, size = self.merge(LOWER_BYTES[data[places]], lengths[which])
            new_ids.append(ids[np.arange(width) < size[:, None]].astype(np.uint32))
            counts.append(size)
            order.append(which)
        which = np.flatnonzero(whole)
        if len(which):
            words = [data[b : b + n].tobytes().decode() for b, n in zip(begins[which].tolist(), lengths[which].tolist(), strict=True)]
            made = self._whole_words(words)
            new_ids.append(np.frombuffer(b"".join(made), np.uint32))
            counts.append(np.array([len(m) // 4 for m in made], np.int64))
            order.append(which)
        self._keep(hashes[np.concatenate(order)], np.concatenate(counts), np.concatenate(new_ids))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after the other, and the number of each; end closes every text."""
        if sum(len(p[0]) for p in self.parts) > CACHE_UNITS:
            self._forget()
        texts = len(offsets) - 1
        kind = _KIND[data]
        inside = kind != _BETWEEN
        at = np.flatnonzero(inside)
        if len(at):
            begin = np.empty(len(data), bool)
            begin[0], begin[1:] = inside[0], inside[1:] & ~inside[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(data)]
            begin[cuts] = inside[cuts]
            word = np.flatnonzero(begin[at])
            size = np.diff(np.append(word, len(at)))
            whole = np.bitwise_or.reduceat(kind[at] == _UNFIT, word) | (size > LONGEST_UNIT)
            uncut = np.zeros(len(data), bool)
            uncut[at] = np.repeat(whole, size)
            turn = np.empty(len(data), bool)
            turn[0], turn[1:] = True, kind[1:] != kind[:-1]
            begin |= inside & ~uncut & (turn | (kind == _DIGIT))
            head = np.flatnonzero(begin[at])
            size = np.diff(np.append(head, len(at)))
            place = np.arange(len(at)) - np.repeat(head, size)
            kept = data[at]
            with np.errstate(over="ignore"):
                codes = BYTE_CODES[np.where(uncut[at], kept, LOWER_BYTES[kept])] * powers(int(size.max()))[place]
                hashes = mix(np.add.reduceat(codes, head))
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            where, count = self._find(unique)
            fresh = count < 0
            if fresh.any():
                f = first[fresh]
                self._learn(data, unique[fresh], at[head[f]], size[f], uncut[at[head[f]]])
                where, count = self._find(unique)
            where, count = where[back], count[back]
            upto = np.cumsum(count)
            flat = self.ids[np.repeat(where - (upto - count), count) + np.arange(upto[-1])]
            ends = np.concatenate([[0], upto])[np.searchsorted(at[head], offsets)]
        else:
            flat, ends = np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        each = np.diff(ends)
        if end is None:
            return flat, each
        out = np.full(len(flat) + texts, end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(texts), each)] = flat
        return out, each + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in text_blocks(pa.array(texts, pa.large_string()), READ_BYTES):
            flat, each = self.encode_block(data, offsets)
            out += np.split(flat, np.cumsum(each)[:-1])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_points(points: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Positions at which to cut, the last point included; points rise from above 0 and gaps fit the capacity.

    cost(j) = min over i within capacity of cost(i) + capacity - (points[j] - points[i]) + penalties[j];
    cost(i) + points[i] is kept in a monotone queue.
    """
    size = len(points) + 1
    value, place, which = [0.0] * size, [0] * size, [-1] * size  # the queue: cost + position, position, point
    head, tail = 0, 1
    back: list[int] = []
    keep = back.append
    for j, (p, fee) in enumerate(zip(points.tolist(), penalties.tolist(), strict=True)):
        while place[head] < p - capacity:
            head += 1
        keep(which[head])
        new = value[head] + capacity + fee
        while tail > head and value[tail - 1] >= new:
            tail -= 1
        value[tail], place[tail], which[tail] = new, p, j
        tail += 1
    out, j = [], len(points) - 1
    while j >= 0:
        out.append(int(points[j]))
        j = back[j]
    return out[::-1]


def tail_cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths for a task's last tokens: powers of two while they save more padding than a cut costs."""
    out = []
    while length:
        power = 1 << (length.bit_length() - 1)
        if length == power or capacity - length <= INSIDE_PENALTY or power < INSIDE_PENALTY:
            out.append(length)
            break
        out.append(power)
        length -= power
    return out


def choose(ends: np.ndarray, sentences: np.ndarray, total: int, capacity: int = CAPACITY) -> list[int]:
    """Cuts of a stream of total tokens given the positions after each document and each sentence."""
    fee = np.full(total + 1, -1, np.int32)
    fee[sentences] = SENTENCE_PENALTY
    fee[ends] = 0
    fee[0] = 0
    fee[total] = max(0, fee[total]) if fee[total] >= 0 else INSIDE_PENALTY
    points = np.flatnonzero(fee >= 0)
    wide = np.flatnonzero(np.diff(points) > capacity // 4)
    if len(wide):  # any token may be cut where sentences are far apart
        points = np.unique(np.concatenate([points, *(np.arange(points[w], points[w + 1], 16) for w in wide.tolist())]))
    points = points[1:]
    return cut_points(points, np.where(fee[points] < 0, INSIDE_PENALTY, fee[points]), capacity)


SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(path: str, capacity: int, with_ids: bool):
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        # What waits to be packed: ids, and of each text its key, its number of ids and where its first one would stand.
        streams: list[np.ndarray] = []
        keys: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        ahead, waiting = 0, 0  # ids of the first text that are packed already, ids that wait

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal streams, keys, tokens, ahead, waiting, serial
            stream, key, size = np.concatenate(streams), pa.concat_arrays(keys), np.concatenate(tokens)
            ends = np.cumsum(size) - ahead
            sentences = np.flatnonzero(enc.is_stop[stream]) + 1
            cuts = choose(ends, sentences[sentences < len(stream)], len(stream), capacity)
            if last:
                at = cuts[-2] if len(cuts) > 1 else 0
                cuts = [*cuts[:-1], *(at + np.cumsum(tail_cuts(len(stream) - at, capacity))).tolist()]
            else:  # the last windows wait for what follows
                cuts = cuts[: max(1, len(cuts) - 4)]
            cut = np.array(cuts, np.int64)
            upto = np.union1d(cut, ends[ends <= cut[-1]])
            begin = np.concatenate([[0], upto[:-1]])
            doc, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(cut, begin, "right")
            raw = memoryview(np.ascontiguousarray(stream, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), upto.tolist(), strict=True)]
            columns = [key.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (begin - (ends - size)[doc], upto - begin, crc, size[doc], serial + seq, begin - np.concatenate([[0], cut])[seq]))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, upto[-1]), pa.int32()), pa.array(stream[: upto[-1]].view(np.int32), pa.int32())))
            serial += len(cut)
            done = int(np.searchsorted(ends, cut[-1], "right"))
            streams, keys, tokens = [stream[cut[-1] :]], [key.slice(done)], [size[done:]]
            waiting = len(stream) - int(cut[-1])
            ahead = int(size[done]) - int(ends[done] - cut[-1]) if done < len(size) else 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1), READ_BYTES):
                flat, each = enc.encode_block(data, offsets, END)
                streams.append(flat)
                keys.append(batch.column(0).slice(a, b - a))
                tokens.append(each)
                waiting += len(flat)
                if waiting >= BLOCK_TOKENS:
                    yield settle(False)
        if waiting:
            yield settle(True)

    return run


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, {SCHEMA}" + ", ids array<int>" * with_ids
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(_packer(path or tokenizer_path(), capacity, with_ids)), schema)
    return out.withColumnRenamed("key", key) if key != "key" else out
