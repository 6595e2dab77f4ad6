"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A text's set is its distinct k-word shingles as 64-bit hashes. One pass gathers how often shingles occur
in a table of hash buckets; it orders shingles from rare to frequent. In that order a set of n
needs only its first n - ceil(t n) + l shingles indexed for any text linked to it to share at least l of
them: the prefix is lengthened (larger l) where the estimated cost of false candidates, many and long
texts, exceeds that of more postings, and correspondingly more shared prefix shingles are required before
the sets themselves are compared.

Candidates meet in units. Every shingle indexed for two different sets hands its sets to the unit of its
smallest set, so any two linked sets meet in one unit, a set is in a unit once however many shingles it
shares, and no pairs are written out: a pair goes on only in the smallest of the units of the shingles it
shares, so that whole sets are written for few units; a unit is compared in memory, a strip of rows at a
time, and gives a spanning forest of its links. Texts with equal sets are one class from the start.

A unit too heavy for a task is compared in two rounds. In the first its sets are dealt into blocks, each
with the unit's smallest set, and every block is a task; what this links is labelled by component. In the
second only pairs of different components are left: sets outside the unit's heaviest component meet every
block. A group of near copies that is linked through its blocks costs no more than its size that way.

Postings of shingles from crowded buckets, which may be a third of all, are made distinct before they are
dealt and joined with their units; those of the others, bounded in number, are sorted by shingle.

Defined results: a text without words (or null) has an empty set and is linked with nothing. A null id is
never the name of a component; a class of null ids only is linked with nothing (component null). Rows
that repeat an id are judged by their own text. Ids may be of any type that has an order. An empty table
gives an empty result; other columns play no part. Classes and shingles are told apart by 64-bit hashes.
A task's memory is about 40 times its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import discard, join_hot, materialize, mix, release, settled, shingle_sets, spare, text_blocks, tidy

#: Binary logarithm of the buckets of the frequency table: about that of the rows, within these bounds.
SKETCH_BITS = (17, 21)
#: That of the bits of the filter of wanted ids: eight a wanted id, within these bounds.
FILTER_BITS = (20, 26)
#: A bucket is crowded from this many occurrences more than four times the mean.
CROWDED = 2000
#: Shingles that one task of a unit compares at once.
BLOCK = 1_200_000
#: What a set weighs in a unit besides its shingles: bounds the sets of a task.
SET_WEIGHT = 200
#: Rows compared at once, and cells of a matrix of sets and shingles that are worth no thought.
STRIP, SMALL = 256, 1 << 18
MOST_MATCHES = 16


def _shift(classes: np.ndarray) -> np.uint64:
    return np.uint64(65 - len(classes).bit_length())


def _counter(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                sets = shingle_sets(data, offsets, k)
                counts += np.bincount((np.concatenate(sets) >> _shift(counts)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    return run


def frequency_classes(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hash bucket, twice the binary logarithm of its count over the mean (0 to 255), and whether it is crowded."""
    bits = int(np.clip(docs.count().bit_length() - 1, *SKETCH_BITS))
    rows = docs.select(F.col(text).alias("text")).mapInArrow(tidy(_counter(k, bits)), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most 2^21 rows
    counts = np.zeros(1 << bits)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    mean = counts.mean()
    return np.clip(np.ceil(2 * np.log2(np.maximum(counts / max(mean, 1), 1))), 0, 255).astype(np.uint8), counts > 4 * mean + CROWDED


def least_overlap(n: int, percent: int) -> int:
    """How many of a set's n shingles a linked set must hold."""
    return (percent * n + 99) // 100


def prefix(shingles: np.ndarray, classes: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(l, the indexed shingles) of a set: l balances more postings against candidates to compare."""
    n = len(shingles)
    need = least_overlap(n, percent)
    kind = classes[(shingles >> _shift(classes)).astype(np.int64)]
    order = np.argsort(kind, kind="stable")
    plain = n - need + 1
    candidates = float(np.exp2(kind[order[:plain]] / 2.0).sum()) / 64
    ell = int(min(max(1, round((candidates * n / 256) ** 0.5)), MOST_MATCHES, need))
    return ell, shingles[order[: plain - 1 + ell]]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values, pa.int64()))


def _node(s: np.ndarray) -> int:
    return int(mix(s, 3).sum(dtype=np.uint64).astype(np.int64))


def _signer(k: int, percent: int, classes: np.ndarray, crowded: np.ndarray):
    """key, mark, n, node (a hash of the set), l, prefix shingles of other and of crowded buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                n, node, ells, rare, hot = [], [], [], [], []
                for s in shingle_sets(data, offsets, k):
                    ell, head = prefix(s, classes, percent) if len(s) else (0, s)
                    much = crowded[(head >> _shift(classes)).astype(np.int64)]
                    n.append(len(s))
                    node.append(_node(s) if len(s) else None)
                    ells.append(ell)
                    rare.append(head[~much])
                    hot.append(head[much])
                columns = [*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(ells, pa.int32()), _lists(rare), _lists(hot)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "mark", "n", "node", "ell", "prefix", "crowded"])

    return run


def _sharers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (token, node) in order: token, unit (its smallest set), node of each token of two sets at least."""

    def done(token: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        if len(token):
            new = np.concatenate([[True], token[1:] != token[:-1]])
            own = new | np.concatenate([[True], node[1:] != node[:-1]])
            token, node, head = token[own], node[own], np.flatnonzero(new[own])
            size = np.diff(np.append(head, len(token)))
            several = np.repeat(size > 1, size)
            token, unit, node = token[several], np.repeat(node[head], size)[several], node[several]
        else:
            unit = node
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (token, unit, node)], ["token", "unit", "node"])

    token = node = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            token, node = (np.concatenate([old, batch.column(c).to_numpy()]) for c, old in enumerate((token, node)))
            cut = int(np.searchsorted(token, token[-1]))  # the last token may go on
            yield done(token[:cut], node[:cut])
            token, node = token[cut:], node[cut:]
    yield done(token, node)


def _setter(k: int, wanted: np.ndarray):
    """Whole sets of the rows whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(1))
            batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for a, b, data, offsets in text_blocks(batch.column(0)):
                every = shingle_sets(data, offsets, k)
                sets = [s for s in every if len(s)]
                rep = batch.column(2).slice(a, b - a).filter(pa.array([len(s) > 0 for s in every], pa.bool_()))
                yield pa.RecordBatch.from_arrays([rep, pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["rep", "node", "tokens"])

    return run


class _Overlaps:
    """Intersection sizes of a few thousand sets, some rows of their matrix at a time."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        m = len(tokens)
        owner = np.repeat(np.arange(m, dtype=np.int32), self.sizes)
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        number = np.diff(np.append(starts, len(every)))
        few = 1 if m * int((number > 1).sum()) <= SMALL else 8
        a, b = [], []
        for size in range(2, few + 1):  # rare: each pair of owners is counted on its own
            at = starts[number == size]
            for i in range(size):
                for j in range(size):
                    if i != j:
                        a.append(owner[at + i])
                        b.append(owner[at + j])
        self.rare = bool(a)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.argsort(a, kind="stable")
            self.to, self.ptr = b[order], np.searchsorted(a[order], np.arange(m + 1))
        common = np.flatnonzero(number > few)
        size = number[common]
        self.width = len(common)
        self.column = np.repeat(np.arange(len(common)), size)
        self.row = owner[np.repeat(starts[common] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def rows(self, idx: np.ndarray) -> np.ndarray:
        m = len(self.sizes)
        out = np.zeros((len(idx), m), np.float32)
        if self.rare:
            size = self.ptr[idx + 1] - self.ptr[idx]
            at = np.repeat(self.ptr[idx] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            np.add.at(out, (np.repeat(np.arange(len(idx)), size), self.to[at]), 1)
        for a in range(0, self.width, 512):
            lo, hi = np.searchsorted(self.column, [a, a + 512])
            dense = np.zeros((m, min(512, self.width - a)), np.float32)
            dense[self.row[lo:hi], self.column[lo:hi] - a] = 1
            out += dense[idx] @ dense.T
        out[np.arange(len(idx)), idx] = self.sizes[idx]
        return out


def _strips(m: int) -> Iterator[np.ndarray]:
    for a in range(0, m, STRIP):
        yield np.arange(a, min(m, a + STRIP))


def _candidates(n: np.ndarray, ell: np.ndarray, percent: int, idx: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Pairs of the rows idx and all with enough shared prefix shingles and sizes that allow a link.

    Of two sets, the one whose prefix ends first has every common shingle either in both prefixes or among
    its own rest, of least_overlap - l shingles; so a link, which takes percent / (100 + percent) of both
    sizes, needs what the longer rest leaves open to be shared within the prefixes.
    """
    mine = n[idx]
    rest = least_overlap(n, percent) - ell
    least = -(-percent * np.add.outer(mine, n) // (100 + percent)) - np.maximum.outer(rest[idx], rest)
    ok = shared >= np.maximum(least, np.minimum.outer(ell[idx], ell))
    return ok & (100 * np.minimum.outer(mine, n) >= percent * np.maximum.outer(mine, n))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _grouped(handle: Callable, names: list[str]):
    """Runs handle over each (unit, i, j) of rows that come sorted by these; a set given twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            keys = [table.column(c).to_numpy() for c in ("unit", "i", "j")]
            change = np.zeros(len(keys[0]), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(change)]
            table = table.combine_chunks()
            lists = {c: _flat(table.column(c)) for c in ("tokens", "homes") if c in table.column_names}
            node, label, n, ell, unit = (table.column(c).to_numpy() for c in ("node", "label", "n", "ell", "unit"))
            out: dict[str, list] = {c: [] for c in names}
            upto = len(cuts) - 1 if last else len(cuts) - 2
            for a, b in zip(cuts[:upto], cuts[1 : upto + 1], strict=True):
                if b - a > 1:
                    at = a + np.unique(node[a:b], return_index=True)[1]
                    if len(at) > 1:
                        rows = [[values[ends[r] : ends[r + 1]] for r in at.tolist()] for values, ends in lists.values()]
                        for c, v in zip(names, handle(unit[a], node[at], label[at], n[at], ell[at].astype(np.int64), *rows), strict=True):
                            out[c].append(v)
            done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64), pa.int64()) for c in names], names)
            return done, table.slice(cuts[upto])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            done, rest = groups(table, False)
            yield done
        if rest is not None and rest.num_rows:
            yield groups(rest, True)[0]

    return run


def _survivors(percent: int):
    """The sets with a candidate of another label in this unit, each pair in the smallest unit of the shingles it shares only."""

    def handle(unit, node, label, n, ell, tokens, homes):
        every, before, upto = _Overlaps(tokens), None, None
        some = np.zeros(len(node), bool)
        for idx in _strips(len(node)):
            pairs = _candidates(n, ell, percent, idx, every.rows(idx)) & (label[idx][:, None] != label)
            if pairs.any():
                if before is None:
                    before, upto = (_Overlaps([t[keep(h)] for t, h in zip(tokens, homes, strict=True)]) for keep in (lambda h: h < unit, lambda h: h <= unit))
                pairs &= (upto.rows(idx) > 0) & (before.rows(idx) == 0)
                some[idx] |= pairs.any(1)
                some |= pairs.any(0)
        return np.full(int(some.sum()), unit), node[some]

    return handle


def _links(percent: int):
    """A spanning forest of the links; sets of one label are linked already."""

    def handle(unit, node, label, n, ell, tokens):
        every, m = _Overlaps(tokens), len(node)
        linked = []
        for idx in _strips(m):
            both = every.rows(idx)
            linked.append(np.packbits(100 * both >= percent * (n[idx][:, None] + n - both), axis=1))
        linked = np.concatenate(linked)  # a bit a pair
        _, label = np.unique(label, return_inverse=True)
        free = np.ones(m, bool)
        a, b = [], []
        for i in range(m):  # by node: the rows come in its order
            if not free[i]:
                continue
            todo = np.flatnonzero(label == label[i])
            free[todo] = False
            while len(todo):  # every label reached from i is written once, linked to i
                near = np.zeros(m, bool)
                for s in range(0, len(todo), STRIP):
                    near |= np.unpackbits(np.bitwise_or.reduce(linked[todo[s : s + STRIP]], axis=0), count=m).astype(bool)
                found, first = np.unique(label[near & free], return_index=True)
                a += [node[i]] * len(found)
                b += node[np.flatnonzero(near & free)[first]].tolist()
                todo = np.flatnonzero(np.isin(label, found) & free) if len(found) else found
                free[todo] = False
        return np.array(a, np.int64), np.array(b, np.int64)

    return handle


def _blocks(weight: Column) -> Column:
    """How many blocks of half a task's weight; one where the whole fits a task."""
    return F.when(weight > BLOCK, F.ceil(weight / (BLOCK // 2))).otherwise(1).cast("int")


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _first_round(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows dealt to tasks (unit, i, j), and the units that take more than one task, None if there is none.

    units: unit, node, n, ell, w. Every block of a heavy unit holds the unit's smallest set.
    """
    heavy = units.groupBy("unit").agg(F.sum("w").alias("total"), F.min("node").alias("leader")).where(F.col("total") > BLOCK)
    heavy = settled(heavy.select("unit", "leader", _blocks(F.col("total")).alias("blocks")), "heavy")
    zero = F.lit(0).alias("i")
    if heavy.isEmpty():
        return units.select("unit", zero, zero.alias("j"), "node", F.col("node").alias("label"), "n", "ell"), None
    place = F.when(F.isnull("blocks"), F.array(F.lit(0))).when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_own("blocks")))
    rows = units.join(heavy, "unit", "left").withColumn("i", F.explode(place))
    return rows.select("unit", "i", F.col("i").alias("j"), "node", F.col("node").alias("label"), "n", "ell"), heavy


def _second_round(units: DataFrame) -> DataFrame:
    """Rows dealt so that all pairs of different labels in a unit meet in a task.

    units: unit, node, label, n, ell, w. A unit of a single label takes no task.
    """
    by_label = units.groupBy("unit", "label").agg(F.sum("w").alias("w"))
    plan = by_label.groupBy("unit").agg(F.max_by("label", F.struct("w", "label")).alias("top"), (F.sum("w") - F.max("w")).alias("others"), F.sum("w").alias("total"))
    plan = plan.where("others > 0").select("unit", "top", _blocks(F.col("total")).alias("blocks"), _blocks(F.col("others")).alias("strips"))
    rows = units.join(plan, "unit")
    met = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda i: F.struct(i.alias("i"), _own("blocks").alias("j")))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(_own("strips").alias("i"), j.alias("j")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("label") == F.col("top"), met).otherwise(F.array_union(met, meets))))
    return rows.select("unit", "p.i", "p.j", "node", "label", "n", "ell")


def _compared(dealt: DataFrame, lists: DataFrame, on: list[str], handle: Callable, names: list[str]) -> DataFrame:
    """Joins the shingles in lists to what was dealt and runs handle task by task."""
    rows = dealt.join(lists, on).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return rows.mapInArrow(tidy(_grouped(handle, names)), ", ".join(f"{c} bigint" for c in names))


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex reachable, for every vertex of edges (a, b). Label propagation with pointer jumping."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "v"), "labels")
    total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
        step = materialize(step.join(jump, "root").select("v", F.least("root", "up").alias("root")), "labels")
        now = step.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        discard(labels)
        labels = step
        if now == total:
            break
        total = now
    discard(both)
    return labels


def _wanted(nodes: DataFrame, named: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the ids that name these nodes' classes: its bytes and the number of its bits."""
    wanted = nodes.select("node").distinct().join(named, "node").select("rep")
    bits = int(np.clip((8 * wanted.count()).bit_length(), *FILTER_BITS))
    words = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(1 << bits)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("at"))
    table = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits")).toArrow()  # at most 2^21 rows
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return bitmap.view(np.uint8), bits


def _classes(docs: DataFrame, k: int, percent: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: key, mark (a hash of the text), n, node for every row; node, component for every class."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    classes, crowded = frequency_classes(docs, text, k)
    form = f"key {kind}, mark bigint, n bigint, node bigint, ell int, prefix array<bigint>, crowded array<bigint>"
    signed = materialize(source.select("key", F.xxhash64("text").alias("mark"), "text").mapInArrow(tidy(_signer(k, percent, classes, crowded)), form), "signed")
    ids = materialize(signed.select("key", "mark", "n", "node"), "ids")
    named = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("rep"), F.max("n").alias("n"), F.max("ell").alias("ell"))
    named = materialize(named, "classes")

    valid = signed.where("key IS NOT NULL")
    rare = valid.select(F.explode("prefix").alias("token"), "node").repartition("token").sortWithinPartitions("token", "node")
    rare = rare.mapInArrow(tidy(_sharers), "token bigint, unit bigint, node bigint")
    hot = valid.select(F.explode("crowded").alias("token"), "node").distinct()
    homes = hot.groupBy("token").agg(F.min("node").alias("unit"), F.max("node").alias("far")).where("unit <> far").drop("far")
    shared = materialize(rare.unionByName(hot.join(homes, "token").select("token", "unit", "node")), "shared")
    discard(signed)
    release(spark)
    lists = shared.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.collect_list("unit").alias("homes"))
    lists = materialize(lists.join(named.where("rep IS NOT NULL"), "node"), "lists")
    units = shared.select("unit", "node").distinct().join(lists.select("node", "n", "ell", (F.size("tokens") + SET_WEIGHT).alias("w")), "node")
    tokens = lists.select("node", "tokens", "homes")
    dealt, heavy = _first_round(units)
    alive = materialize(_compared(dealt, tokens, ["node"], _survivors(percent), ["unit", "node"]).distinct(), "alive")
    release(spark)

    def sized(alive: DataFrame) -> DataFrame:
        return alive.join(named, "node").withColumn("w", F.col("n") + SET_WEIGHT)

    def sets(alive: DataFrame) -> DataFrame:
        bitmap, bits = _wanted(alive, named)
        bit = F.pmod(F.xxhash64("key"), F.lit(1 << bits)).alias("bit")
        return source.where("key IS NOT NULL").select("text", bit, "key").mapInArrow(tidy(_setter(k, bitmap)), f"rep {kind}, node bigint, tokens array<bigint>")

    dealt, more = _first_round(sized(alive).drop("rep"))
    dealt = dealt.join(named.select("node", "rep"), "node")
    edges = materialize(_compared(dealt, sets(alive), ["node", "rep"], _links(percent), ["a", "b"]), "links")
    discard(alive)
    release(spark)
    roots = components(edges)

    again = [h.select("unit") for h in (heavy, more) if h is not None]
    if again:
        label = F.coalesce("root", "node").alias("label")
        roots = roots.withColumnRenamed("v", "node")
        left = units.join(again[0] if len(again) == 1 else again[0].union(again[1]).distinct(), "unit").join(roots, "node", "left").select("unit", "node", label, "n", "ell", "w")
        alive = materialize(_compared(_second_round(left), tokens, ["node"], _survivors(percent), ["unit", "node"]).distinct(), "alive")
        left = sized(alive).join(roots, "node", "left").select("unit", "node", label, "n", "ell", "w")
        dealt = _second_round(left).join(named.select("node", "rep"), "node")
        late = materialize(_compared(dealt, sets(alive), ["node", "rep"], _links(percent), ["a", "b"]), "links")
        discard(roots)
        roots = components(edges.union(late))
        discard(late)
        discard(alive)
        release(spark)
    for done in (shared, lists, edges):
        discard(done)

    roots = roots.withColumnRenamed("v", "node")
    smallest = materialize(roots.join(named, "node").groupBy("root").agg(F.min("rep").alias("component")), "smallest")
    rooted = join_hot(named.join(roots, "node", "left"), smallest, lambda left, right: F.col(f"{left}.root") == F.col(f"{right}.root"), "left")
    final = materialize(rooted.select("l.node", F.coalesce("r.component", "l.rep").alias("component")), "components")
    for done in (named, roots, smallest):
        discard(done)
    return ids, final


def _judged(ids: DataFrame, final: DataFrame) -> DataFrame:
    """ids with each row's component; rows without words, which may be many, stay out of the join."""
    bare = ids.where("node IS NULL").withColumn("component", F.col("key"))
    return ids.where("node IS NOT NULL").join(final, "node", "left").select("key", "mark", "n", "component").unionByName(bare.drop("node"))


def join(docs: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest id reachable by links) for every row.

    Two texts are linked when 100 * |A and B| >= percent * |A or B|.
    """
    out = _judged(*_classes(docs, k, percent, text, key))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of docs for each component, the one whose id names it (rows with a null id stay), with docs' columns.

    Where rows repeat the id that names a component, one of them stays: of different texts that with the
    smallest hash. Rows without words stay, one for each id.
    """
    ids, final = _classes(docs, k, percent, text, key)
    kept = _judged(ids, final).where(F.col("key") == F.col("component")).groupBy("key", "mark").agg(F.count(F.lit(1)).alias("times"))
    kept = kept.groupBy("key").agg(F.min(F.struct("mark", "times")).alias("one"))
    kept = materialize(kept.select("key", "one.mark", "one.times"), "kept")
    discard(ids)
    discard(final)
    name, mark, times = (spare(docs.columns, c) for c in ("kept_id", "kept_mark", "kept_times"))
    kept = kept.toDF(name, mark, times)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(kept, (F.col(key) == F.col(name)) & (F.xxhash64(text) == F.col(mark)))
    once = rows.where(F.col(times) == 1).select(*columns)
    again = rows.where(F.col(times) > 1).dropDuplicates([key]).select(*columns)
    return once.unionByName(again).unionByName(docs.where(F.col(key).isNull()))


#: All pairs that share a shingle are compared: for small inputs. 64-bit hashes are not needed here.
ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * inter >= 85 * (len(x.s) + len(y.s) - inter)),
reach(v, r) AS (SELECT a, b FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(reach.r), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON reach.v = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
