"""Operators without SQL against plain re-computations, and the pipeline on awkward rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import license_scan, quality_classifier, quality_rules, sharding, toxicity
from linkloom.llm.common import text_blocks

SF = "/root/testdata/sf0.001"


def test_network_against_plain_loops():
    """The forward pass by definition: windows, chunks of two halves, maxima, mean, largest and smallest."""
    net = quality_classifier.ByteNet(seed=5)
    r = np.random.default_rng(2)
    net.p["head"] = r.normal(0, 1, len(net.p["head"])).astype(np.float32)
    w, stride, per = quality_classifier.WIDTH, quality_classifier.STRIDE, quality_classifier.SEGMENT // quality_classifier.STRIDE
    for text in (b"", b"abc", b"A plain sentence of some words.", bytes(r.integers(32, 126, 700).tolist()), bytes(r.integers(0, 256, 4001).tolist())):
        data = text + b"\0" * max(0, w - len(text))
        if (len(data) - w) % stride:
            data += b"\0"
        outs = []
        for a in range(0, len(data) - w + 1, stride):
            x = [v for byte in data[a : a + w] for v in net.p["embed"][byte].tolist()]
            outs.append([sum(x[k] * float(net.p["filters"][k, f]) for k in range(len(x))) + float(net.p["bias"][f]) for f in range(net.p["filters"].shape[1])])
        tops = [[max(o[f] for o in outs[a : a + per]) for f in range(len(outs[0]))] for a in range(0, len(outs), per)]
        chunks = [[max(0.0, v) for v in tops[0]]] if len(tops) == 1 else [[max(0.0, p, q) for p, q in zip(x, y, strict=True)] for x, y in zip(tops[:-1], tops[1:], strict=True)]
        columns = list(zip(*chunks, strict=True))
        z = sum(float(h) * v for h, v in zip(net.p["head"], [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns], strict=True)) + float(net.p["head_bias"][0])
        assert abs(net.probability(np.frombuffer(text, np.uint8)) - 1 / (1 + math.exp(-z))) < 1e-4


def test_chain_against_plain_loops():
    """Scores of a small chain text by text, category by category."""
    texts = ["you fool you", "a calm day", "", "fool and knave", "day"]
    block = next(iter(text_blocks(pa.array(texts))))
    number, hashes = toxicity.features(block[2], block[3])
    known = np.unique(hashes)[::2]
    r = np.random.default_rng(4)
    chain = toxicity.Chain(np.sort(known), r.normal(0, 1, (len(known), 3)), r.normal(0, 1, 3), np.tril(r.normal(0, 0.5, (3, 3)), -1))
    got = next(iter(toxicity.scorer(chain)(iter([pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["key", "text"])]))))
    for i in range(len(texts)):
        held = {h for t, h in zip(number.tolist(), hashes.tolist(), strict=True) if t == i}
        odds = []
        for j, name in enumerate(toxicity.CATEGORIES):
            z = chain.bias[j] + sum(chain.weights[k, j] for k, h in enumerate(chain.hashes.tolist()) if h in held) + sum(chain.links[j, m] * o for m, o in enumerate(odds))
            z = min(30.0, max(-30.0, z))
            odds.append(min(6.0, max(-6.0, z)))
            assert abs(got.column(name)[i].as_py() - 1 / (1 + math.exp(-z))) < 1e-9


def test_posteriors_against_plain_maximisation(spark):
    """Expectation-maximisation over single documents gives the posteriors that the histogram gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    featured = quality_rules.with_features(docs.select("doc_id", "text"))
    votes = [tuple(r) for r in featured.select(*(v.alias(k) for k, v in quality_rules.rule_votes(F.col(quality_rules.FEATURED)).items()), "doc_id").collect()]
    rows = [(v[:-1], v[-1]) for v in votes]
    prior, good, bad = 0.8, [0.9] * 8, [0.7] * 8
    weight = 0.01 * len(rows) + 1

    def posterior(v):
        g = b = 1.0
        for x, p, q in zip(v, good, bad, strict=True):
            g *= p if x > 0 else 1 - p if x < 0 else 1
            b *= 1 - q if x > 0 else q if x < 0 else 1
        return prior * g / (prior * g + (1 - prior) * b)

    for _ in range(40):
        q = [posterior(v) for v, _ in rows]
        new_good, new_bad = [], []
        for j in range(8):
            up = sum(p for (v, _), p in zip(rows, q, strict=True) if v[j] == 1)
            down = sum(p for (v, _), p in zip(rows, q, strict=True) if v[j] == -1)
            new_good.append(min(0.995, max(0.5, (up + 0.9 * weight) / (up + down + weight))))
            up = sum(1 - p for (v, _), p in zip(rows, q, strict=True) if v[j] == 1)
            down = sum(1 - p for (v, _), p in zip(rows, q, strict=True) if v[j] == -1)
            new_bad.append(min(0.995, max(0.05, 1 - new_good[-1], (down + 0.7 * weight) / (up + down + weight))))
        prior, good, bad = min(0.98, max(0.2, (sum(q) + 0.8 * weight) / (len(rows) + weight))), new_good, new_bad
    want = {i: posterior(v) for v, i in rows}
    got = quality_rules.score(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.posterior - want[r.doc_id]) < 1e-6
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_suppression_against_all_pairs():
    r = random.Random(6)
    for _ in range(60):
        found = []
        for i in range(r.randint(0, 40)):
            a = r.randint(0, 60)
            found.append((a, a + r.randint(1, 20), "x", f"r{i % 7}", r.randint(0, 4), 0.5))
        kept = []
        for d in sorted(found, key=lambda d: (d[4], d[0] - d[1], d[0], d[3])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert license_scan.suppressed(found) == kept


def test_lookup_table_against_turns():
    """Every shard walks its own permutation; each turn takes the first slot of it that is free."""
    names, slots = [f"s{i}" for i in range(7)], 101
    walks = []
    for n in names:
        start, step = sharding._number(n, "start") % slots, sharding._number(n, "step") % (slots - 1) + 1
        walk = [(start + i * step) % slots for i in range(slots)]
        assert sorted(walk) == list(range(slots))
        walks.append(walk)
    owner, turn = {}, 0
    while len(owner) < slots:
        shard = turn % len(names)
        owner[next(s for s in walks[shard] if s not in owner)] = shard
        turn += 1
    assert sharding.lookup_table(names, slots) == [owner[s] for s in range(slots)]
    assert max(Counter(owner.values()).values()) - min(Counter(owner.values()).values()) <= 1


def test_conflicting_labels_and_repeated_ids_are_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.labelled_sample(docs, labels, "quality").collect()
    assert len({r.k for r in rows}) == len(rows) <= 9 and 3 not in {r.k for r in rows}
    assert toxicity.fit(docs, labels).weights.shape[1] == len(toxicity.CATEGORIES)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    words = " ".join(f"word{i} is fine." for i in range(60))
    rows = [(1, words, "en", "a", 1, "x", 0), (2, words, "en", None, 1, "x", 0), (None, words + " more", "en", "a", 1, "x", 0), (3, None, None, None, None, None, 0), (4, "", "en", "a", 0, "x", 0), (1, words, "en", "a", 1, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __ll_f string, __h int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in kept.collect()} <= {1, 2, None}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    labels.write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
