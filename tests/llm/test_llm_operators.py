"""Each operator against brute force on a table of odd rows, and on an empty one."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import license_scan, media, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, key string, score string, size long, stack string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + ("." if j % 9 == 8 else "") for j, i in enumerate(r.integers(0, len(WORDS), n)))


BASE = sentence(1, 400)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE.replace("alpha", "ALPHA", 3)), (3, BASE + " extra words here"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "one two three"),
    (8, "one two three"), (9, "One two THREE"), (10, sentence(2, 300)), (11, sentence(3, 60)), (11, sentence(3, 60)), (None, BASE), (None, None), (12, "x " * 300), (13, "word\n" * 80),
    (14, "MIT License and GNU General-Public License, Apache License; CC BY-NC 4.0. " + sentence(4, 80)), (15, "spdx-license-identifier: MIT"), (16, "é ÉCOLE naïve ß <|endoftext|> don't 12345 中文 " * 30), (17, sentence(5, 25000)),
    (18, "### *** $$$ %%% " * 40), (19, sentence(6, 120).upper() + "!!!!"), (100, BASE), (200, sentence(7, 500)), (201, sentence(7, 500) + " tail"),
]
SOURCES = [None, "a", "b", "aé", "A", "", "a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", SOURCES[n % len(SOURCES)], 7, 8, "k", "key", "s", 9, "st") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def by_text(df, value):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(value(r))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(function):
    out = defaultdict(list)
    for i, t in TEXTS:
        out[i].append(function(t))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def base_counts(t):
    w, t = words(t), t or ""
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    covered = {i + j for i, x in enumerate(tri) if many[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_rules(docs, empty):
    got = quality_rules.score(docs)
    assert by_text(got, lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) == expected(base_counts)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {0, 1, 3, 200} <= kept and not kept & {4, 5, 6, 12, 18}
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs).count() == got.where("kept").count()
    assert quality_rules.score(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20000) < 0.8
    votes = np.where(r.random((20000, 4)) < [0.95, 0.9, 0.85, 0.6], np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[r.random((20000, 4)) < 0.3] = 0
    model = quality_rules.fit(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert np.allclose(model.good, [0.95, 0.9, 0.85, 0.6], atol=0.05) and abs(model.prior - 0.8) < 0.05


def test_mixing_matches_sorting(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r, (s,) in zip(got, [(None,)] * len(got), strict=True):
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for r in got:
        sizes[r.source_size, r.target] += r.taken
    largest = max(r.size for r in got)
    for (source_size, target), taken in sizes.items():
        assert abs(taken - target) <= max(2 * largest, 1), (source_size, target, taken)
    assert sorted(map(repr, mixing.mix(docs.repartition(7)).collect())) == sorted(map(repr, got))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def shingles(t, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, k, percent):
    keyed = [(i, shingles(t, k)) for i, t in TEXTS if i is not None]
    root = {i: i for i, _ in keyed}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in keyed:
        for j, b in keyed:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = ngram_join.join(docs, k, percent)
    rows = [r for r in got.collect() if r.doc_id is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted((i, len(s), find(i)) for i, s in keyed)
    kept = ngram_join.one_of_each(docs, k, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _ in keyed if find(i) == i})
    assert ngram_join.join(empty, k, percent).count() == 0


@pytest.mark.parametrize(("block", "crowded"), [(2000, 2000), (2000, 5), (1_200_000, 5)])
def test_ngram_join_splits_large_units(spark, monkeypatch, block, crowded):
    """Heavy units go through blocks and the second round, and shingles of crowded buckets take their own way."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        w = BASE.split()
        for at in r.integers(0, len(w), i % 9):
            w[at] = f"w{r.integers(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 4) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {x.doc_id: x.component_id for x in ngram_join.join(df).collect()} == {i: find(i) for i in sets}


def test_ngram_join_second_round_links_over_blocks(spark, monkeypatch):
    """Two clusters share rare shingles but only some sets link: every link over blocks is found."""
    monkeypatch.setattr(ngram_join, "BLOCK", 1500)
    monkeypatch.setattr(ngram_join, "SET_WEIGHT", 100)
    r = np.random.default_rng(8)
    words_ = [f"q{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(words_)
        for at in r.integers(0, len(w), 1 + i % 4):
            w[at] = f"z{i}"
        rows.append((f"id-{i:03d}", " ".join(w), i, i, i))
    df = spark.createDataFrame(rows, "doc_id string, text string, kept_id int, times int, kept_mark int")
    sets = {x[0]: shingles(x[1], 4) for x in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert {x.doc_id: x.component_id for x in ngram_join.join(df).collect()} == {i: find(i) for i in sets}
    kept = ngram_join.one_of_each(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({find(i) for i in sets})


def test_ngram_join_rows_that_share_an_id(spark):
    """Of two texts under one id only that which names its component stays; ids of text work."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [("k1", a), ("k2", b), ("k2", c), ("k1", c), ("k1", a), (None, a), ("k3", None), ("k3", ""), ("k4", b)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    kept = sorted((x.doc_id or "", x.text or "") for x in ngram_join.one_of_each(df, 5, 80).collect())
    assert len(kept) == 4 and kept[0] == ("", a) and kept[2] == ("k2", b) and kept[3][0] == "k3"
    assert kept[1][0] == "k1" and kept[1][1] in (a, c)


def test_packing_round_trip(docs, empty):
    got = packing.pack(docs, with_ids=True)
    rows = got.collect()
    whole = packing.encoder(packing.tokenizer_path()).whole
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in TEXTS)
    pieces = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.sequence_id].append(r)
    total = sum(len(x) * n for (_, x), n in want.items())
    assert sum(r.length for r in rows) == total
    for s in pieces.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    single = defaultdict(list)
    for r in rows:
        if Counter(i for i, _ in TEXTS)[r.doc_id] == 1:
            single[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, x in want:
        if i in single:
            assert sum((p[1] for p in sorted(single[i])), []) == list(x) and all(p[2] == len(x) for p in single[i])
    assert packing.pack(empty).count() == 0


def test_cut_points_are_optimal():
    r = np.random.default_rng(1)
    for _ in range(30):
        points = np.cumsum(r.integers(1, 6, 14))
        fees = r.integers(0, 5, 14)
        best = {0: 0.0}
        for p, f in zip(points.tolist(), fees.tolist(), strict=True):
            best[p] = min(best[q] + 10 - (p - q) for q in best if p - q <= 10) + f
        cuts = packing.cut_points(points, fees, 10)
        cost, at = 0, 0
        for c in cuts:
            cost += 10 - (c - at) + fees[points.tolist().index(c)]
            at = c
        assert cost == best[int(points[-1])]


def test_license_scan(docs, empty):
    def base(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
        return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    got = license_scan.summary(docs)
    assert by_text(got, lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) == expected(base)
    rows = {r.doc_id: r for r in got.collect()}
    assert "cc-by-nc-4.0" in rows[14].labels and "cc-by-4.0" not in rows[14].labels and rows[15].labels == "mit" and rows[0].score == 0
    assert len(license_scan.rules()) > 200 and license_scan.summary(empty).count() == 0


def test_url_filters(spark):
    urls = ["http://a.example.com/en/12?x", "https://EXAMPLE.com/en/7#t", "x.example.com/en/7", None, "", "http://com/en/1", "ftp://evilcom/en/1", "http://example.net/de/81", "http://b.example.net/de/9", "http://example.org/es/", "http://example.org?/es/", "http://example.com.evil.org/es/1", "://", "http://example.com/EN/7"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("stack", F.lit(1))

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filters.judge(df.where("false")).count() == 0
    none = url_filters.judge(df, rules=url_filters.rule_table(spark, ()))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_sharding(docs, empty, tmp_path):
    table = sharding.lookup_table()
    counts = np.bincount(table, minlength=64)
    assert counts.max() - counts.min() <= 1
    moved = np.mean(np.array(table) != np.array(sharding.lookup_table(sharding.SHARDS[:-1])))
    assert moved < 0.1
    for r in sharding.place(docs).collect():
        import hashlib

        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(empty).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=100)


SF = "/root/testdata/sf0.01"


def test_quality_classifier_held_out(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(d, labels)
    got = quality_classifier.score(d, model).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.9
    assert quality_classifier.score(docs, model).where("score BETWEEN 0 AND 1").count() == len(TEXTS)
    assert quality_classifier.keep_accepted(docs, model).columns == docs.columns
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.score(docs, quality_classifier.fit(empty, labels)).count() == len(TEXTS)


def test_gradients_match_differences():
    net = quality_classifier.ByteNet()
    net.p["head"] = np.random.default_rng(0).normal(0, 1, net.p["head"].shape).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.frombuffer(BASE.encode(), np.uint8)
    g = net.gradients(data, 1.0, 1.0)
    loss = lambda: -np.log(net.probability(data))
    for name, at in (("head", (5,)), ("bias", (2,)), ("filters", (3, 4)), ("embed", (101, 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def test_toxicity_held_out(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.is_toxic == (got.toxic == 1)).mean() >= 0.9
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(empty, labels)).count() == len(TEXTS)


def tones(seed, n, rate=8000):
    r = np.random.default_rng(seed)
    t = np.arange(400) / rate
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (r.integers(0, 24) / 12) * t) for _ in range(n)])


def wav(x, rate=8000):
    import struct

    body = (np.clip(x, -1, 1) * 32000).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_media_alignment(spark):
    song, other = tones(1, 60), tones(2, 60)
    noise = np.random.default_rng(5).normal(0, 0.01, len(song))
    rows = [(100, wav(song)), (1, wav(song + noise)), (2, wav(song[64 * 40 :])), (3, wav(other)), (200, wav(tones(9, 50))), (4, None), (5, b""), (None, wav(song)), (6, wav(song[:500]))]
    got = {r.id: r for r in media.align(spark.createDataFrame(rows, "id long, audio binary"), "audio", "id").collect()}
    assert (got[1].match_id, got[1].frame_offset, got[1].aligned) == (100, 0, True)
    assert (got[2].match_id, got[2].frame_offset, got[2].aligned) == (100, 40, True)
    assert not got[3].aligned and got[4].n_codes == got[5].n_codes == 0 and not got[100].aligned and not got[None].aligned
    assert len(got) == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
