"""The alignment of recordings: no query, short recording or further partner is left out."""

import numpy as np

from linkloom.llm import media


def noise(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def aligned(spark, rows):
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, audio binary")
    return {r.id: r for r in media.align(table, "audio", "id").collect()}


def test_query_of_middle_id(spark):
    a, b = noise(1, 3200), noise(2, 3200)
    rows = [(100, a + noise(3, 12800) + b), (200, a + b), (300, a + noise(4, 6400) + b), (7, a + b)]
    got = aligned(spark, rows)
    assert (got[7].match_id, got[7].frame_offset, got[7].bit_error_rate, got[7].aligned) == (200, 0, 0.0, True)
    assert got[7].votes == got[7].n_codes


def test_short_recordings(spark):
    short, lone, steady = noise(5, 760), noise(6, 90), b"\x05" * 3000
    rows = [(100, short), (1, short), (200, lone), (2, lone), (3, noise(7, 760)), (300, steady), (4, steady)]
    got = aligned(spark, rows)
    assert [(got[i].match_id, got[i].n_codes, got[i].votes, got[i].aligned) for i in (1, 2)] == [(100, 1, 1, True), (200, 1, 1, True)]
    assert not got[3].aligned and (got[4].match_id, got[4].frame_offset, got[4].votes, got[4].aligned) == (300, 0, got[4].n_codes, True)


def brute(c, q):
    """(shift, votes, bit error rate) of the best shift of two lists of codes, None without enough votes."""
    best = None
    for shift in range(-len(c) + 1, len(q)):
        at = [(c[i], q[i + shift]) for i in range(max(0, -shift), min(len(c), len(q) - shift))]
        votes = sum(x == y for x, y in at)
        if votes >= min(3, len(c), len(q)):
            wrong = sum(int(x ^ y).bit_count() for x, y in at) / (32 * len(at))
            best = max(best or (0, 0, 0), (votes, -wrong, -shift))
    return best and (-best[2], best[0], -best[1])


def test_all_aligned_pairs(spark, monkeypatch):
    a, b = noise(8, 3200), noise(9, 3200)
    worse = a[:1600] + bytes(range(0, 250, 25)) * 480
    rows = [(100, a), (200, a), (300, b), (400, a[:1500]), (500, worse), (1, a + b), (2, worse[:4000] + b), (3, a), (4, a[:700]), (None, a)]
    codes = {i: media.fingerprint(*media.decode(x)) for i, x in rows}
    near = {}
    for i in codes:
        tried = {q: brute(codes[i].tolist(), codes[q].tolist()) for q in (100, 300, 400, 500)} if i else {}
        near[i] = {(q, *t) for q, t in tried.items() if t and t[2] <= 0.2 and (q != i or q == 100)}
    assert len(near[1]) > 1 and any(len(x) > 2 for x in near.values())
    for size in (media.BLOCK, 60):
        monkeypatch.setattr(media, "BLOCK", size)
        got = aligned(spark, rows)
        assert {i: {tuple(m) for m in r.matches} for i, r in got.items()} == near
        assert {i: r.query_class for i, r in got.items()} == {100: 100, 200: 100, 300: 300, 400: 400, 500: 500} | dict.fromkeys([1, 2, 3, 4, None])
        assert (got[100].match_id, got[200].match_id) == (200, 100) and all(r.aligned == bool(near[i]) for i, r in got.items())


def test_best_shift_survives_any_cut(monkeypatch):
    codes = [media.fingerprint(np.frombuffer(noise(12, 4000), np.uint8).astype(np.float32)), np.array([7, 8] * 30, np.uint32), np.array([7] * 25, np.uint32)]
    flat, starts = np.concatenate(codes), np.cumsum([0, *map(len, codes)])
    index = media._Index(np.array([1, 2, 3]), np.array([1, 2, 3]), [b"1", b"2", b"3"], flat, starts)
    whole = [x.tolist() for x in index.search(flat, starts)]
    monkeypatch.setattr(media, "CHUNK", 5)
    assert [x.tolist() for x in index.search(flat, starts)] == whole
    assert [(r, q) for r, q, s, v, e in zip(*whole, strict=True) if r == q and (s, e) == (0, 0)] == [(0, 0), (1, 1), (2, 2)]
