"""Dealt joins give what a plain join gives."""

import itertools

from pyspark.sql import functions as F

from linkloom.operators import records, skew


def test_dealt_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 3)
    left = [(k, n) for k, size in (("hub", 20), ("pair", 2), ("one", 1), (None, 4)) for n in range(size)]
    a = spark.createDataFrame(left, "z string, x int")
    b = a.select("z", F.col("x").alias("y"))
    got = skew.meet(a, b, a.groupBy("z").agg(F.count(F.lit(1)).alias("size")), "z", "x")
    plain = sorted((k, n, m) for (k, n), (j, m) in itertools.product(left, left) if k is not None and k == j)
    assert sorted((r.z, r.x, r.y) for r in got.collect()) == plain
    assert skew.meet(a.limit(0), b, a.limit(0).groupBy("z").agg(F.count(F.lit(1)).alias("size")), "z", "x").count() == 0


def test_name_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 2)
    names = ["ann bell", "ann bells", "ann ball", "amy b", "ann bellsworth", "ann bell", "bo cy", None, ""]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")

    def distance(p, q):
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row = row, [i]
            for j, d in enumerate(q, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    first = {}
    for i, n in enumerate(names):
        first.setdefault(n, i)
    want = {}
    for p, q in itertools.combinations(sorted(n for n in first if n), 2):
        same = p.split()[0][0] == q.split()[0][0] and p.split()[-1][0] == q.split()[-1][0] and len(p.split()) == len(q.split())
        score = round(1 - distance(p, q) / max(len(p), len(q)), 6)
        if same and score >= 0.7:
            want[first[p], first[q]] = score
    got = {(r.a, r.b): r.similarity for r in records.name_pairs(rows, "name", "id", 0.7).collect()}
    assert got == want and want
