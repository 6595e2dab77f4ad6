"""Graph queries and operators without a relation, a length or a node left out."""

from collections import defaultdict, deque

import duckdb
import pytest

from linkloom.operators import graph
from linkloom.plans.catalog import QUERIES
from linkloom.plans.registry import VIEW_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return set(con.sql(f"SELECT DISTINCT src, dst FROM ({VIEW_SQL['v_call']})").fetchall())


def betweenness(edges):
    """Brandes's sums, each ordered pair of ends once."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        far, sigma, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def rings(edges, length):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    paths = [[a] for a in after]
    for _ in range(length - 1):
        paths = [[*p, b] for p in paths for b in after[p[-1]] if b > p[0] and b not in p]
    return {">".join(p) for p in paths if p[0] in after[p[-1]]}


def test_betweenness_of_all_relations(spark, edges):
    got = {r.node: r.betweenness for r in QUERIES["grf_betweenness_all"](spark, SF).collect()}
    assert got == pytest.approx(betweenness(edges), abs=1e-6)


def test_rings_of_all_relations(spark, edges):
    got = [r.cycle for r in QUERIES["grf_rings_all"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == rings(edges, 3)


def test_rings_of_all_lengths(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    edges = set(con.sql(f"SELECT DISTINCT src, dst FROM ({VIEW_SQL['v_call']}) WHERE relation = 'error'").fetchall())
    got = [(r.cycle, r.nodes) for r in QUERIES["grf_rings_lengths"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, n) for n in range(3, 7) for x in rings(edges, n)}


def test_paths_of_all_relations(spark, edges):
    paths = level = [["U:1", b] for a, b in edges if a == "U:1"]
    for _ in range(2):
        level = [[*p, b] for p in level for a, b in edges if a == p[-1] and b not in p]
        paths = paths + level
    assert sorted(r.path for r in QUERIES["grf_paths_all"](spark, SF).collect()) == sorted(">".join(p) for p in paths)


def test_every_victim_of_removal(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(99)], "src string, dst string")
    victims = spark.createDataFrame([(f"n{i:03}",) for i in range(2, 98)], "removed string")
    got = {r.removed: (r.components, r.nodes_left) for r in graph.removal_fragmentation(chain, victims).collect()}
    assert got == {f"n{i:03}": (2, 99) for i in range(2, 98)}
