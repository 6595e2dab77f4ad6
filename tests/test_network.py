"""Graph operators without an oracle against plain Python on small graphs, sources, and streams over several batches."""

import json
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.operators import ghosts, links, network
from linkloom.operators.graph import modularity, removal_fragmentation
from linkloom.sources import loaders
from linkloom.streaming import windows


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def parts(pairs, nodes):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    seen, count = set(), 0
    for n in nodes:
        if n not in seen:
            count += 1
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    return count


CLIQUES = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]


def test_communities_of_cliques(spark):
    e = frame(spark, CLIQUES)
    got = network.louvain(e)
    rows = {r.node: r.community for r in got.collect()}
    groups = defaultdict(set)
    for n, c in rows.items():
        groups[c].add(n[0])
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    assert rows == {r.node: r.community for r in network.louvain(e.repartition(5)).collect()}
    whole = spark.createDataFrame([(n, 0) for n in rows], "node string, community int")
    assert modularity(e, got).first()[0] > modularity(e, whole).first()[0]


def test_bridges_and_articulation_points(spark):
    r = random.Random(4)
    for _ in range(2):
        pairs = {tuple(sorted(r.sample(range(14), 2))) for _ in range(17)}
        pairs = [(f"n{a}", f"n{b}") for a, b in pairs]
        nodes = sorted({x for p in pairs for x in p})
        base = parts(pairs, nodes)
        want = {tuple(sorted(p)) for p in pairs if parts([q for q in pairs if q != p], nodes) > base}
        assert {(x.a, x.b) for x in network.bridges(frame(spark, pairs)).collect()} == want
    twice = frame(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    assert [(x.a, x.b) for x in network.bridges(twice).collect()] == [("b", "c")]
    line = frame(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    cut = removal_fragmentation(line, spark.createDataFrame([("b",), ("d",)], "removed string")).collect()
    assert {x.removed: x.components for x in cut} == {"b": 1, "d": 1}  # the end that b leaves alone has no edge


def test_ghosts_of_a_planted_graph(spark):
    nodes, edges, truth = loaders.planted_graph(spark, 4, 6)
    members = nodes.where("entity_type = 'PERSON'").select(F.col("id").alias("node"), F.substring_index(F.substring("id", 2, 9), "-", 1).alias("community"))
    holes = members.select("node", F.lit(0.5).alias("hole"))
    e = edges.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    found = ghosts.evaluate(e, nodes, members, holes, least_confidence=0.15, least_affinity=0.15)
    assert {(r.a, r.b) for r in found.where("proposed").collect()} == {(r.a, r.b) for r in truth.collect()}
    predicted = ghosts.broker_edges(found, e, members, holes, ghosts.contacts(e, nodes, members)).collect()
    assert {r.node for r in predicted} == {f"P{c}-{j}" for c in range(4) for j in (0, 1)}
    assert all(0 <= r.probability <= 0.99 for r in predicted)
    many = ghosts.second_opinion(edges.select("src", "dst"), members, nodes, members.select("node", F.lit(0.0).alias("betweenness"))).collect()
    assert len(many) == 6 and max(many, key=lambda r: r.evidence).evidence > 0


def test_learned_links(spark):
    rows = spark.createDataFrame([(float(i % 7), float((i * 5) % 11), int(i % 7 > 3)) for i in range(300)], "a double, b double, label int")
    for kind in ("logistic", "forest", "boosted"):
        model = links.train(rows, ["a", "b"], kind=kind)
        got = links.probability(model, rows)
        right = got.where((F.col("probability") >= 0.5) == (F.col("label") == 1)).count()
        assert right > 280, kind
        assert links.importance(model, ["a", "b"])[0][0] == "a"
    both = links.stacked(rows, ["a", "b"])
    assert links.stacked_probability(both, rows).where((F.col("probability") >= 0.5) == (F.col("label") == 1)).count() > 280


def test_walks_and_vectors(spark):
    e = frame(spark, CLIQUES)
    rows = links.walks(e, 6, 2).collect()
    near = {frozenset(p) for p in CLIQUES}
    assert len(rows) == 30 and all(len(r.path) == 6 and all(frozenset(p) in near for p in zip(r.path, r.path[1:], strict=False)) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, links.walks(e.repartition(3), 6, 2).collect()))
    v = links.mean_aggregated(e, links.embeddings(e, 8), 2).collect()
    assert len(v) == 15 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-6 for r in v)


def test_triplet_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"Relations": [{"Subject": {"name": "A", "type": "PERSON"}, "predicate": "MET", "object": "B", "object_type": "ORG", "when": 3}, {"subject": "A", "object": "B"}, "x", {"head": " ", "relation": "R", "tail": "B"}]}))
    (tmp_path / "b.json").write_text("[{\"from\": \"A\", \"rel\": \"R\", \"to\": {\"id\": 7}}]")
    (tmp_path / "c.json").write_text("no")
    good, bad = loaders.read_triplets(spark, str(tmp_path))
    rows = {(r.source, r.source_type, r.relation, r.target, r.target_type) for r in good.collect()}
    assert rows == {("A", "PERSON", "MET", "B", "ORG"), ("A", None, "R", "7", None)}
    assert sorted(r.reason for r in bad.collect()) == ["missing relation", "missing source", "no JSON", "no object"]
    assert {r.attributes.get("when") for r in good.collect()} == {"3", None}


def test_pdf_pages_and_images(spark, tmp_path):
    page = zlib.compress(b"BT (Hello \\(PDF\\)) Tj [(wor) -20 (ld and more text)] TJ ET")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nstream\n" + page + b"\nendstream\n2 0 obj\nstream\nBT (short) Tj ET\nendstream\n")
    rows = sorted(loaders.read_pdf(spark, str(tmp_path)).collect(), key=lambda r: r.page)
    assert [(r.text, r.needs_ocr) for r in rows] == [("Hello (PDF)world and more text", False), ("short", True)]
    (tmp_path / "y.png").write_bytes(b"seen")
    assert loaders.read_images(spark, str(tmp_path), lambda b: b.decode().upper(), "*.png").first().text == "SEEN"


def test_pages_are_retried_with_growing_pauses():
    waits, calls = [], []

    def get(page):
        calls.append(page)
        if len(calls) < 4:
            raise OSError
        return [{"a": page}]

    assert loaders.fetch(get, 7, 5, waits.append) == [{"a": 7}] and waits == [1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        loaders.fetch(lambda p: (_ for _ in ()).throw(OSError()), 1, 5, waits.append)
    assert max(waits) == 10.0


def test_stores_and_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text("x")
    (tmp_path / "b.txt").write_text("yy")
    assert loaders.list_objects(spark, str(tmp_path)) == [("a/1.txt", 1), ("b.txt", 2)]
    assert loaders.list_objects(spark, str(tmp_path), "a/", 1) == [("a/1.txt", 1)]
    assert loaders.inside("/r", "a/./b") == "/r/a/b"
    for key in ("../x", "/etc", "a/../../x"):
        with pytest.raises(ValueError):
            loaders.inside("/r", key)
    with pytest.raises(ValueError):
        loaders.record_ddl("x; drop table y")
    nodes, edges = frame(spark, [("a", "b")]).select(F.col("src").alias("id")), frame(spark, [("a", "b")])
    loaders.write_graph(nodes, edges, str(tmp_path / "g"))
    assert loaders.read_graph(spark, str(tmp_path / "g"))[1].count() == 1
    with pytest.raises(ValueError):
        loaders.to_pandas(spark.range(10), 5)


def test_generated_data_agree_whatever_the_partitions(spark):
    a = loaders.generate(spark, 200)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b = loaders.generate(spark, 200)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    for name in a:
        assert sorted(map(repr, a[name].collect())) == sorted(map(repr, b[name].collect())), name
    assert a["persons"].where("is_hidden_coordinator").count() == 2
    assert a["calls"].where("caller_id = receiver_id").count() == 0
    reports = loaders.incident_reports(a["persons"], 50)
    assert reports.count() == 50 and reports.where("narrative LIKE '% reported a % allegedly by %'").count() == 50
    assert loaders.duplicate_records(spark, 10).groupBy("entity_id").count().where("count = 3").count() == 10


def test_structuring_over_several_batches(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 00:00:00", 30.0) for d in (1, 2, 3, 5)] + [(1, "2024-01-05 10:00:00", 39.0), (1, "2024-01-05 20:00:00", 39.0), (1, "2024-01-05 21:00:00", 39.0), (2, "2024-01-01 00:00:00", 39.0)]
    schema = "user_id long, ts timestamp_ntz, value double"
    for i in range(0, len(rows), 2):
        spark.createDataFrame([(u, t, v) for u, t, v in rows[i : i + 2]], "user_id long, t string, value double").selectExpr("user_id", "CAST(t AS timestamp_ntz) AS ts", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from pyspark.sql.types import _parse_datatype_string

    stream = spark.readStream.schema(_parse_datatype_string(schema)).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.run_to_end(windows.structuring(stream, 40.0), str(tmp_path / "ck")).collect()
    assert len(out) == 1 and out[0].user_id == 1 and out[0].total > 120
