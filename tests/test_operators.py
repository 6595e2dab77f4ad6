"""Operators on small hand-made tables."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import extraction, flows, graph, records
from linkloom.operators.intervals import before_incident
from linkloom.sources import tables

DAY = dt.datetime(2025, 1, 1)


def tx(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, amount decimal(18,4), ts timestamp_ntz")


def test_smurfing_first_window(spark):
    from decimal import Decimal

    rows = [("p%d" % i, "sink", Decimal(40000), DAY + dt.timedelta(hours=i)) for i in range(4)]
    got = flows.smurfing(tx(spark, rows), 50000, 1).collect()
    assert [(r.dst, r.n, r.severity) for r in got] == [("sink", 4, "MEDIUM")]


def test_layering_counts_rows(spark):
    from decimal import Decimal

    rows = [("i%d" % i, "a", Decimal(10000), DAY + dt.timedelta(hours=i)) for i in range(6)] + [("a", "o%d" % i, Decimal(9500), DAY + dt.timedelta(days=i)) for i in range(6)]
    got = {r.account: r for r in flows.layering(tx(spark, rows), 7).collect()}
    assert set(got) == {"a"} and got["a"].retention == pytest.approx(0.05)


def test_incident_window_is_half_open(spark):
    at = lambda h, m: DAY + dt.timedelta(hours=h, minutes=m)
    events = spark.createDataFrame([("x", at(18, 0)), ("x", at(17, 38)), ("x", at(18, 10)), ("x", at(19, 0)), ("x", at(18, 30)), ("x", at(17, 30))], "k string, ts timestamp_ntz")
    incidents = spark.createDataFrame([(1, "x", at(18, 30))], "incident_id int, k string, incident_ts timestamp_ntz")
    assert sorted(r.ts.minute for r in before_incident(events, incidents, "k", "ts", 1).collect()) == [0, 10, 30, 38]


def test_snapshot_keeps_undated_edges(spark):
    e = spark.createDataFrame([("A", "B", DAY), ("B", "C", DAY + dt.timedelta(days=2)), ("C", "D", None)], "src string, dst string, ts timestamp_ntz")
    assert graph.as_of(e, "2025-01-02 00:00:00").count() == 2
    assert graph.between(e, "2025-01-02 00:00:00", "2025-01-05 00:00:00", undated=False).count() == 1


def test_components_and_removal(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    cut = graph.removal_fragmentation(spark.createDataFrame([("b", "c"), ("c", "d"), ("d", "a"), ("p", "q")], "src string, dst string"), spark.createDataFrame([("c",)], "removed string"))
    assert cut.collect()[0].components == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("+91 98400 12345",), ("09840012345",), ("9840012345",), ("12",)], "p string")
    assert [r[0] for r in df.select(T.phone(F.col("p"))).collect()] == ["9840012345"] * 3 + [None]
    m = spark.createDataFrame([("He denied it",), ("the alleged thief",), ("it may be",), ("it is",)], "t string")
    assert [r[0] for r in m.select(T.modality(F.col("t"))).collect()] == ["DENIED", "ALLEGED", "UNCERTAIN", "FACTUAL"]
    ns = str(uuid.NAMESPACE_DNS)
    assert spark.range(1).select(T.uuid5(ns, F.lit("a.example"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a.example"))


def test_mentions_resolve_overlaps(spark):
    df = spark.createDataFrame([(1, "mail a@b.com on 2025-01-02"), (2, None)], "id int, t string")
    assert [(r.label, r.surface) for r in extraction.domain_mentions(df, "t", "id").orderBy("start").collect()] == [("EMAIL", "a@b.com"), ("DATE", "2025-01-02")]


def test_complete_linkage(spark):
    pairs = spark.createDataFrame([("b", 1, 2, 0.9), ("b", 2, 3, 0.8), ("b", 4, 5, 0.7), ("b", 4, 6, 0.6), ("b", 5, 6, 0.5)], "block string, a int, b int, score double")
    got = {r.member: r.cluster for r in records.complete_linkage(pairs, "block").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}


def test_triplets_reject_with_reason(spark):
    df = spark.createDataFrame([("a", "KNOWS", "b"), ("a", None, "b")], "Subject string, predicate string, OBJECT string")
    good, bad = tables.triplets(df)
    assert [tuple(r) for r in good.collect()] == [("a", "KNOWS", "b")] and bad.collect()[0].reason == "missing relation"


def test_raw_csv(spark, tmp_path):
    (tmp_path / "meetings.csv").write_text("meeting_id,location,timestamp,attendee_ids\nm1,L,2025-01-01 10:00:00,a|b|\n")
    assert tables.read_all_raw(spark, str(tmp_path))["meetings"].first().attendee_ids == ["a", "b"]
    (tmp_path / "calls.csv").write_text("call_id\n1\n")
    with pytest.raises(tables.MissingColumns):
        tables.read_raw(spark, str(tmp_path / "calls.csv"), "calls")
