"""The stage runner from generated tables to findings; stages rerun alone give the same tables."""

from pyspark.sql import functions as F

from linkloom import stages


def test_all_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "PEOPLE", 60)
    source, out = str(tmp_path / "none"), str(tmp_path / "out")
    took = stages.run(spark, list(stages.STAGES), source, out)
    assert list(took) == list(stages.STAGES)

    def read(name):
        return spark.read.parquet(f"{out}/{name}")

    assert read("persons").count() == 60 and read("calls").count() == 600
    records = read("records")
    assert records.count() == records.select("record_id").distinct().count() == 600 + 300 + 30
    edges = read("edges")
    assert edges.count() == edges.select("edge_id").distinct().count()
    known = read("nodes").select("id")
    assert edges.join(known, F.col("src") == F.col("id"), "left_anti").count() == 0
    assert read("communities").groupBy("node").count().where("count > 1").count() == 0
    assert read("evidence").count() == records.count()
    assert read("vectors").count() > 0
    assert read("flows").agg(F.sum("transaction_count")).first()[0] == 300
    before = sorted(map(str, edges.collect()))
    stages.run(spark, ["graph"], source, out)
    assert sorted(map(str, read("edges").collect())) == before
