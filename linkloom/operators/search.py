"""Filters, lookups and set joins of the investigation's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions.numbers import exact_round

#: Fixed value: what the relation of a money transfer contains.
TRANSFER = "TRANSFER|FINANCIAL|PAID"


def triplets(rows: DataFrame, relation: str | None = None, source: str | None = None, target: str | None = None, least: float | None = None) -> DataFrame:
    """By relation, ends and least confidence; a missing confidence is 0."""
    for column, value in (("relation", relation), ("src", source), ("dst", target)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows if least is None else rows.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def entities(nodes: DataFrame, edges: DataFrame, kind: str | None = None, least: int = 0) -> DataFrame:
    """nodes with mentions (ends of edges), by type and least mentions; a node without edges has 0."""
    seen = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
    rows = nodes if kind is None else nodes.where(F.col("entity_type") == kind)
    out = rows.join(seen, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0).cast("long")))
    return out.where(F.col("mentions") >= least)


def patterns(rows: DataFrame, kind: str | None = None, severity: str | None = None) -> DataFrame:
    """By type, compared in upper case, and severity."""
    rows = rows if kind is None else rows.where(F.col("pattern_type") == kind.upper())
    return rows if severity is None else rows.where(F.col("severity") == severity)


def findings(rows: DataFrame, status: str | None = None, least: float | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """By status and least confidence; with a limit the surest, ties by key."""
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if least is None else rows.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    return rows if limit is None else rows.orderBy(F.desc("confidence"), key).limit(limit)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page (numbered from 1) in a stated order, with the total; a page holds at most 500 rows."""
    size = min(size, 500)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))  # one row


def everywhere(nodes: DataFrame, ghosts: DataFrame | None, evidence: DataFrame, needles: list[str], limit: int) -> DataFrame:
    """result_type, id, kind of what holds one of the needles: nodes by name or id first, then ghosts, then evidence."""

    def holds(*columns: str) -> Column:
        hay = F.lower(F.concat_ws(" ", *columns))
        out = F.lit(False)
        for n in needles:
            out |= F.contains(hay, F.lit(n.lower()))
        return out

    first = needles[:1]
    out = nodes.where(F.contains(F.lower(F.concat_ws(" ", "label", "id")), F.lit(first[0].lower()))).select(F.lit(0).alias("part"), F.lit("node").alias("result_type"), "id", F.col("entity_type").alias("kind"))
    if ghosts is not None:
        out = out.unionByName(ghosts.where(holds("id", "label")).select(F.lit(1).alias("part"), F.lit("ghost").alias("result_type"), "id", F.lit("GHOST").alias("kind")))
    out = out.unionByName(evidence.where(holds("text")).select(F.lit(2).alias("part"), F.lit("evidence").alias("result_type"), F.col("evidence_id").alias("id"), F.col("source_type").alias("kind")))
    return out.orderBy("part", "id").limit(limit).drop("part")


def subgraph(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose source is among the ids of one table and whose target among those of the other."""
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def transfer_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.upper("relation").rlike(TRANSFER))


def touching(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows joined with the members at either end; a row with both ends in a group comes once for it.

    The two equi-joins are united and made distinct: no join on an OR.
    """
    at = lambda end: rows.join(members.withColumnRenamed("node", end), end)
    other = [c for c in members.columns if c != "node"]
    columns = [*rows.columns, *other]
    return at("src").select(*columns).union(at("dst").select(*columns)).distinct()


def meets_any(rows: DataFrame, array: str, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose array holds at least one id of wanted (node)."""
    hit = rows.select(key, F.explode(array).alias("node")).join(wanted, "node", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_semi")


def events_of(rows: DataFrame, name: str, participants: str = "participants") -> DataFrame:
    return rows.where(F.exists(participants, lambda p: p["name"] == name))


def evidence_nodes(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """evidence with each node it names that exists."""
    e = evidence.withColumn("node", F.explode("nodes"))
    return e.join(nodes.select(F.col("id").alias("node"), "label"), "node")


def edge_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """src, dst, evidence (sorted ids), n of the records behind each pair's edges."""
    hit = edges.join(evidence.select("evidence_id", F.col("record_id").alias("edge_id")), "edge_id")
    return hit.groupBy("src", "dst").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence"), F.count(F.lit(1)).alias("n"))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def resolve_endpoints(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (source, target, ...) with src and dst, the smallest id of each name; rows with an unknown end are dropped."""
    known = nodes.groupBy(name_key(F.col("label")).alias("k")).agg(F.min("id").alias("guid"))
    rows = rows.withColumns({"__s": name_key(F.col("source")), "__t": name_key(F.col("target"))})
    rows = rows.join(known.select(F.col("k").alias("__s"), F.col("guid").alias("src")), "__s")
    return rows.join(known.select(F.col("k").alias("__t"), F.col("guid").alias("dst")), "__t").drop("__s", "__t")


def shared_key_pairs(keys: DataFrame, key: str, block: str) -> DataFrame:
    """Pairs a < b of ids that share a block, once each."""
    rows = keys.where(F.col(block).isNotNull()).select(key, block).distinct()
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, block).where(F.col(f"a.{key}") < F.col(f"b.{key}")).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).distinct()


def overlapping_sets(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """Pairs a < b of owners with the number of items that both have."""
    rows = rows.select(owner, item).distinct()
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, item).where(F.col(f"a.{owner}") < F.col(f"b.{owner}"))
    return both.groupBy(F.col(f"a.{owner}").alias("a"), F.col(f"b.{owner}").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def within_km(points: DataFrame, km: float) -> DataFrame:
    """Pairs a < b of points (id, lat, lon) at most km apart: cells of the size, each with its neighbours, then the exact distance.

    Cells are km wide in latitude; in longitude as wide as km is at the band's outer latitude. Points beyond
    85 degrees share one cell a band; the date line is not crossed.
    """
    size = km / 111.0
    band = F.floor(F.col("lat") / size)

    def wide(b: Column) -> Column:
        return size / F.greatest(F.cos(F.radians(F.least(F.lit(85.0), (F.abs(b) + 2) * size))), F.lit(0.08))

    near = points.withColumns({"b": F.explode(F.array(band - 1, band, band + 1))}).withColumn("c", F.floor(F.col("lon") / wide(F.col("b"))))
    own = points.withColumn("b", band).withColumn("c", F.explode(F.array(*(F.floor(F.col("lon") / wide(F.col("b"))) + d for d in (-1, 0, 1)))))
    a, b = own.alias("a"), near.alias("b")
    distance = F.round(T.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3)
    met = a.join(b, ["b", "c"]).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("km"))
    return met.where(F.col("km") <= km).distinct()


def case_links(rows: DataFrame, mo: float = 0.5, entity: float = 0.6) -> DataFrame:
    """rows (case_id, entity, mo): pairs of cases whose ways of working or entities overlap enough (Jaccard), scored by the mean of both."""

    def overlap(item: str, name: str) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy("case_id").agg(F.countDistinct(item).alias("n"))
        return overlapping_sets(rows, "case_id", item).withColumnRenamed("shared", name), sizes

    (e, e_size), (m, m_size) = overlap("entity", "en"), overlap("mo", "mn")
    both = e.join(m, ["a", "b"], "full")
    for size, x in ((e_size, "e"), (m_size, "m")):
        for end in ("a", "b"):
            both = both.join(size.select(F.col("case_id").alias(end), F.col("n").alias(f"{x}{end}")), end)
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda n, a, b: F.round(zero(n) / (F.col(a) + F.col(b) - zero(n)), 6)
    out = both.select("a", "b", share("en", "ea", "eb").alias("entity_overlap"), share("mn", "ma", "mb").alias("mo_overlap"))
    out = out.where((F.col("mo_overlap") >= mo) | (F.col("entity_overlap") >= entity))
    return out.withColumn("score", exact_round((F.col("entity_overlap") + F.col("mo_overlap")) / 2, 6))
