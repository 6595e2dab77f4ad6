"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash of its id and text. For each source, words are summed by hash bucket;
the first bucket whose running sum passes the budget is the boundary, and only that bucket is cut again,
twelve bits at a time, down to a single hash value. A document is taken if its hash lies below the
boundary: a filter, with no sort of documents. A source whose target exceeds its size is taken whole as
often as fits and once more below a threshold.

Defined results: a null or empty text has size 0 and is never counted; a null source is a source of its
own, ranked last; a null id hashes as an empty one. Repeated rows share a hash and are taken together.
An empty table gives an empty result. Other columns of the input play no part, whatever their names.
Tables with a row a source are held by the driver and broadcast if they are few, counted, else written and
joined over salted copies; a source that holds most rows stays spread either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import discard, join_hot, materialize, settled, spare, word_count

BITS, LEVELS = 12, 5
MAX_EPOCHS = 3


def hash60(key: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From __s (source or null), __n (words): adds each source's target. One row per source.

    The weighted shares are water-filled: in order of cap over weight, a source is capped if its share of
    what the earlier ones leave exceeds its cap; the rest share the remainder by weight.
    """
    per = sizes.groupBy("__s").agg(F.sum("__n").alias("__size"))
    by_name = Window.orderBy(F.col("__s").asc_nulls_last())
    per = per.withColumn("__w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("__size") / F.col("__w"), F.col("__s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("__size") * MAX_EPOCHS
    d = "decimal(38,0)"
    per = per.withColumns({"__all": F.sum("__size").over(everything), "__wsum": F.sum("__w").over(everything), "__sb": F.coalesce(F.sum(cap).over(before), F.lit(0)), "__wb": F.coalesce(F.sum("__w").over(before), F.lit(0))})
    per = per.withColumn("__capped", (F.col("__all") - F.col("__sb")).cast(d) * F.col("__w") > cap.cast(d) * (F.col("__wsum") - F.col("__wb")))
    per = per.withColumns({"__rest": F.col("__all") - F.coalesce(F.sum(F.when(F.col("__capped"), cap)).over(everything), F.lit(0)), "__wr": F.col("__wsum") - F.coalesce(F.sum(F.when(F.col("__capped"), F.col("__w"))).over(everything), F.lit(0))})
    share = F.col("__rest").cast("double") * F.col("__w") / F.col("__wr")
    return per.select("__s", "__size", F.when(F.col("__capped"), cap.cast("double")).otherwise(share).alias("__target"))


def _same_source(left: str, right: str) -> Column:
    return F.col(f"{left}.__s").eqNullSafe(F.col(f"{right}.__s"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: __q whole epochs and __below, the last hash value of one epoch more (null: none)."""
    q = F.when(F.col("__size") > 0, F.floor(F.col("__target") / F.col("__size"))).otherwise(0).cast("long")
    goals = goals.withColumn("__q", q).withColumn("__b", F.col("__target") - F.col("__q") * F.col("__size"))
    goals = settled(goals, "mixing-goals")
    zero = F.lit(0).cast("long")
    edge = goals.select("__s", "__b", zero.alias("__at"), zero.alias("__cum"))
    for level in range(1, LEVELS + 1):
        up, here = BITS * (LEVELS - level + 1), BITS * (LEVELS - level)
        inside = join_hot(sized, edge, _same_source).where(F.shiftright("l.__h", up) == F.col("r.__at"))
        hist = inside.groupBy("r.__s", F.shiftright("l.__h", here).alias("__k")).agg(F.sum("l.__n").alias("__n"), F.first("r.__b").alias("__b"), F.first("r.__cum").alias("__cum"))
        hist = hist.withColumn("__to", F.col("__cum") + F.sum("__n").over(Window.partitionBy("__s").orderBy("__k")))
        past = hist.where(F.col("__to") > F.col("__b")).groupBy("__s").agg(F.min_by(F.struct("__k", "__to", "__n", "__b"), "__k").alias("e"))
        edge = settled(past.select("__s", F.col("e.__b").alias("__b"), F.col("e.__k").alias("__at"), (F.col("e.__to") - F.col("e.__n")).alias("__cum"), F.col("e.__n").alias("__last")), "mixing-edge")
    # The boundary value itself is taken where that comes nearer to the budget.
    nearer = 2 * (F.col("__b") - F.col("__cum")) > F.col("__last")
    last = edge.select("__s", F.when(nearer, F.col("__at")).otherwise(F.col("__at") - 1).alias("__below"))
    plan = goals.alias("g").join(last.alias("e"), F.expr("g.__s <=> e.__s"), "left").select("g.__s", "g.__size", "g.__target", "g.__q", "e.__below")
    return settled(plan, "mixing-plan")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, size, source_size, target, taken (words, repeats counted), copies; one row per document."""
    sized = docs.select(F.col(key).alias("__key"), F.col(source).alias("__s"), word_count(F.col(text)).alias("__n"), hash60(F.col(key), F.col(text)).alias("__h"), *carry)
    sized = materialize(sized, "mixing")
    plan = thresholds(sized, targets(sized))
    joined = join_hot(sized, plan, _same_source)
    copies = F.col("r.__q") + F.coalesce(F.col("l.__h") <= F.col("r.__below"), F.lit(False)).cast("long")
    return joined.select(F.col("l.__key").alias(key), F.col("l.__n").alias("size"), F.col("r.__size").alias("source_size"), F.col("r.__target").alias("target"), (F.col("l.__n") * copies).alias("taken"), copies.alias("copies"), *(F.col(f"l.`{c}`") for c in carry))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with docs' columns."""
    sized = docs.select(F.col(source).alias("__s"), word_count(F.col(text)).alias("__n"), hash60(F.col(key), F.col(text)).alias("__h"))
    sized = materialize(sized, "mixing")
    plan = thresholds(sized, targets(sized))
    discard(sized)
    joined = join_hot(docs, plan, lambda left, right: F.col(f"{left}.`{source}`").eqNullSafe(F.col(f"{right}.__s")))
    copies = F.col("r.__q") + F.coalesce(hash60(F.col(f"l.`{key}`"), F.col(f"l.`{text}`")) <= F.col("r.__below"), F.lit(False)).cast("long")
    times = F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)))
    return joined.select(*(F.col(f"l.`{c}`") for c in docs.columns), times.alias(spare(docs.columns, "copy"))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same result by sorting: running sums in hash order instead of nested histograms.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
run AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
               coalesce(sum(3 * source_size) OVER o, 0) AS sb, coalesce(sum(w) OVER o, 0) AS wb
        FROM per WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cap AS (SELECT *, (total - sb) * w > 3 * source_size * (ws - wb) AS capped FROM run),
goal AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS DOUBLE) * w / CAST(ws - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS DOUBLE) END AS target FROM cap),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS q FROM goal),
budget AS (SELECT *, target - q * source_size AS b FROM plan),
groups AS (SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.q + CASE WHEN g.upto <= p.b OR (g.upto - g.s <= p.b AND 2 * (p.b - (g.upto - g.s)) > g.s) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN budget p ON d.source IS NOT DISTINCT FROM p.source
JOIN groups g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h
"""
