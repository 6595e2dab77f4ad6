"""Scans, required-column checks, and the investigation views bound to the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The raw tables' columns.
RAW_SCHEMAS = {
    "persons": "person_id string, full_name string, phone_number string, address string, age int, gang_id string, role string, is_hidden_coordinator boolean",
    "calls": "call_id string, caller_id string, receiver_id string, timestamp timestamp_ntz, duration_sec int, tower_location string",
    "transactions": "transaction_id string, sender_id string, receiver_id string, amount double, currency string, timestamp timestamp_ntz, channel string, account_id string",
    "meetings": "meeting_id string, location string, timestamp timestamp_ntz, attendee_ids string",
}


class MissingColumns(ValueError):
    """A table lacks columns that its schema requires."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A raw CSV with its explicit schema; the header is checked, types are never inferred."""
    schema = T._parse_datatype_string(RAW_SCHEMAS[name])
    header = spark.read.option("header", True).csv(path)
    require(header, schema.fieldNames())
    typed = header.select(*(F.lower(F.col(f.name)).eqNullSafe("true").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema))
    if name == "meetings":
        typed = typed.withColumn("attendee_ids", F.filter(F.split("attendee_ids", r"\|"), lambda x: x != ""))
    return typed


def read_all_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every known raw table that is present."""
    out = {}
    for name in RAW_SCHEMAS:
        path = f"{folder}/{name}.csv"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            out[name] = read_raw(spark, path, name)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    df.write.mode("append").json(path)


def recent_audit(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    return spark.read.json(path).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content and sha256 of files: the object store's listing and checksums."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def triplets(rows: DataFrame, roles: dict[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Finds source, relation and target among candidate columns, case-insensitively: (good, rejected with reason)."""
    roles = roles or {"source": ("source", "subject", "head", "from"), "relation": ("relation", "predicate", "type", "label"), "target": ("target", "object", "tail", "to")}
    by_name = {c.lower(): c for c in rows.columns}
    found = {role: [F.col(f"`{by_name[n]}`").cast("string") for n in names if n in by_name] for role, names in roles.items()}
    cols = {role: F.nullif(F.trim(F.coalesce(*c, F.lit(None).cast("string"))), F.lit("")) if c else F.lit(None).cast("string") for role, c in found.items()}
    rows = rows.withColumns({f"__{r}": c for r, c in cols.items()})
    reason = F.when(F.col("__source").isNull(), "missing source").when(F.col("__relation").isNull(), "missing relation").when(F.col("__target").isNull(), "missing target")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select(*(F.col(f"__{r}").alias(r) for r in roles))
    return good, rows.where("reason IS NOT NULL").select(*(c for c in rows.columns if not c.startswith("__")))


# --- views over the test tables ---------------------------------------------------------------


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, amount (decimal), ts, channel: one row a line item; returned items flow back."""
    d = "decimal(18,4)"
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey)
    customer, supplier = F.concat(F.lit("C:"), F.col("o_custkey")), F.concat(F.lit("S:"), F.col("l_suppkey"))
    back = F.col("l_returnflag") == "R"
    amount = F.col("l_extendedprice").cast(d) * (1 - F.col("l_discount").cast(d))
    return rows.select(F.when(back, supplier).otherwise(customer).alias("src"), F.when(back, customer).otherwise(supplier).alias("dst"), amount.alias("amount"), F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("channel"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, relation, src, dst, ts, value: each event's user calls the next one's of that kind.

    The next event is looked for within the hour; the last of an hour takes the first of the next hour that
    has any, from a table of one row an hour and kind. So no task sorts all events of a kind.
    """
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    w = Window.partitionBy("event_type", "hour").orderBy("ts", "event_id")
    first = e.groupBy("event_type", "hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    then = first.select("event_type", "hour", F.lead("f.user_id").over(Window.partitionBy("event_type").orderBy("hour")).alias("then"))
    rows = e.withColumns({"nxt": F.lead("user_id").over(w), "last": F.lead("event_id").over(w).isNull()}).join(then, ["event_type", "hour"])
    rows = rows.withColumn("nxt", F.when(F.col("last"), F.col("then")).otherwise(F.col("nxt"))).where("nxt IS NOT NULL AND nxt <> user_id")
    return rows.select("event_id", F.col("event_type").alias("relation"), F.concat(F.lit("U:"), "user_id").alias("src"), F.concat(F.lit("U:"), "nxt").alias("dst"), "ts", "value")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: customers and suppliers in nations, nations in regions; no timestamp."""

    def located(name: str, a: str, key: str, b: str, up: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), key).alias("src"), F.concat(F.lit(b), up).alias("dst"))

    return located("customer", "C:", "c_custkey", "N:", "c_nationkey").unionByName(located("supplier", "S:", "s_suppkey", "N:", "s_nationkey")).unionByName(located("nation", "N:", "n_nationkey", "R:", "n_regionkey"))
