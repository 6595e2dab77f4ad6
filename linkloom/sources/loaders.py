"""Further sources and sinks: paged services, PDF and image files, triplet documents, graph tables, JDBC, object folders, generated data."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkloom.sources.tables import RAW_SCHEMAS, require

# --- paged services -----------------------------------------------------------------------------


def fetch(get: Callable[[int], list[dict]], page: int, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """One page, retried after 1, 2, 4, ... seconds, ten at most; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return get(page)
        except Exception:
            if attempt == retries:
                raise
            sleep(min(10.0, 2.0**attempt))
    return []


class PagedSource(DataSource):
    """A paged REST service as a data source: one partition a page. Options: url (with {page}), pages, retries."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        def get(page: int) -> list[dict]:
            with urlopen(self.options["url"].replace("{page}", str(page)), timeout=30) as answer:
                got = json.loads(answer.read())
            return got if isinstance(got, list) else got.get("items", [])

        for record in fetch(get, partition.value, int(self.options.get("retries", "3"))):
            yield partition.value, json.dumps(record)


# --- files --------------------------------------------------------------------------------------

_STRING = re.compile(rb"\((?:\\.|[^()\\])*\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", re.DOTALL)
_PIECE = re.compile(rb"\(((?:\\.|[^()\\])*)\)", re.DOTALL)
NEEDS_OCR_BELOW = 25


def pdf_pages(data: bytes) -> list[str]:
    """Text of each content stream of a PDF, by its text operators; compressed streams are inflated, encrypted or scanned ones give nothing."""
    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.DOTALL):
        raw = m[1]
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        parts = [p[1] for s in _STRING.finditer(raw) for p in _PIECE.finditer(s[0])]
        pages.append("".join(re.sub(rb"\\([()\\])", rb"\1", p).decode("latin-1") for p in parts))
    return pages


def read_pdf(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, page, text, chars, needs_ocr (under 25 characters), sha256 of the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, t) for p, c in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(pdf_pages(bytes(c)) or [""], 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    pages = files.mapInPandas(run, "path string, page int, text string")
    sums = files.select("path", F.sha2("content", 256).alias("sha256"))
    return pages.withColumn("chars", F.length("text")).withColumn("needs_ocr", F.col("chars") < NEEDS_OCR_BELOW).join(sums, "path")


def read_images(spark: SparkSession, path: str, engine: Callable[[bytes], str] | None = None, glob: str = "*") -> DataFrame:
    """path, text, engine: recognised by the engine given; without one the bytes are taken as text, so that tests run offline."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [engine(bytes(c)) if engine else bytes(c).decode("utf-8", "replace") for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "text": text, "engine": "given" if engine else "none"})

    return files.mapInPandas(run, "path string, text string, engine string")


#: Names a container, a role and a type may have.
CONTAINERS = ("triplets", "relations", "edges", "relationships", "data", "items")
ROLES = {"source": ("source", "subject", "head", "from", "src"), "relation": ("relation", "predicate", "label", "rel"), "target": ("target", "object", "tail", "to", "dst")}
NAMES = ("name", "text", "label", "canonical_name", "id")


def find_key(record: dict, names: Sequence[str]) -> str | None:
    """The first of the names that a record has, in any case."""
    by = {str(k).lower(): k for k in record}
    return next((by[n] for n in names if n in by), None)


def endpoint(record: dict, key: str) -> tuple[str | None, str | None]:
    """(name, type) of an end: a string with a sibling <key>_type, or an object."""
    value = record.get(key)
    if isinstance(value, dict):
        n, t = find_key(value, NAMES), find_key(value, ("type", "entity_type"))
        return (str(value[n]).strip() or None) if n and value[n] is not None else None, str(value[t]) if t and value[t] is not None else None
    kind = find_key(record, (f"{key}_type".lower(),))
    return (str(value).strip() or None) if value is not None else None, str(record[kind]) if kind and record[kind] is not None else None


def container(document) -> list:
    """The list of records of a document: itself, or the first known key that holds one."""
    if isinstance(document, list):
        return document
    if isinstance(document, dict):
        key = find_key(document, CONTAINERS)
        if key and isinstance(document[key], list):
            return document[key]
    return []


TRIPLET = "path string, place int, source string, source_type string, relation string, target string, target_type string, attributes map<string,string>, reason string"


def read_triplets(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reason) triplets of JSON documents, whatever their keys are called; what is left of a record becomes attributes."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.input_file_name().alias("path"), "value")

    def parse(p: str, text: str) -> Iterator[tuple]:
        try:
            records = container(json.loads(text))
        except ValueError:
            yield p, -1, None, None, None, None, None, {}, "no JSON"
            return
        for i, r in enumerate(records):
            if not isinstance(r, dict):
                yield p, i, None, None, None, None, None, {}, "no object"
                continue
            keys = {role: find_key(r, names) for role, names in ROLES.items()}
            a, at = endpoint(r, keys["source"]) if keys["source"] else (None, None)
            b, bt = endpoint(r, keys["target"]) if keys["target"] else (None, None)
            rel = str(r[keys["relation"]]).strip() if keys["relation"] and r[keys["relation"]] is not None else None
            missing = next((f"missing {role}" for role, v in (("source", a), ("relation", rel), ("target", b)) if not v), None)
            rest = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in r.items() if k not in keys.values() and v is not None}
            yield p, i, a, at, rel, b, bt, rest, missing

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for p, t in zip(frame["path"], frame["value"], strict=True) for row in parse(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRIPLET.split(", ")])

    rows = files.mapInPandas(run, TRIPLET)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("path", "place", "reason")


# --- tables -------------------------------------------------------------------------------------


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[str, str]:
    """Nodes and edges as Parquet; their paths."""
    paths = f"{folder}/nodes", f"{folder}/edges"
    for df, path in zip((nodes, edges), paths, strict=True):
        df.write.mode("overwrite").parquet(path)
    return paths


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return require(spark.read.parquet(f"{folder}/nodes"), ["id"]), require(spark.read.parquet(f"{folder}/edges"), ["src", "dst"])


def to_pandas(df: DataFrame, most: int = 100_000) -> pd.DataFrame:
    """df on the driver; an error beyond `most` rows, never a part of it."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def record_ddl(table: str) -> str:
    """The table of records of a JDBC database."""
    return f"CREATE TABLE IF NOT EXISTS {_name(table)} (record_id TEXT PRIMARY KEY, record_type TEXT NOT NULL, payload TEXT NOT NULL, updated_at TIMESTAMP NOT NULL)"


def upsert_sql(table: str) -> str:
    return f"INSERT INTO {_name(table)} (record_id, record_type, payload, updated_at) VALUES (?, ?, ?, ?) ON CONFLICT (record_id) DO UPDATE SET record_type = EXCLUDED.record_type, payload = EXCLUDED.payload, updated_at = EXCLUDED.updated_at"


def _name(table: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", table):
        raise ValueError(f"no table name: {table!r}")
    return table


def read_records(spark: SparkSession, url: str, table: str, record_type: str | None = None, parts: int = 8, properties: dict | None = None) -> DataFrame:
    """Records by JDBC, the type pushed down, read in parts by a hash of the id."""
    where = f" WHERE record_type = '{record_type}'" if record_type and re.fullmatch(r"[A-Za-z0-9_ -]+", record_type) else ""
    if record_type and not where:
        raise ValueError(f"no record type: {record_type!r}")
    source = f"(SELECT record_id, record_type, payload, updated_at, abs(mod(hashtext(record_id), {parts})) AS part FROM {_name(table)}{where}) AS r"
    return spark.read.jdbc(url, source, column="part", lowerBound=0, upperBound=parts, numPartitions=parts, properties=properties or {}).drop("part")


def inside(root: str, key: str) -> str:
    """The path of a key below a root; an error for what leads out of it."""
    parts = [p for p in key.replace("\\", "/").split("/") if p not in ("", ".")]
    if ".." in parts or key.startswith("/"):
        raise ValueError(f"key leads out of its folder: {key!r}")
    return "/".join([root.rstrip("/"), *parts])


def list_objects(spark: SparkSession, root: str, prefix: str = "", limit: int | None = None) -> list[tuple[str, int]]:
    """(key, bytes) below a root of any file system, in order of keys, from a prefix on, the first `limit`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = fs.listFiles(path, True), []
    base = fs.makeQualified(path).toString().rstrip("/") + "/"
    while files.hasNext():
        f = files.next()
        key = f.getPath().toString().removeprefix(base)
        if key.startswith(prefix) and not key.rsplit("/", 1)[-1].startswith("."):
            out.append((key, f.getLen()))
    out.sort()
    return out if limit is None else out[:limit]


# --- generated data -----------------------------------------------------------------------------


def _part(salt: str, n: int):
    """A number below n that follows from the row's id and a salt: the same wherever the row is made."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def generate(spark: SparkSession, people: int, gangs: int = 5, calls: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """persons, calls, transactions, meetings with one hidden coordinator a pair of gangs: each row follows from its number and the seed."""
    s = str(seed)
    who = lambda n: F.concat(F.lit("P"), F.lpad(n.cast("string"), 6, "0"))
    p = spark.range(people)
    coordinators = max(1, gangs // 2)
    hidden = F.col("id") < coordinators
    persons = p.select(
        who(F.col("id")).alias("person_id"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, FIRST)), (_part(s + "f", len(FIRST)) + 1).cast("int")), F.element_at(F.array(*map(F.lit, LAST)), (_part(s + "l", len(LAST)) + 1).cast("int"))).alias("full_name"),
        F.concat(F.lit("+1-"), F.lpad((_part(s + "p", 10**9) + 10**9).cast("string"), 10, "0")).alias("phone_number"), F.concat((_part(s + "a", 900) + 100).cast("string"), F.lit(" Main St, Grantville")).alias("address"), (_part(s + "g", 50) + 18).cast("int").alias("age"),
        F.when(~hidden, F.concat(F.lit("G"), _part(s + "gang", gangs))).alias("gang_id"), F.when(hidden, "coordinator").when(_part(s + "r", 20) == 0, "boss").otherwise("soldier").alias("role"), hidden.alias("is_hidden_coordinator"),
    )
    moment = (F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=_part(s + "t", 180 * 86400).cast("decimal(18,6)"))).alias("timestamp")
    other = lambda x: F.pmod(x + 1 + _part(s + "dst", max(people - 1, 1)), F.lit(people))
    a = _part(s + "src", people)
    b, payer = other(a), F.when(_part(s + "c", 10) == 0, _part(s + "k", coordinators)).otherwise(a)
    made = spark.range(people * calls)
    called = made.select(F.concat(F.lit("C"), "id").alias("call_id"), who(a).alias("caller_id"), who(b).alias("receiver_id"), moment, (_part(s + "d", 600) + 5).cast("int").alias("duration_sec"), F.concat(F.lit("TWR-"), _part(s + "w", 90) + 10).alias("tower_location"))
    paid = spark.range(people * calls // 2).select(F.concat(F.lit("T"), "id").alias("transaction_id"), who(payer).alias("sender_id"), who(other(payer)).alias("receiver_id"), ((_part(s + "m", 900000) + 1000) / 100.0).alias("amount"), F.lit("USD").alias("currency"), moment, F.lit("cash").alias("channel"), F.concat(F.lit("ACC"), _part(s + "acc", max(people // 3, 1))).alias("account_id"))
    met = spark.range(people // 2).select(F.concat(F.lit("M"), "id").alias("meeting_id"), F.lit("Riverport").alias("location"), moment, F.concat_ws("|", who(a), who(b)).alias("attendee_ids"))
    return {"persons": persons, "calls": called, "transactions": paid, "meetings": met}


FIRST = ("Asha", "Ben", "Chen", "Dara", "Emil", "Fay", "Gita", "Hugo", "Iris", "Joao")
LAST = ("Abel", "Bose", "Costa", "Dunn", "Eder", "Fox", "Gray", "Hall", "Ito", "Jain")


def incident_reports(persons: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """fir_id, complainant_id, accused_id, narrative of n reports on generated people, by template."""
    spark = persons.sparkSession
    numbered = persons.select("person_id", "full_name", F.regexp_extract("person_id", r"(\d+)$", 1).cast("long").alias("k"))
    total = numbered.count()
    s = str(seed)
    rows = spark.range(n).select(F.concat(F.lit("FIR"), F.lpad((F.col("id") + 1).cast("string"), 5, "0")).alias("fir_id"), _part(s + "x", max(total, 1)).alias("a"), _part(s + "y", max(total, 1)).alias("b"), F.element_at(F.array(F.lit("theft"), F.lit("fraud"), F.lit("assault")), (_part(s + "z", 3) + 1).cast("int")).alias("crime"))
    side = lambda e: numbered.select(F.col("k").alias(e), F.col("person_id").alias(f"{e}_id"), F.col("full_name").alias(f"{e}_name"))
    met = rows.join(side("a"), "a").join(side("b"), "b")
    return met.select("fir_id", F.col("a_id").alias("complainant_id"), F.col("b_id").alias("accused_id"), F.concat("a_name", F.lit(" reported a "), "crime", F.lit(" allegedly by "), "b_name", F.lit(".")).alias("narrative"))


def planted_graph(spark: SparkSession, communities: int = 3, size: int = 6, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, truth): rings of people, and for each neighbouring pair of rings one hidden intermediary whose only trace is an account that both pay into."""
    k, i = F.floor(F.col("id") / size), F.col("id") % size
    people = spark.range(communities * size)
    name = lambda c, j: F.concat(F.lit("P"), c.cast("string"), F.lit("-"), j.cast("string"))
    nodes = people.select(name(k, i).alias("id"), F.lit("PERSON").alias("entity_type"))
    ring = people.select(name(k, i).alias("src"), name(k, (i + 1) % size).alias("dst"), F.lit("CALLED").alias("relation"))
    gaps = spark.range(communities - 1)
    account = F.concat(F.lit("ACC-"), F.col("id").cast("string"))
    pays = gaps.select(F.explode(F.array(*(F.struct(name(F.col("id") + d, F.lit(j)).alias("src"), account.alias("dst")) for d in (0, 1) for j in (0, 1)))).alias("e")).select("e.src", "e.dst", F.lit("TRANSFERRED_TO").alias("relation"))
    truth = gaps.select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"), account.alias("account"))
    nodes = nodes.unionByName(gaps.select(account.alias("id"), F.lit("ACCOUNT").alias("entity_type")))
    return nodes, ring.unionByName(pays).withColumn("seed", F.lit(seed)).drop("seed"), truth


def duplicate_records(spark: SparkSession, n: int, copies: int = 2) -> DataFrame:
    """record_id, entity_id, name: n people, each with spelling variants, for measuring resolution."""
    people = spark.range(n)
    base = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, FIRST)), (F.col("id") % len(FIRST) + 1).cast("int")), F.element_at(F.array(*map(F.lit, LAST)), (F.floor(F.col("id") / len(FIRST)) % len(LAST) + 1).cast("int")), F.col("id").cast("string"))
    c = F.explode(F.sequence(F.lit(0), F.lit(copies)))
    rows = people.select(F.col("id").alias("entity_id"), base.alias("base"), c.alias("copy"))
    variant = F.when(F.col("copy") == 0, F.col("base")).when(F.col("copy") % 2 == 1, F.concat(F.lit("Mr. "), F.upper("base"))).otherwise(F.concat("base", F.lit(" Jr")))
    return rows.select(F.concat_ws("-", "entity_id", "copy").alias("record_id"), "entity_id", variant.alias("name"))


def clean_raw(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw tables that have all their columns, by name; an error names the ones that lack some."""
    return {name: require(df, [c.split()[0] for c in RAW_SCHEMAS[name].split(", ")]) for name, df in frames.items() if name in RAW_SCHEMAS}
