"""The inventory that is derived from the order tables, by arithmetic on their keys: findings, systems, declarations.

`findings` builds it with DataFrame operations; `FINDINGS_SQL` says the same to another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.functions.constants import DATA_CLASS_YEARS, PROFILES
from quantalog.operators.checkpoints import dealt

#: The day and year that every result is computed for.
AS_OF = "2026-09-01"
AS_OF_YEAR = 2026 + 243 / 365.25

# algorithm, key bits, primitive, verdict, Shor breaks it, broken today, weakened by Grover, logical qubits to break it
ALGORITHMS = [
    ("RSA-2048", 2048, "pke", "shor", True, False, False, 1409),
    ("RSA-4096", 4096, "pke", "shor", True, False, False, 2820),
    ("ECDSA-P256", 256, "signature", "shor", True, False, False, 1193),
    ("ECDSA-P384", 384, "signature", "shor", True, False, False, 1770),
    ("Ed25519", 256, "signature", "shor", True, False, False, 1193),
    ("X25519", 256, "key-agree", "shor", True, False, False, 1193),
    ("DH-2048", 2048, "key-agree", "shor", True, False, False, 1409),
    ("AES-128", 128, "block-cipher", "grover", False, False, True, None),
    ("AES-256", 256, "block-cipher", "pqc", False, False, False, None),
    ("3DES", 112, "block-cipher", "classical", False, True, False, None),
    ("MD5", 128, "hash", "classical", False, True, False, None),
    ("SHA-256", 256, "hash", "pqc", False, False, False, None),
    ("ML-KEM-768", 768, "kem", "pqc", False, False, False, None),
    ("ML-DSA-65", 65, "signature", "pqc", False, False, False, None),
    ("RC4", 128, "stream-cipher", "classical", False, True, False, None),
    ("UNRESOLVED", None, "", "unknown", False, False, False, None),
]
CLASSES, DATA_CLASSES = list(PROFILES), list(DATA_CLASS_YEARS)
SOURCES = ["tls", "ssh", "source", "config", "binary", "vault"]
PLANES = ["observed", "observed", "built", "declared", "built", "held"]
PROVENANCES = ["observed", "parsed", "declared", "pattern", "inferred"]
CONFIDENCES = [0.95, 0.9, 0.7, 0.55, 0.3]
USAGES = ["signature", "key_exchange", "encryption", "key_wrap"]
OWNERSHIPS = ["self", "vendor_firmware_gated", "provider_gated", "self", "self"]
PERSONAS = {"AUTOMOBILE": "General Enterprise", "BUILDING": "CII", "FURNITURE": "Education", "HOUSEHOLD": "Healthcare", "MACHINERY": "Banking"}


#: Order lines of a task; what is made of them is sorted and grouped there.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def pick_sql(values: list, number: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" for v in values)
    return f"([{items}])[CAST(({number}) AS INTEGER) + 1]"


def algorithms(spark: SparkSession) -> DataFrame:
    fields = "algorithm string, key_size int, primitive string, verdict string, quantum_vulnerable boolean, classically_broken boolean, grover_weakened boolean, logical_qubits int"
    return spark.createDataFrame(ALGORITHMS, fields)


def spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of a few files, dealt to all cores, and `most` rows to a task where much is made of each; those of many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if most:
        cores = max(cores, -(-rows.count() // most))
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each order line: where which cryptography was seen, by which sensor."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    count = line.count()  # both sides are dealt by the order, in as many tasks as the lines take, so the join sorts a bounded number in each
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    owned = orders.join(customer, orders.o_custkey == customer.c_custkey)  # before the lines come in, which are some four times as many
    line, owned = dealt(line, count, LINES, "l_orderkey"), dealt(owned, count, LINES, "o_orderkey")
    joined = line.join(owned, line.l_orderkey == owned.o_orderkey)
    p, s, n, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
    priority = F.substring("o_orderpriority", 1, 1)
    return joined.select(
        F.concat_ws("-", o.cast("string"), n.cast("string")).alias("id"),
        F.concat(F.lit("asset "), p.cast("string"), F.lit("/"), n.cast("string")).alias("name"),
        pick([a[0] for a in ALGORITHMS], p % 16).alias("algorithm"),
        pick(CLASSES, (s * 7 + n) % 23).alias("asset_class"),
        pick(SOURCES, (s + n) % 6).alias("source_type"),
        pick(PLANES, (s + n) % 6).alias("plane"),
        pick(PROVENANCES, (p + n) % 5).alias("provenance"),
        pick(CONFIDENCES, (p + n) % 5).alias("confidence"),
        pick(USAGES, (p + s) % 4).alias("usage"),
        pick(OWNERSHIPS, (p + 3 * n) % 5).alias("ownership"),
        pick(DATA_CLASSES, o % 11).alias("data_class"),
        F.when(priority == "1", "critical").when(priority == "2", "high").when(priority == "3", "medium").otherwise("low").alias("criticality"),
        F.concat(F.lit("sys"), s.cast("string")).alias("system"),
        F.concat(F.lit("h"), s.cast("string"), F.lit(":443")).alias("host"),
        F.col("c_mktsegment").alias("owner"),
        F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False).alias("pqc_capable"),
        F.when(F.col("l_returnflag") == "R", "prod").when(F.col("l_returnflag") == "A", "staging").otherwise("dev").alias("environment"),
        F.add_months(F.to_date("l_shipdate"), (p % 400).cast("int")).alias("not_after"),
        F.to_date("o_orderdate").alias("seen_on"),
        o.alias("orderkey"),
        p.alias("partkey"),
        s.alias("suppkey"),
        n.cast("bigint").alias("line"),
    )


FINDINGS_SQL = f"""findings AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
    'asset ' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS name,
    {pick_sql([a[0] for a in ALGORITHMS], "l_partkey % 16")} AS algorithm,
    {pick_sql(CLASSES, "(l_suppkey * 7 + l_linenumber) % 23")} AS asset_class,
    {pick_sql(SOURCES, "(l_suppkey + l_linenumber) % 6")} AS source_type,
    {pick_sql(PLANES, "(l_suppkey + l_linenumber) % 6")} AS plane,
    {pick_sql(PROVENANCES, "(l_partkey + l_linenumber) % 5")} AS provenance,
    {pick_sql(CONFIDENCES, "(l_partkey + l_linenumber) % 5")} AS confidence,
    {pick_sql(USAGES, "(l_partkey + l_suppkey) % 4")} AS usage,
    {pick_sql(OWNERSHIPS, "(l_partkey + 3 * l_linenumber) % 5")} AS ownership,
    {pick_sql(DATA_CLASSES, "l_orderkey % 11")} AS data_class,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS criticality,
    'sys' || CAST(l_suppkey AS VARCHAR) AS system, 'h' || CAST(l_suppkey AS VARCHAR) || ':443' AS host, c_mktsegment AS owner,
    CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS pqc_capable,
    CASE l_returnflag WHEN 'R' THEN 'prod' WHEN 'A' THEN 'staging' ELSE 'dev' END AS environment,
    CAST(CAST(l_shipdate AS DATE) + to_months(CAST(l_partkey % 400 AS INTEGER)) AS DATE) AS not_after, CAST(o_orderdate AS DATE) AS seen_on,
    l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""
