"""Exports: component documents, findings reports, digests; and the history of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.functions.text import stable_id, without_line


def components(assets: DataFrame) -> DataFrame:
    """(ref, name, type, properties) of the components that assets fan out to: one for the asset, one for its algorithm. One row for each ref."""
    own = F.struct(F.concat(F.lit("asset/"), "id").alias("ref"), F.col("name").alias("name"), F.lit("cryptographic-asset").alias("type"), F.col("asset_class").alias("detail"))
    algorithm = F.struct(F.concat(F.lit("algorithm/"), F.lower("algorithm")).alias("ref"), F.col("algorithm").alias("name"), F.lit("algorithm").alias("type"), F.col("primitive").alias("detail"))
    return assets.select(F.explode(F.array(own, algorithm)).alias("c")).groupBy("c.ref").agg(F.min(F.struct("c.name", "c.type", "c.detail")).alias("c")).select("ref", "c.*")


def component_lines(assets: DataFrame) -> DataFrame:
    """A canonical JSON line for each component: keys in order, so equal components are equal bytes. Written as text, part by part."""
    return components(assets).select("ref", F.to_json(F.struct("detail", "name", "ref", "type")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def report_rows(assets: DataFrame) -> DataFrame:
    """One result for each asset that needs work: rule, level, place."""
    level = F.when(F.col("risk_level").isin("critical", "high"), "error").when(F.col("risk_level") == "medium", "warning").otherwise("note")
    return assets.where("need is not null").select(F.col("need").alias("rule"), level.alias("level"), "id", without_line(F.col("host")).alias("uri"))


def digest(df: DataFrame, columns: list[str], together: int = 1000) -> DataFrame:
    """A digest of all rows whatever their order: rows are hashed and dealt to buckets by their hash, and buckets are hashed up a tree.

    Some `together` hashes meet in a task at each level, however many rows there are; levels grow with the logarithm of their number.
    """
    hashes = df.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    buckets = df.count() // together + 1
    level = hashes.withColumn("b", F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), F.lit(buckets)))
    while True:
        level = level.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
        if buckets == 1:
            return level.agg(F.coalesce(F.max("h"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))
        buckets = -(-buckets // together)
        level = level.select((F.floor(F.col("b") / together) if buckets > 1 else F.lit(0)).cast("long").alias("b"), F.concat(F.lpad(F.col("b").cast("string"), 20, "0"), F.lit(":"), "h").alias("h"))


def serial_number(refs: DataFrame) -> DataFrame:
    return digest(refs, ["ref"]).select(stable_id(F.col("digest")).alias("serial"))


def save_scan(assets: DataFrame, path: str, scan_id: str) -> None:
    """Replaces one scan of the history; the others aren't touched."""
    assets.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def asset_history(spark: SparkSession, path: str, asset_id: str, last: int) -> DataFrame:
    """An asset in the latest scans, newest first; only its rows are read from each."""
    return spark.read.parquet(path).where(F.col("id") == asset_id).orderBy(F.desc("scan_id")).limit(last)
