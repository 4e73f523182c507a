"""Joins of findings, evidence, declarations and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.operators.components import connected_components


def corroborated(readings: DataFrame) -> DataFrame:
    """One confidence for each asset: noisy-or over planes of the strongest supporting reading in each.

    readings: asset_id, source, plane, confidence, claim. The claim of the strongest reading leads ('vulnerable' on ties);
    readings of another claim never add confidence, they flag the asset.
    """
    strongest = F.max_by("claim", F.struct("confidence", F.col("claim") == "vulnerable", "claim"))
    lead = readings.groupBy("asset_id").agg(strongest.alias("lead"), F.count("*").alias("readings"), F.count_distinct("claim").alias("claims"))
    support = readings.join(lead, "asset_id").where("claim = lead")
    planes = support.groupBy("asset_id", "plane").agg(F.max("confidence").alias("best"))
    fused = planes.groupBy("asset_id").agg(F.product(1 - F.least(F.greatest("best", F.lit(0.0)), F.lit(1.0))).alias("miss"), F.count("*").alias("planes"), F.max("best").alias("best"))
    out = lead.join(fused, "asset_id").withColumn("confidence", F.round(F.least(1 - F.col("miss"), F.lit(K.CONFIDENCE_CAP)), 4))
    weak = (F.col("planes") == 1) & (F.col("best") < K.STRONG_SINGLE)
    out = out.withColumn("disagreement", F.col("claims") > 1)
    return out.withColumn("flagged", F.col("disagreement") | (F.col("confidence") < K.FLAG_BELOW) | weak).select("asset_id", F.col("lead").alias("claim"), "confidence", "readings", "planes", "disagreement", "flagged")


def method_bonus(findings: DataFrame, key: str = "asset_id") -> DataFrame:
    """The older rule: the strongest method and a bonus for each other method, capped."""
    grades = findings.groupBy(key).agg(F.max("confidence").alias("best"), F.count_distinct("provenance").alias("methods"))
    more = F.least(F.col("best") + K.BONUS * (F.col("methods") - 1), F.greatest("best", F.lit(K.BONUS_CEILING)))
    return grades.select(key, "methods", F.round(F.when(F.col("methods") == 1, F.col("best")).otherwise(more), 4).alias("confidence"))


def identity_components(keys: DataFrame) -> DataFrame:
    """keys: id, kind, value. Findings that share a typed key, directly or in steps, get one component: the least id among them.

    Only id - key edges are made, never pairs of ids, so a key shared by very many ids costs no more than its rows.
    """
    nodes = keys.where("value is not null").select("id", F.concat_ws("\x1f", F.lit("~key"), "kind", "value").alias("key")).distinct()
    first = nodes.groupBy("key").agg(F.min("id").alias("least"))  # a star around the least id of a key
    edges = nodes.join(first, "key").where("id != least").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    return connected_components(edges).withColumnRenamed("node", "id")


def best_member(rows: DataFrame, group: str) -> DataFrame:
    """The best-evidenced row of each group: by confidence, then plane, then least id; by aggregation, without sorting groups."""
    rank = F.array_position(F.array(*map(F.lit, ("declared", "built", "held", "observed"))), F.col("plane"))
    best = rows.groupBy(group).agg(F.count("*").alias("members"), F.max(F.struct("confidence", rank.alias("rank"))).alias("top"))
    tied = rows.join(best, group).where((F.col("confidence") == F.col("top.confidence")) & rank.eqNullSafe(F.col("top.rank")))
    return tied.groupBy(group).agg(F.min("id").alias("best_id"), F.first("members").alias("members"))


def merged(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: current rows whose null-safe key isn't among the incoming ones, then all incoming rows."""
    on = F.lit(True)
    fresh = incoming.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        on = on & current[k].eqNullSafe(fresh[f"_{k}"])
    return current.join(fresh, on, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delta(old: DataFrame, new: DataFrame, fields: list[str], band: str | None = None, tolerance: float = 0.005, key: str = "id") -> DataFrame:
    """Added, removed and changed rows between two snapshots, with each changed field's old and new value as text."""
    a = old.select(F.col(key).alias("a_key"), *[F.col(f).alias(f"a_{f}") for f in [*fields, *([band] if band else [])]])
    b = new.select(F.col(key).alias("b_key"), *[F.col(f).alias(f"b_{f}") for f in [*fields, *([band] if band else [])]])
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    kept = F.col("a_key").isNotNull() & F.col("b_key").isNotNull()
    differs = {f: kept & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")) for f in fields}
    if band:
        x, y = F.col(f"a_{band}"), F.col(f"b_{band}")
        differs[band] = kept & F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > tolerance)
    change = F.array(*[F.when(d, F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("old"), F.col(f"b_{f}").cast("string").alias("new"))) for f, d in differs.items()])
    out = both.select(
        F.coalesce("b_key", "a_key").alias(key),
        F.when(F.col("a_key").isNull(), "added").when(F.col("b_key").isNull(), "removed").otherwise("changed").alias("kind"),
        F.filter(change, lambda c: c.isNotNull()).alias("changes"),
    )
    rows = out.where("kind != 'changed' or size(changes) > 0").select(key, "kind", F.explode_outer("changes").alias("change"))
    return rows.select(key, "kind", "change.field", "change.old", "change.new")


def overlap(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """How far two snapshots speak of the same things: counts, Jaccard share, and a warning below a tenth."""
    sides = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    flags = sides.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    counts = flags.agg(F.count_if(F.expr("o = 1 and n = 1")).alias("common"), F.count_if(F.expr("o = 1 and n = 0")).alias("removed"), F.count_if(F.expr("o = 0 and n = 1")).alias("added"))
    share = F.round(F.col("common") / F.nullif(F.col("common") + F.col("removed") + F.col("added"), F.lit(0)), 6)
    return counts.withColumn("jaccard", share).withColumn("warning", F.coalesce(F.col("jaccard") < 0.1, F.lit(False)))


def only_version(rows: DataFrame) -> DataFrame:
    """Fills a missing library version from its scope, if just one version is known there."""
    known = rows.groupBy("scope", "library").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    return rows.join(known, ["scope", "library"], "left").withColumn("version", F.coalesce("version", F.when(F.col("low") == F.col("high"), F.col("low")))).drop("low", "high")


def possible_duplicates(rows: DataFrame, most: int = 10) -> DataFrame:
    """For each row the first `most` other ids with the same subject. Only the least most + 1 ids of a subject are ever gathered."""
    spot = Window.partitionBy("subject").orderBy("id")
    first = rows.select("subject", "id").distinct().withColumn("n", F.row_number().over(spot)).where(F.col("n") <= most + 1)
    lists = first.groupBy("subject").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    others = F.slice(F.array_remove("ids", F.col("id")), 1, most)
    return rows.select("subject", "id").join(lists, "subject").select("id", others.alias("others"))


def tiered(candidates: DataFrame, tier: Column, key: str, order: list[str]) -> DataFrame:
    """Of several candidates for a key the one of the lowest tier."""
    return candidates.withColumn("tier", tier).where("tier is not null").groupBy(key).agg(F.min_by(F.struct(*candidates.columns, "tier"), F.struct("tier", *order)).alias("pick")).select("pick.*")


def nearest_matches(truth: DataFrame, found: DataFrame, within: int) -> DataFrame:
    """Each true line with the nearest found one of the same file and name at most `within` lines away.

    The range is cut into blocks of `within` lines; a row meets only the neighbouring blocks, by equality.
    """
    block = lambda c: F.floor(F.col(c) / max(1, within))
    near = found.select("file", "name", F.col("line").alias("found_line"), F.explode(F.array(block("line") - 1, block("line"), block("line") + 1)).alias("block"))
    pairs = truth.withColumn("block", block("line")).join(near, ["file", "name", "block"]).where(F.abs(F.col("line") - F.col("found_line")) <= within)
    return pairs.groupBy("file", "name", "line").agg(F.min_by("found_line", F.struct(F.abs(F.col("line") - F.col("found_line")), "found_line")).alias("found_line"))
