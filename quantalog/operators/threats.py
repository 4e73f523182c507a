"""Changeability of assets, and the threats that remain or begin after a migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.operators.scoring import dimension, lookup


def agility_of() -> Column:
    """The band of an asset's class; what isn't known is in the middle of the range."""
    return F.coalesce(lookup(K.AGILITY, F.lower(F.trim("asset_class"))), F.lit("coordinated"))


def agility(assets: DataFrame) -> DataFrame:
    """band, actionable_now, n, actionable_pct: every band, and the share of the estate that can be acted on now."""
    bands = dimension(assets.sparkSession, list(K.AGILITY_BANDS.items()), "band string, actionable_now boolean")
    counts = assets.groupBy(agility_of().alias("band")).agg(F.count("*").alias("n"))
    every = bands.join(counts, "band", "left").na.fill(0, ["n"])
    share = every.agg(F.round(100.0 * F.sum(F.when(F.col("actionable_now"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), 1).alias("actionable_pct"))
    return every.crossJoin(share)  # a row for each band, and one row


def assessment(assets: DataFrame) -> DataFrame:
    """threat, title, status, exposed, place: the triggers that are met, for each threat the one that exposes most.

    The estate is counted once. That a curve may be fitted anew applies to every estate. Bands of agility are matched as the
    rules name them, with hyphens, so of the three only 'programme' ever fits.
    """
    done = ~F.col("quantum_vulnerable") & (F.col("verdict") == "pqc")
    triggers = [
        ("pqc_side_channel", done, 1),
        ("lattice_cryptanalysis_immaturity", done, 1),
        ("pqc_side_channel", F.col("asset_class").isin(*K.HARDWARE_CLASSES), 1),
        ("retroactive_hndl", F.col("x_c") >= K.LONG_RETENTION_YEARS, 1),
        ("agility_debt", agility_of().isin("hardware-bound", "vendor-blocked", "programme"), 1),
        ("threat_model_drift", F.col("quantum_vulnerable"), 0),
    ]
    one = assets.agg(*[F.count_if(on).alias(f"t{i}") for i, (_, on, _) in enumerate(triggers)])
    rows = F.array(*[F.struct(F.lit(k).alias("threat"), F.col(f"t{i}").alias("n"), F.lit(least).alias("least")) for i, (k, _, least) in enumerate(triggers)])
    met = one.select(F.explode(rows).alias("t")).select("t.*").where("n >= least").groupBy("threat").agg(F.max("n").alias("exposed"))
    known = dimension(assets.sparkSession, [(k, title, status, K.THREAT_STATUSES.index(status)) for k, (title, status) in K.THREATS.items()], "threat string, title string, status string, rank int")
    listed = met.join(known, "threat").agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("exposed")).alias("less"), "threat", "title", "status", "exposed"))).alias("all"))  # five threats
    return listed.select(F.posexplode("all").alias("n", "t")).select("t.threat", "t.title", "t.status", "t.exposed", (F.col("n") + 1).alias("place"))
