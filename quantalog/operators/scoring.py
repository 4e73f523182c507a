"""Classification, two-axis risk, deadlines and rank of an inventory: column expressions over broadcast dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.functions.curve import survival
from quantalog.operators.numbering import placed


def dimension(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A small constant table, sent to every task."""
    return F.broadcast(spark.createDataFrame(rows, fields))


def lookup(values: dict, key: Column) -> Column:
    """A constant map as an expression, for maps of a few dozen entries."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def classified(findings: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Findings with the facts of their algorithm."""
    return findings.join(F.broadcast(algorithms), "algorithm", "left")


def profiled(assets: DataFrame) -> DataFrame:
    """The six policy inputs: from the asset class, then confidentiality years from the data class and a floor on sensitivity.

    Horizons depend on the asset class and the data class only, so the curves are worked out on the few hundred pairs of these
    and come along with the profile; rows just look them up.
    """
    known_class = F.when(F.col("asset_class").isin(*K.PROFILES), F.col("asset_class")).otherwise("generic_key")  # also for none
    years = {"": None, **{k: float(v) for k, v in K.DATA_CLASS_YEARS.items()}}
    rows = [(k, d, v[0] if t is None else t, *map(float, v[1:])) for k, v in K.PROFILES.items() for d, t in years.items()]
    profile = assets.sparkSession.createDataFrame(rows, "asset_class string, _data string, x_c double, x_i double, y double, s double, e double, c double")
    for reading in K.READINGS:
        profile = profile.withColumns({f"safe_h_{reading}": survival(F.col("x_c") + F.col("y"), reading), f"safe_t_{reading}": survival(F.least("x_i", "y"), reading)})
    known = F.when(F.col("data_class").isin(*K.DATA_CLASS_YEARS), F.col("data_class")).otherwise("")
    keyed = assets.withColumns({"_data": known, "_class": known_class}).withColumnRenamed("asset_class", "_own")
    joined = keyed.join(F.broadcast(profile.withColumnRenamed("asset_class", "_class")), ["_class", "_data"]).drop("_data", "_class").withColumnRenamed("_own", "asset_class")
    return joined.withColumn("s", F.greatest("s", F.coalesce(lookup(K.CRITICALITY_FLOOR, F.col("criticality")), F.lit(0.0))))


def scored(assets: DataFrame, w_h: float = 0.5, w_t: float = 0.5) -> DataFrame:
    """Harvest-now and trust-now exposure, their composite, and its band under the outer curves; of profiled assets."""
    real = F.col("quantum_vulnerable")

    def axis_h(reading: str) -> Column:
        return F.col("s") * F.col("e") * (1 - F.col(f"safe_h_{reading}"))

    def axis_t(reading: str) -> Column:
        return F.col("c") * (1 - F.col(f"safe_t_{reading}"))

    def exact(score: str, weight: float) -> Column:
        """In decimals, so that a half at the seventh place rounds alike everywhere."""
        return F.col(score).cast("decimal(12,6)") * F.lit(str(weight)).cast("decimal(5,4)")

    zero = F.lit(0.0)
    both = [F.when(real, F.round(w_h * axis_h(r) + w_t * axis_t(r), 6)).otherwise(zero) for r in ("optimistic", "pessimistic")]
    out = assets.withColumns({"h_score": F.when(real, F.round(axis_h("median"), 6)).otherwise(zero), "t_score": F.when(real, F.round(axis_t("median"), 6)).otherwise(zero)})
    return out.withColumns({"qirs": F.round(exact("h_score", w_h) + exact("t_score", w_t), 6).cast("double"), "qirs_low": F.least(*both), "qirs_high": F.greatest(*both)})


def scheduled(assets: DataFrame, personas: dict[str, str], as_of_year: float) -> DataFrame:
    """Persona, the milestone that binds, its year, and slack in months."""
    persona = F.coalesce(lookup(personas, F.col("owner")), F.lit("General Enterprise"))
    high = (F.col("c") >= 0.7) | (F.col("e") >= 0.8)
    deadline = F.when(high, lookup({k: v[1] for k, v in K.DEADLINES.items()}, F.col("persona"))).otherwise(lookup({k: v[2] for k, v in K.DEADLINES.items()}, F.col("persona")))
    out = assets.withColumn("persona", persona).withColumns({"phase": F.when(high, "high_priority").otherwise("full"), "deadline_year": deadline})
    return out.withColumn("slack_months", F.round((F.col("deadline_year") + 1 - as_of_year) * 12 - F.col("y") * 12, 1))


def levelled(assets: DataFrame) -> DataFrame:
    """Risk level by the dominant axis; negative slack overrides the bands."""
    dominant = F.greatest("h_score", "t_score")
    band = F.lit("minimal")
    for least, name in reversed(K.RISK_BANDS):
        band = F.when(dominant >= least, name).otherwise(band)
    level = (
        F.when(~F.col("quantum_vulnerable"), F.when(F.col("classically_broken"), "informational").otherwise("safe"))
        .when(F.col("slack_months") < 0, F.when(dominant >= 0.20, "critical").otherwise("high"))
        .otherwise(band)
    )
    return assets.withColumns({"risk_level": level, "axis": F.when(F.col("t_score") > F.col("h_score"), "TNFL").otherwise("HNDL")})


def with_margins(assets: DataFrame, as_of_year: float) -> DataFrame:
    """Years of exposure beyond arrival (X + Y - Z) on the worse axis for each reading of the curve, and the category they make.

    Arrival moves with the clock since the report and with the qubits that the primitive takes.
    """
    elapsed = max(as_of_year - K.REPORT_YEAR, 0.0)
    shift = F.coalesce(K.HORIZON_DOUBLING_YEARS * F.log2(F.col("logical_qubits") / F.lit(float(K.REFERENCE_QUBITS))), F.lit(0.0))
    gated = F.col("ownership").isin("vendor_firmware_gated", "provider_gated")
    effort = F.col("y") + F.when(gated, K.VENDOR_LEAD_YEARS).otherwise(0.0)
    plan = F.greatest(effort, F.col("deadline_year") + 1 - F.lit(as_of_year))
    horizon = F.greatest(F.col("x_c") + plan, F.least(F.col("x_i"), plan))
    margin = {r: F.round(F.col("_horizon") - (max(K.HALF_YEARS[r] - elapsed, 0.0) + F.col("_shift")), 3) for r in K.READINGS}
    # Columns of their own, worked out once: repeated in each margin they make generated methods of over 8,000 bytes, which the JVM only interprets.
    out = assets.withColumns({"_horizon": horizon, "_shift": shift})
    out = out.withColumns({f"margin_{r}": F.when(F.col("quantum_vulnerable"), m) for r, m in margin.items()}).drop("_horizon", "_shift")
    category = F.when(~F.col("quantum_vulnerable"), "not_applicable").otherwise("clear")
    for reading, name in zip(reversed(K.READINGS), reversed(K.CATEGORIES[:3]), strict=True):
        category = F.when(F.col(f"margin_{reading}") > 0, name).otherwise(category)
    return out.withColumn("category", category)


def order_keys() -> list[Column | str]:
    """Ascending. Priority: quantum work by category, margin and score; then what is broken, unknown, safe."""
    tier = F.when(F.col("quantum_vulnerable"), 0).when(F.col("classically_broken"), 1).when(F.col("verdict") == "unknown", 2).otherwise(3)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, K.CATEGORIES)), F.col("category")), F.lit(0))
    mine = F.col("quantum_vulnerable")
    return [tier, F.when(mine, rank).otherwise(0), F.when(mine, -F.col("margin_median")).otherwise(0.0), F.when(mine, -F.col("qirs")).otherwise(0.0), "name", "id", "system", "asset_class"]


#: What the order of priority depends on.
ORDER_COLUMNS = ("id", "name", "system", "asset_class", "quantum_vulnerable", "classically_broken", "verdict", "category", "margin_median", "qirs")


def ranked(assets: DataFrame, keys: list[Column | str] | None = None, name: str = "priority_rank") -> DataFrame:
    """Global rank without gathering all rows in one task (see numbering.placed). Give it no more columns than are wanted and ORDER_COLUMNS."""
    return placed(assets, keys or order_keys(), name)


def need_of(capable: Column | None = None) -> Column:
    """What has to be done about an asset; null for nothing. capable: whether a library has post-quantum algorithms (null: unknown)."""
    capable = F.col("pqc_capable") if capable is None else capable
    cls, primitive, usage = F.col("asset_class"), F.col("primitive"), F.col("usage")
    quantum = (
        F.when(cls.isin(*K.KEX_CLASSES) | primitive.isin("key-agree", "kem") | (usage == "key_exchange"), "key_exchange")
        .when((primitive == "pke") & usage.isin("encryption", "key_wrap"), "kem_at_rest")
        .when(cls.isin(*K.LONG_LIVED), "signature_long_lived")
        .otherwise("signature_high_volume")
    )
    return (
        F.when(cls == "embedded_private_key", "secret_exposure")
        .when((cls == "crypto_library") & ~capable, "library_upgrade")
        .when((cls == "crypto_library") & capable.isNull(), "resolve_first")
        .when(cls == "crypto_library", F.lit(None).cast("string"))
        .when(F.col("verdict") == "unknown", "resolve_first")
        .when(F.col("classically_broken"), "replace_now")
        .when(F.col("quantum_vulnerable"), quantum)
        .when(F.col("grover_weakened") & F.col("algorithm").startswith("AES"), "symmetric")
    )


def planned(assets: DataFrame) -> DataFrame:
    """Need, effort in days, whether the asset is behind its milestone, and what gates the change."""
    days = lookup({k: float(v) for k, v in K.EFFORT_DAYS.items()}, F.col("need"))
    out = assets.withColumn("need", need_of())
    return out.withColumns({"effort_days": days, "behind": (F.col("slack_months") < 0) & F.col("need").isNotNull(), "gated": F.col("ownership").isin("vendor_firmware_gated", "provider_gated")})
