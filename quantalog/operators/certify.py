"""Statistical certification of detections: conformal p-values, false-discovery control, e-values, within strata of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import written
from quantalog.operators.numbering import Ordered, with_totals


def _by_score(scores: DataFrame) -> DataFrame:
    """stratum, score, nulls, tests: calibration and test rows of the stratum at or above each score that occurs."""
    null = F.col("calibration").cast("long")
    counts = scores.groupBy("stratum", "score").agg(F.sum(null).alias("own_nulls"), F.sum(1 - null).alias("own_tests"))
    ordered = Ordered(counts, ["stratum"], ["score"], descending=True).running("nulls", F.col("own_nulls")).running("tests", F.col("own_tests"))
    return written(ordered.done().select("stratum", "score", "own_nulls", "nulls", "tests"), "by_score")


def conformal_p(scores: DataFrame) -> DataFrame:
    """scores: id, stratum, score, calibration. p = (1 + calibration scores of the stratum at or above) / (1 + calibration scores).

    Strata without calibration rows have no p-value and are left out.
    """
    scores = written(scores, "scores")
    above = _by_score(scores).select("stratum", "score", F.col("nulls").alias("above"))
    sized = with_totals(scores, ["stratum"], n0=F.sum(F.col("calibration").cast("long"))).where("n0 > 0 and not calibration")
    return sized.join(above, ["stratum", "score"]).withColumn("p", (1 + F.col("above")) / (1 + F.col("n0")))


def _ranked(tests: DataFrame, group: str, order: list[str], descending: bool, rank: str, m: str) -> Ordered:
    """Rows with their place in the group and the group's size."""
    return Ordered(with_totals(written(tests, "tests"), [group], **{m: F.count("*")}), [group], order, descending).running(rank, F.lit(1).cast("bigint"))


def bh_q(tests: DataFrame, group: str, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q-values within each group: reverse cumulative minimum of p * m / rank."""
    ordered = _ranked(tests, group, [p, "id"], False, "rank", "m")
    rows = ordered.later_least("least", F.col(p) * F.col("m") / F.col("rank")).done()
    return rows.withColumn("q", F.least(F.lit(1.0), "least")).withColumn("rank", F.col("rank").cast("int")).drop("least", "m")


def bh_selected(tests: DataFrame, group: str, alpha: float) -> DataFrame:
    """Rows at or below the largest rank whose p-value is within alpha * rank / m."""
    rows = written(_ranked(tests, group, ["p", "id"], False, "rank", "m").done(), "ranks")
    last = F.coalesce(F.max(F.when(F.col("p") <= alpha * F.col("rank") / F.col("m"), F.col("rank"))), F.lit(0))
    return with_totals(rows, [group], last=last).withColumn("selected", F.col("rank") <= F.col("last")).withColumn("rank", F.col("rank").cast("int")).drop("m", "last")


def e_values(scores: DataFrame, alpha: float) -> DataFrame:
    """Conformal e-values: (n0 + 1) at or above the least threshold whose estimated false share is within alpha, over 1 + the null scores there."""
    scores = written(scores, "scores")
    null = F.col("calibration").cast("long")
    sizes = scores.groupBy("stratum").agg(F.sum(null).alias("n0"), F.sum(1 - null).alias("m"))
    counted = _by_score(scores).join(sizes, "stratum")
    share = (1 + F.col("nulls")) / (1 + F.col("n0")) * F.col("m") / F.greatest(F.col("tests"), F.lit(1))
    stops = counted.groupBy("stratum").agg(F.min(F.when(share <= alpha, F.col("score"))).alias("stop"))
    held = counted.join(stops, "stratum").groupBy("stratum").agg(
        F.first("stop").alias("stop"), F.first("n0").alias("n0"), F.first("m").alias("m"), F.sum(F.when(F.col("score") >= F.col("stop"), F.col("own_nulls")).otherwise(0)).alias("held")
    )
    held = written(held, "stops")
    small = F.broadcast(held) if held.count() <= 200_000 else held
    hit = F.col("stop").isNotNull() & (F.col("score") >= F.col("stop"))
    return scores.join(small, "stratum").withColumn("e", F.when(hit, (1 + F.col("n0")) / (1 + F.col("held"))).otherwise(0.0)).where((~F.col("calibration")) & (F.col("n0") > 0))


def ebh_selected(tests: DataFrame, group: str, alpha: float) -> DataFrame:
    """e-BH: the largest k with the k-th largest e-value at least m / (alpha * k)."""
    rows = tests.withColumn("__less", -F.col("e"))
    rows = written(_ranked(rows, group, ["__less", "id"], False, "k", "m_e").done().drop("__less"), "ranks")
    last = F.coalesce(F.max(F.when(F.col("e") >= F.col("m_e") / (alpha * F.col("k")), F.col("k"))), F.lit(0))
    return with_totals(rows, [group], last=last).withColumn("selected", F.col("k") <= F.col("last")).withColumn("k", F.col("k").cast("int")).drop("m_e", "last")


def ebh_q(tests: DataFrame, group: str) -> DataFrame:
    """e-BH q-values: reverse cumulative minimum of m / (k * e) over the falling order of e, 1 at most; 1 for e = 0."""
    rows = tests.withColumn("__less", -F.col("e"))
    raw = F.when(F.col("e") > 0, F.col("m_e") / (F.col("k") * F.col("e"))).otherwise(float("inf"))
    ordered = _ranked(rows, group, ["__less", "id"], False, "k", "m_e").later_least("least", raw)
    return ordered.done().withColumn("q", F.least(F.lit(1.0), "least")).withColumn("k", F.col("k").cast("int")).drop("m_e", "least", "__less")


def calibrator(p: Column, thresholds: tuple[float, ...]) -> Column:
    """Mixture of step calibrators 1{p <= t} / t with equal weights."""
    steps = [F.when(p <= t, 1.0 / t).otherwise(0.0) for t in thresholds]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total / len(thresholds)


def mean_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """df with the rank of a value within groups, from 1, the mean of their places for ties. Values that occur are ranked, not rows."""
    counts = Ordered(df.groupBy(*by, value).agg(F.count("*").alias("__n")), by, [value]).running("__upto", F.col("__n")).done()
    ranks = written(counts.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name)), "ranks")
    return df.alias("a").join(ranks.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, value)]).select("a.*", f"b.{name}")


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation within groups of at least two rows; 1 where a side is constant."""
    plain = written(df.select(*by, F.col(a).alias("va"), F.col(b).alias("vb")), "pairs")
    ranks = mean_ranks(mean_ranks(plain, "va", by, "ra"), "vb", by, "rb")
    constant = (F.min("va") == F.max("va")) | (F.min("vb") == F.max("vb"))
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.when(constant, 1.0).otherwise(F.corr("ra", "rb")), 6).alias("rho")).where("n >= 2")
