"""Aggregations and selections behind dashboards: each in one pass over the assets, combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict[str, list], search: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows whose columns have one of the given values and, ignoring case, contain the search text in the joined columns."""
    for name, values in equal.items():
        df = df.where(F.col(name).isin(values))
    if search:
        df = df.where(F.lower(F.concat_ws(" ", *columns)).contains(search.lower()))
    return df


def top_matches(df: DataFrame, by: str, k: int, id_col: str = "id") -> DataFrame:
    """The k greatest, ties by id, with the number of all rows in `matched`."""
    matched = df.agg(F.count("*").alias("matched"))
    return df.orderBy(F.desc(by), id_col).limit(k).crossJoin(F.broadcast(matched))  # one row


def facets(df: DataFrame, columns: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts by every value of every column (null as ''), with counts of flags, in one aggregation."""
    flagged = df.select(*columns, *[c.alias(f"is_{n}") for n, c in flags.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in columns])).alias("pair")
    long = flagged.select(pairs, *[f"is_{n}" for n in flags])
    return long.groupBy("pair.facet", "pair.value").agg(F.count("*").alias("n"), *[F.count_if(f"is_{n}").alias(n) for n in flags])


def dense(spark, **sizes: int) -> DataFrame:
    """Every combination of 0 .. n - 1 for a few small n."""
    names = list(sizes)
    grid = spark.range(1).select(*[F.lit(None).alias("none")])
    for name in names:
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sizes[name] - 1).cast("bigint"))))
    return grid.select(*names)


def heatmap(df: DataFrame, n: int) -> DataFrame:
    """n by n cells over both axes, scaled by the greatest score: rows, mean score and worst asset of each, empty cells too."""
    top = df.agg(F.greatest(F.max("h_score"), F.max("t_score")).alias("top"))
    slot = lambda c: F.least(F.floor(F.col(c) / (F.col("top") / n)), F.lit(n - 1).cast("bigint"))
    cells = df.crossJoin(F.broadcast(top)).withColumns({"h_bin": slot("h_score"), "t_bin": slot("t_score")})  # one row
    found = cells.groupBy("h_bin", "t_bin").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("qirs").cast("decimal(38,10)")).cast("double"), 6).alias("avg_qirs"), F.max_by("id", F.struct("qirs", "id")).alias("worst")
    )
    return dense(df.sparkSession, h_bin=n, t_bin=n).join(found, ["h_bin", "t_bin"], "left").na.fill(0, ["n"])


def histogram(df: DataFrame, value: Column, n: int) -> DataFrame:
    """Rows in n equal bins of [0, 1], empty ones too."""
    found = df.groupBy(F.least(F.floor(value * n), F.lit(n - 1).cast("bigint")).alias("bin")).agg(F.count("*").alias("n"))
    return dense(df.sparkSession, bin=n).join(found, "bin", "left").na.fill(0, ["n"])


def category_rollup(df: DataFrame) -> DataFrame:
    """Category counts for each system, and over all under '(all)'."""
    sets = df.groupingSets([[F.col("system"), F.col("category")], [F.col("category")]], "system", "category")
    return sets.agg(F.count("*").alias("n")).select(F.coalesce("system", F.lit("(all)")).alias("system"), "category", "n")


def expiry_days(as_of: str) -> Column:
    return F.datediff("not_after", F.lit(as_of).cast("date"))


def expiry_band(days: Column) -> Column:
    return F.when(days < 0, "expired").when(days <= 30, "30_days").when(days <= 90, "90_days").otherwise("ok")


def expiry_bands(df: DataFrame, as_of: str) -> DataFrame:
    """Counts of all four bands."""
    found = df.groupBy(expiry_band(expiry_days(as_of)).alias("band")).agg(F.count("*").alias("n"))
    bands = df.sparkSession.createDataFrame([("expired",), ("30_days",), ("90_days",), ("ok",)], "band string")
    return bands.join(found, "band", "left").na.fill(0, ["n"])


def change_cost(df: DataFrame) -> DataFrame:
    """Days by owner, system, need and overall, from one grouping of assets into changes."""
    changes = df.groupBy("need", "system", "host").agg(F.min("owner").alias("owner"), F.count("*").alias("assets"), F.max("effort_days").alias("days"))
    o, s, n = F.col("owner"), F.col("system"), F.col("need")
    sets = changes.groupingSets([[o], [s], [n], []], "owner", "system", "need")
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("changes"), F.sum("assets").alias("assets"), F.round(F.sum(F.col("days").cast("decimal(20,2)")).cast("double"), 2).alias("days"))
    level = F.when(F.col("g") == 3, "owner").when(F.col("g") == 5, "system").when(F.col("g") == 6, "need").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("owner", "system", "need", F.lit("")).alias("name"), "changes", "assets", "days")
