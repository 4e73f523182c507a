"""How far a ranking depends on its assumptions: other curves, other weights, pairs that change places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.functions.curve import survival
from quantalog.operators.checkpoints import written
from quantalog.operators.numbering import Ordered, placed


def families(t: Column) -> dict[str, Column]:
    """Survival curves of unrelated shapes. Their parameters are fixed values."""
    late = F.greatest(t, F.lit(0.0))
    return {
        "median": survival(t, "median"),
        "optimistic": survival(t, "optimistic"),
        "pessimistic": survival(t, "pessimistic"),
        "exponential": F.exp(-0.0385 * late),
        "weibull_steep": F.exp(-F.pow(late / 20.0, F.lit(3.5))),
        "gompertz": F.exp(-(0.012 / 0.115) * (F.exp(0.115 * late) - 1.0)),
        "log_logistic": 1.0 / (1.0 + F.pow(late / 16.0, F.lit(2.2))),
    }


def by_family(assets: DataFrame) -> DataFrame:
    """id, family, score: the composite under each curve. One scan; families are columns first, rows then."""
    h, t = families(F.col("x_c") + F.col("y")), families(F.least("x_i", "y"))
    score = {f: F.round(0.5 * F.col("s") * F.col("e") * (1 - h[f]) + 0.5 * F.col("c") * (1 - t[f]), 6) for f in h}
    return assets.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), s.alias("score")) for f, s in score.items()])).alias("x")).select("id", "x.*")


def weight_sweep(assets: DataFrame, steps: int = 10, k: int = 10) -> DataFrame:
    """w, id, score, rank: the k best for each weight of the first axis. Each weight is a pass over three written columns that keeps k rows a task; nothing is sorted."""
    rows = written(assets.select("id", "h_score", "t_score"), "axes")

    def best(w: Column) -> DataFrame:
        score = F.round(w * F.col("h_score") + (1 - w) * F.col("t_score"), 6).alias("score")
        return rows.select(w.alias("w"), "id", score).orderBy(F.desc("score"), "id").limit(k)

    found = reduce(DataFrame.unionByName, [best(F.lit(i / steps)) for i in range(steps + 1)])
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id")).cast("bigint")  # k rows each
    return found.withColumn("rank", rank).select("w", "id", "score", "rank")


def always_on_top(sweep: DataFrame, steps: int = 10) -> DataFrame:
    return sweep.groupBy("id").count().where(F.col("count") == steps + 1).select("id")


def inversions(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that two measures order otherwise (ties of either aren't counted), and all pairs.

    Pairs are counted level by level of a binary tree over the places of the values of `a`: at each level a value meets its
    brothers by grouping, and a running sum over `b` tells the greater ones on the left. That is n log n rows in all and never
    a pair of rows; the running sums are dealt by ranges, so the root of the tree isn't gathered in one task.
    """
    places = placed(df.select(F.col(a).alias("a")).where("a is not null").distinct(), [F.col("a")])
    rows = written(df.select(F.col(a).alias("a"), F.col(b).alias("vb")).join(places, "a").select((F.col("place") - 1).alias("ra"), "vb"), "pairs")
    top = rows.agg(F.max("ra")).first()[0] or 0  # one number
    levels = rows.select("ra", "vb", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))).alias("level"))
    node, right = F.expr("shiftright(ra, level + 1)"), F.expr("shiftright(ra, level) % 2")
    counts = levels.groupBy("level", node.alias("node"), "vb").agg(F.count_if(right == 0).alias("left"), F.count_if(right == 1).alias("right"))
    upto = Ordered(counts, ["level", "node"], ["vb"], descending=True).running("upto", F.col("left")).done()
    n = df.agg(F.count("*").alias("n"))
    found = upto.agg(F.coalesce(F.sum(F.col("right") * (F.col("upto") - F.col("left"))), F.lit(0)).alias("inversions"))
    return found.crossJoin(n).select("inversions", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))  # one row each
