"""Places, running sums and minima over an order, without gathering a group in one task.

Rows are dealt by ranges of (group, order), so a range holds a bounded share of the rows whatever the sizes of the groups are.
What lies in the ranges before (or after) comes as one number for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import written

#: Numbers of ranges and groups that are sent to every task (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a range that is sorted by one task.
RANGE_ROWS = 500_000
#: monotonically_increasing_id has the partition above these bits and the row's place in it below.
ROW_BITS = 33


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in a total order. A written table is dealt, so that nothing before it is worked out twice.

    A key that is a column of df is given by its name; it isn't carried twice. The others are made
    of the written columns, so they must not depend on chance. Ranges hold `RANGE_ROWS` rows or so.
    """
    made = {f"__k{i}": key for i, key in enumerate(order) if not isinstance(key, str)}
    columns = [key if isinstance(key, str) else f"__k{i}" for i, key in enumerate(order)]
    plain = written(df, "ordered")
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-plain.count() // RANGE_ROWS))
    dealt = plain.withColumns(made).repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).withColumn("__m", F.monotonically_increasing_id())
    dealt = written(dealt, "placed").withColumn("__part", F.shiftright("__m", ROW_BITS))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")
    row = F.col("__m").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + row).drop("__m", "__part", "__before", *made)


class Ordered:
    """Rows of groups in an order (columns; ascending unless `descending`), to which columns are added."""

    def __init__(self, df: DataFrame, group: list[str], order: list[str], descending: bool = False):
        self.group, sort = group, [F.desc(c) if descending else F.asc(c) for c in order]
        self.rows = written(df.repartitionByRange(*[F.asc(g) for g in group], *sort).withColumn("__part", F.spark_partition_id()), "dealt")
        self.local = Window.partitionBy("__part", *group).orderBy(*sort)

    def _with(self, name: str, outer: DataFrame, combine) -> Ordered:
        small = F.broadcast(outer) if outer.count() <= BROADCAST_ROWS else outer
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*self.group, "__part")]
        both = self.rows.withColumn("__own", combine[0]).alias("a").join(small.alias("b"), same)
        self.rows = both.select("a.*", F.col("b.__other")).withColumn(name, combine[1]).drop("__own", "__other")
        return self

    def running(self, name: str, value: Column) -> Ordered:
        """The sum of value over the rows of the group up to this one, this one included."""
        by_range = Window.partitionBy(*self.group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        totals = self.rows.groupBy(*self.group, "__part").agg(F.sum(value).alias("__t"))
        outer = written(totals.select(*self.group, "__part", F.coalesce(F.sum("__t").over(by_range), F.lit(0)).alias("__other")), "ranges")
        return self._with(name, outer, (F.sum(value).over(self.local.rowsBetween(Window.unboundedPreceding, 0)), F.col("__own") + F.col("__other")))

    def later_least(self, name: str, value: Column) -> Ordered:
        """The least value of the rows of the group from this one on."""
        by_range = Window.partitionBy(*self.group).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
        least = self.rows.groupBy(*self.group, "__part").agg(F.min(value).alias("__t"))
        outer = written(least.select(*self.group, "__part", F.min("__t").over(by_range).alias("__other")), "ranges")
        return self._with(name, outer, (F.min(value).over(self.local.rowsBetween(0, Window.unboundedFollowing)), F.least("__own", "__other")))

    def done(self) -> DataFrame:
        return self.rows.drop("__part")


def with_totals(df: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """df with aggregates of its groups; they are worked out before they are joined, so a large group isn't gathered."""
    found = written(df.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()]), "totals")
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return df.alias("a").join(small.alias("b"), [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]).select("a.*", *[f"b.{n}" for n in totals])
