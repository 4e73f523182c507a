"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: the sources share a multiple of all words by their weights; a source stops at `most` times its own size and what it
leaves over is shared again. The level at which that settles is found by rounds of one small aggregation over the sources.
Sampling: all documents of a source expect the same number of copies. In the order of their sizes their expected copies are
summed up, one offset is added for each source, and a document is emitted once for each whole number that its step crosses.
In that order neighbours have about the same size, so the words taken are off the target by one document's size at most.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import word_count, written
from quantalog.operators.numbering import BROADCAST_ROWS, Ordered, placed

WIDE = "decimal(38,0)"
OFFSET_BITS = 32


def _whole(value: int) -> Column:
    return F.lit(Decimal(value))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """sources: source, source_size. Adds weight, target (double), and copies / parts, the copies that each document expects.

    Weights repeat along the sources in code point order, null last. All arithmetic is exact but the last division of target. A
    source without words has a target of 0 and expects no copies. If all sources stop at `most` the share isn't reached.
    """
    named = placed(sources, [F.col("source").isNull(), F.col("source")])
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    named = written(named.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("decimal(10,0)")), "weighed")
    size = F.col("source_size").cast("decimal(20,0)")
    total, weight = (int(x or 0) for x in named.agg(F.sum(size), F.sum("weight")).first())
    left, stopped = share.numerator * total, 0  # what is still to share, times the share's denominator
    while True:
        above = F.col("weight") * _whole(left) > size * _whole(most * share.denominator * weight)
        words, rest, n = named.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == stopped:
            break
        left, weight, stopped = share.numerator * total - share.denominator * most * int(words or 0), int(rest or 0), n
        if not weight:
            above = F.lit(True)
            break
    part = F.col("weight") * _whole(left)  # of share.denominator * weight
    none = size == 0
    copies = F.when(none, _whole(0)).when(above, _whole(most)).otherwise(part)
    parts = F.when(none | above, _whole(1)).otherwise(size * _whole(share.denominator * weight))
    target = F.when(above, (size * most).cast("double")).otherwise(part.cast("double") / F.lit(float(share.denominator * max(weight, 1))))
    return named.select("source", "source_size", F.col("weight").cast("int").alias("weight"), target.alias("target"), copies.cast(WIDE).alias("copies"), parts.cast(WIDE).alias("parts"))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each row of df: id, source, size, source_size, target (of its source), copies int and taken (size * copies).

    size is the number of words; null text has none. A document without words may be emitted, but takes nothing. A null source
    is a source of its own, the last. No document has more than `most` copies (share and most as in `source_targets`). Rows of a
    source stand in the order of size and id (null ids first); rows that are equal in both may change places, which no run can
    show. An empty table gives an empty one; other columns are ignored.
    """
    rows = written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    key = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("/"), "source"), F.lit("")))
    offset = F.conv(F.substring(F.sha2(key, 256), 1, OFFSET_BITS // 4), 16, 10).cast("decimal(10,0)")  # of each source, the same in every run
    sources = sources.withColumn("offset", offset).withColumn("start", F.expr(f"(cast(parts as decimal(27,0)) * offset) div {1 << OFFSET_BITS}").cast("decimal(27,0)"))
    sources = written(sources.drop("offset"), "targets")
    ordered = Ordered(rows.withColumn("row", F.monotonically_increasing_id()), ["source"], ["size", "id", "row"])
    rows = ordered.running("place", F.lit(1).cast("bigint")).done()
    small = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    both = rows.alias("r").join(small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.id", "r.source", "size", "source_size", "target", "copies", "parts", "start", F.col("place").cast("decimal(14,0)").alias("place"))
    crossed = lambda place: F.expr(f"(({place}) * cast(copies as decimal(22,0)) + start) div parts")
    out = both.withColumn("n", crossed("place") - crossed("place - 1"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.col("n").cast("int").alias("copies"), (F.col("size") * F.col("n")).cast("bigint").alias("taken"))
