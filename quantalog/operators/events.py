"""Event logs: chains, runs, rolling measures, breakers, limits. Batch forms; the streaming ones are in quantalog.streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verify_chain(log: DataFrame, buckets: int = 64) -> DataFrame:
    """First broken place of a hash-linked log (idx, prev_hash, entry_hash, content), and its length; null where all links hold.

    Each entry meets the one before it by equality on the index, so the check is parallel.
    """
    before = log.select((F.col("idx") + 1).alias("idx"), F.col("entry_hash").alias("expected"))
    low = log.agg(F.min("idx").alias("low"))
    linked = log.join(before, "idx", "left").crossJoin(F.broadcast(low))  # one row
    own = F.sha2(F.concat("content", "prev_hash"), 256)
    bad = (F.col("entry_hash") != own) | F.when(F.col("idx") == F.col("low"), F.col("prev_hash") != "").otherwise(F.coalesce(F.col("prev_hash") != F.col("expected"), F.lit(True)))
    return linked.agg(F.count("*").alias("entries"), F.min(F.when(bad, F.col("idx"))).alias("first_broken"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values in each key's sequence: key, value, first place, length."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = df.select(key, value, *order, F.row_number().over(w).alias("place"), F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)).alias("new"))
    numbered = flagged.withColumn("run", F.sum("new").over(w))
    return numbered.groupBy(key, "run", value).agg(F.min("place").cast("bigint").alias("first"), F.count("*").alias("length")).select(key, value, "first", "length")


def ngrams(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Counts of n neighbouring values."""
    w = Window.partitionBy(key).orderBy(*order)
    ahead = [F.lead(value, i).over(w).alias(f"v{i}") for i in range(n)]
    full = df.select(*ahead).where(f"v{n - 1} is not null")
    return full.groupBy(F.concat_ws(">", *[f"v{i}" for i in range(n)]).alias("gram")).agg(F.count("*").alias("n"))


def rolling_median(df: DataFrame, key: str, order: list[str], value: str, last: int = 20) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - last, 0)
    held = F.sort_array(F.collect_list(value).over(w))  # `last` values at most
    n = F.size(held)
    return df.withColumn("median", (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)


def attempts(df: DataFrame, key: str, seconds: Column, window: int = 60) -> Column:
    """How many events of the key fall into the window that ends here, this one included."""
    return F.count("*").over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-window, 0))


def breaker(df: DataFrame, key: str, order: list[str], fault: Column, threshold: int = 3) -> DataFrame:
    """Length of the fault streak at each event, and whether it opens the breaker."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("fault", fault.cast("int"))
    grouped = marked.withColumn("sound", F.sum(1 - F.col("fault")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("fault").over(Window.partitionBy(key, "sound").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return grouped.withColumn("streak", streak).withColumn("opens", (F.col("fault") == 1) & (F.col("streak") >= threshold)).drop("sound")


def lockouts(df: DataFrame, key: str, seconds: Column, failed: Column, after: int = 5, window: int = 600, lock: int = 300) -> DataFrame:
    """For every event whether the key was locked when it came: at least `after` failures in the window before it, the last less than `lock` ago."""
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-window + 1, -1)
    marked = df.withColumns({"_s": seconds, "_f": failed})
    last = F.max(F.when(F.col("_f"), F.col("_s"))).over(w)
    many = F.sum(F.col("_f").cast("long")).over(w)
    return marked.withColumn("locked", F.coalesce((many >= after) & (F.col("_s") - last < lock), F.lit(False))).drop("_s", "_f")


def admitted(df: DataFrame, key: str, time: str, order: str, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Sliding-window admission: an event is admitted unless `limit` admitted ones lie in the window before it; rejected ones use up nothing.

    This is sequential within a key by nature: a key's events are streamed in order through one task, with at most `limit` times kept.
    """
    rows = df.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).alias("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for batch in batches:
            verdict = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                if k != current:
                    current, kept = k, []
                while kept and t - kept[0] > window * 1e6:
                    kept.pop(0)
                verdict.append(len(kept) < limit)
                if verdict[-1]:
                    kept.append(t)
            yield pd.DataFrame({"k": batch["k"], "o": batch["o"], "admitted": verdict})

    dealt = rows.repartition("k").sortWithinPartitions("k", "t", "o")
    out = dealt.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, o {df.schema[order].dataType.simpleString()}, admitted boolean")
    return out.withColumnsRenamed({"k": key, "o": order})
