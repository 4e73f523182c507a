"""Taking rows in: validation with reasons, scrubbing of forbidden keys, lookups that don't guess."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import written

# Attribute names that may carry key material. Fixed values.
FORBIDDEN = (
    "CKA_VALUE", "CKA_PRIVATE_EXPONENT", "CKA_PRIME_1", "CKA_PRIME_2", "CKA_EXPONENT_1", "CKA_EXPONENT_2", "CKA_COEFFICIENT",
    "private_key", "private_key_pem", "key_material", "secret", "d", "p", "q",
)


def judged(rows: DataFrame, unit_columns: list[str], id_col: str = "id", order: str = "seq") -> DataFrame:
    """Rows with the reason for which they aren't taken, or null. Of several with one id the first is taken."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    reason = F.when(F.col(id_col).isNull(), "missing id").when(place > 1, "duplicate id")
    for c in unit_columns:
        reason = reason.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), f"{c} not a number").when(~F.col(c).between(0, 1), f"{c} out of range")
    return rows.withColumn("reason", reason)


def scrubbed(details: Column) -> Column:
    """A map without the forbidden keys."""
    return F.map_filter(details, lambda k, v: ~k.isin(*FORBIDDEN))


def scrubbed_json(payload: Column) -> Column:
    """A JSON object without the forbidden keys, in objects within objects at any depth; objects in lists are left as they are.

    A text that isn't a JSON object gives null. `leaks` finds what lists may still hold.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def without(value):
            return {k: without(v) for k, v in value.items() if k not in FORBIDDEN} if isinstance(value, dict) else value

        def one(text: str | None) -> str | None:
            try:
                value = json.loads(text) if text else None
            except ValueError:
                return None
            return json.dumps(without(value), sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None

        return texts.map(one)

    return clean(payload)


def leaks(payload: Column) -> Column:
    """Whether a forbidden key stands anywhere in a JSON text, lists included."""
    return payload.rlike(r'"(' + "|".join(FORBIDDEN) + r')"\s*:')


def stamped(existing: Column, stamp: Column) -> Column:
    """The stamp's keys are added where they are missing."""
    have = F.map_keys(existing)
    return F.map_concat(existing, F.map_filter(stamp, lambda k, v: ~F.array_contains(have, k)))


#: Letters of the parts that references and names meet by.
GRAM = 3


def _grams(text: Column, size: int | Column) -> Column:
    """All different parts of a text with so many letters."""
    last = F.length(text) - size + 1
    parts = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size if isinstance(size, Column) else F.lit(size)))
    return F.when(last >= 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def tiered_lookup(refs: DataFrame, names: DataFrame) -> DataFrame:
    """ref, id, tier: 1 same name, 2 same name but for case, 3 a part of just one name; id is null where several have it.

    References that equal a name are found by equality. The others meet the names by the one of their three-letter parts that fewest names
    have, and are compared with these only. Null and empty references find nothing.
    """
    r = refs.select("ref", F.lower("ref").alias("low")).where("ref <> ''").distinct()
    n = names.select("id", "name", F.lower("name").alias("whole"))
    tier = F.when(F.col("name") == F.col("ref"), 1).otherwise(2)
    same = written(r.join(n, F.col("low") == F.col("whole")).groupBy("ref", tier.alias("tier")).agg(F.count("*").alias("n"), F.min("id").alias("id")), "same")
    rest = written(r.join(same, "ref", "left_anti").withColumn("size", F.least(F.length("low"), F.lit(GRAM))), "rest")
    sizes = [x.size for x in rest.select("size").distinct().collect()]  # GRAM values at most
    found = same
    if sizes:
        wanted = written(rest.select("ref", "low", F.explode(_grams(F.col("low"), F.col("size"))).alias("gram")), "wanted")
        parts = n.select("id", "whole", F.explode(F.concat(*[_grams(F.col("whole"), k) for k in sizes])).alias("gram"))
        parts = written(parts.join(wanted.select("gram").distinct(), "gram", "left_semi"), "parts")
        counts = parts.groupBy("gram").agg(F.count("*").alias("names"))
        rarest = wanted.join(counts, "gram", "left").groupBy("ref", "low").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
        inside = rarest.join(parts, "gram").where(F.contains("whole", "low")).groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        found = same.unionByName(inside.withColumn("tier", F.lit(3)))
    best = found.groupBy("ref").agg(F.min_by(F.struct("tier", "n", "id"), "tier").alias("b"))
    return best.select("ref", F.when((F.col("b.tier") < 3) | (F.col("b.n") == 1), F.col("b.id")).alias("id"), "b.tier")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, and how many."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).where(F.col("values") > 1)
