"""Rule tables over text: each line meets each rule once, the first matching rule of a line wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public API spellings of cryptography in source, text and pages: id, pattern (no look-around), algorithm family.
RULES = [
    ("md5", r"(?i)\bmd5\b", "MD5"),
    ("sha1", r"(?i)\bsha-?1\b", "SHA-1"),
    ("rsa", r"(?i)\brsa\b", "RSA"),
    ("token", r"\btoken\s*=\s*\"[0-9a-f]+\"", "SECRET"),
    ("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+", "CONTACT"),
    ("license", r"(?i)\blicen[sc]e\b", "LICENSE"),
    ("password", r"(?i)\bpassword\b", "SECRET"),
]


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n", "raw"))


def first_matches(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), rule, family, match: for each line the first rule that matches. A text without any match is never exploded."""
    any_rule = F.lit(False)
    for _, pattern, _ in rules:
        any_rule = any_rule | F.col(text_col).rlike(pattern)
    found = lines(df.where(any_rule), id_col, text_col)
    pick = F.lit(None).cast("struct<rule:string,family:string,match:string>")
    for name, pattern, family in reversed(rules):
        pick = F.when(F.col("raw").rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(family).alias("family"), F.regexp_extract("raw", pattern, 0).alias("match"))).otherwise(pick)
    return found.withColumn("hit", pick).where("hit is not null").select("id", (F.col("n") + 1).cast("bigint").alias("line"), "hit.*")


def without_imports(hits: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports count only where no call in the same text has their family."""
    return hits.unionByName(imports.join(hits.select("id", "family").distinct(), ["id", "family"], "left_anti").select(hits.columns))


def precision_recall(judged: DataFrame, by: list[str]) -> DataFrame:
    """judged: truth and found as booleans. Rates by every set of `by` and overall, nulls where nothing was there."""
    sets = judged.cube(*by).agg(
        F.count_if(F.col("truth") & F.col("found")).alias("tp"), F.count_if(~F.col("truth") & F.col("found")).alias("fp"), F.count_if(F.col("truth") & ~F.col("found")).alias("fn")
    )
    rate = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sets.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)})
