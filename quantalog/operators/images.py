"""Container images: the view that layers and their whiteouts leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(path: str):
    """The path and every directory above it, down to ''."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def merged_view(entries: DataFrame) -> DataFrame:
    """entries: layer int, path, size. What is visible after all layers: path, layer, size.

    A '.wh.name' entry deletes the path and what lies below it from lower layers only; '.wh..wh..opq' empties its directory of
    them. A file meets deletions by its own ancestors, so the join is by equality; the latest deletion of each path counts.
    """
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')")
    rows = entries.withColumns({"base": base, "folder": folder})
    opaque = rows.where("base = '.wh..wh..opq'").select(F.col("folder").alias("above"), F.col("layer").alias("gone"), F.lit(False).alias("itself"))
    named = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), F.expr("substring(base, 5)"))
    white = rows.where("startswith(base, '.wh.') and base <> '.wh..wh..opq'").select(named.alias("above"), F.col("layer").alias("gone"), F.lit(True).alias("itself"))
    files = rows.where("not startswith(base, '.wh.')").groupBy("path").agg(F.max("layer").alias("layer"), F.max_by("size", "layer").alias("size"))
    marks = opaque.unionByName(white).groupBy("above", "itself").agg(F.max("gone").alias("gone"))
    hits = files.select("path", "layer", F.explode(ancestors("path")).alias("above")).join(marks, "above")
    hits = hits.where((F.col("gone") > F.col("layer")) & (F.col("itself") | (F.col("above") != F.col("path"))))
    return files.join(hits.select("path").distinct(), "path", "left_anti").select("path", "layer", "size")
