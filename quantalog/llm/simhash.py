"""SimHash near-duplicates, candidates by the pigeonring principle.

The 64 bits lie in m segments on a ring. If two fingerprints differ in at most t bits, then from some segment on, the first
j segments together differ in at most floor(j * t / m) bits, for every j (the budgets grow in proportion along the chain).
So the first segments of a chain, those whose budget is still below 1, are equal. Fingerprints therefore meet by equality on
the m possible runs of these leading segments; the rest of the chain's budgets and the full Hamming distance are conditions
of that join, so only links leave it.

A run shared by very many fingerprints would compare all its pairs. Beyond BUCKET fingerprints it takes an exact way that
emits no pairs: two fingerprints differ in at most t bits if and only if flipping at most half of t bits of each (rounded up
for one of them) can make them equal. Each fingerprint of such a run visits its neighbours at so many flipped bits, and all
that meet at one are linked, each to the least. That way grows with the fingerprints and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import slices, written
from quantalog.operators.components import connected_components

BITS, SEED = 64, 42
#: Fingerprints on one run of leading segments that are compared pair by pair, by the most differing bits; visits grow with these.
BUCKET = {0: 256, 1: 256, 2: 256, 3: 4096, 4: 4096}
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64. No words: 0."""
    words = text.translate(UPPER).split()  # bytes.split knows no white space but \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """A number whose bits are 1 where they are in over half of the hashes; 0 for none."""
    total = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): fp has the fingerprint's bits. A null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                prints = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def _mask(segments: list[tuple[int, int]]) -> int:
    mask = sum(((1 << size) - 1) << low for low, size in segments)
    return mask - (1 << 64) if mask >> 63 else mask


def ring(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _chain(a: Column, b: Column, first: int, parts: list[tuple[int, int]], most: int) -> Column:
    """Whether the chain from segment `first` on keeps every budget; the last one is the full Hamming distance."""
    m, ok = len(parts), None
    for j in range(1, m + 1):
        run = [parts[(first + i) % m] for i in range(j)]
        within = F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_mask(run)).cast("long"))) <= j * most // m
        ok = within if ok is None else ok & within
    return ok


def links(prints: DataFrame, most: int = 2, segments: int = 5, bucket: int | None = None) -> DataFrame:
    """(src, dst): edges between distinct fingerprints (column fp) that connect just those with at most `most` different bits.

    Every link shows directly, or, on crowded runs, as a path of links.
    """
    if most not in BUCKET:
        raise ValueError(f"at most {max(BUCKET)} differing bits")
    bucket = bucket or BUCKET[most]
    parts = ring(segments)
    lead = max([j for j in range(1, segments + 1) if j * most // segments == 0], default=0)
    if not lead:
        raise ValueError("more segments than differing bits are needed")
    mask = F.element_at(F.array(*[F.lit(_mask([parts[(i + j) % segments] for j in range(lead)])).cast("long") for i in range(segments)]), F.col("first") + 1)
    runs = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("first")).withColumn("run", F.col("fp").bitwiseAND(mask))
    crowded = written(runs.groupBy("first", "run").count().where(F.col("count") > bucket).select("first", "run"), "crowded")
    if crowded.isEmpty():
        crowded = None
    calm = runs if crowded is None else runs.join(crowded, ["first", "run"], "left_anti")
    a, b = calm.alias("a"), calm.alias("b")
    good = F.lit(False)
    for first in range(segments):
        good = good | ((F.col("a.first") == first) & _chain(F.col("a.fp"), F.col("b.fp"), first, parts, most))
    same = (F.col("a.first") == F.col("b.first")) & (F.col("a.run") == F.col("b.run"))
    edges = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & good).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    if crowded is None:
        return edges
    packed = runs.join(crowded, ["first", "run"], "left_semi").select("fp").distinct()
    sets = [c for n in range(-(-most // 2) + 1) for c in combinations(range(BITS), n)]
    masks = F.array(*[F.lit(_mask([(i, 1) for i in c])).cast("long") for c in sets])
    few = sum(len(c) <= most // 2 for c in sets)
    visits = packed.select("fp", F.posexplode(masks).alias("n", "bits")).select("fp", F.col("fp").bitwiseXOR(F.col("bits")).alias("at"), (F.col("n") < few).alias("few"))
    met = visits.groupBy("at").agg(F.min(F.when(F.col("few"), F.col("fp"))).alias("dst"), F.count("*").alias("n")).where("n > 1 and dst is not null").select("at", "dst")
    return edges.unionByName(visits.join(met, "at").where("fp != dst").select(F.col("fp").alias("src"), "dst").distinct())


def near_duplicates(df: DataFrame, most: int = 2, shingle: int = 3, segments: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: id, fp long, component_id (the smallest id reachable over links; a null id only if all are).

    Texts are lower-cased (A-Z), cut into words of anything but \\x20 and \\x09-\\x0D, and shingled. Texts with the same
    fingerprint are linked; null and empty texts have fingerprint 0. Repeated rows and ids come row by row; other columns
    are ignored; an empty table gives an empty result.
    """
    rows = written(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    joined = connected_components(written(links(prints.select("fp"), most, segments), "links"))
    named = joined.join(prints.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = joined.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    labels = written(prints.join(of_print, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
