"""Rolling hashes of windows, anchors of windows, and a count-min sketch of anchors merged from the partitions.

The anchor of a window is the least hash among the k-grams in it. It depends on nothing but the window's own content, so
equal windows have equal anchors, and neighbouring windows mostly share theirs: there are some twenty times fewer anchors
than windows. A window can only repeat if its anchor does. The sketch counts anchors and never counts too low, so the windows
whose anchor it knows less than twice are certainly unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Two odd multipliers for polynomials modulo 2**64, and those that spread anchors over the sketch's rows.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Counters in a shard of a sketch row (as exponent of 2), and in a whole row at most: 2 rows of 2**29 bits are 128 MB.
SHARD, WIDEST = 20, 29

#: Codes that are hashed at once: powers are kept for a block and a window, however long a text is.
BLOCK = 1 << 16
#: Anchors that a task holds before it gives their counters away.
HELD = 1 << 20


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    make = lambda b: np.concatenate([np.ones(1, U), np.cumprod(np.full(n, b, U))])
    return make(base), make(pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order in them."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def rolling(codes: np.ndarray, size: int, base: int = BASES[0], spread: Callable[[np.ndarray], np.ndarray] = mix) -> np.ndarray:
    """A hash of codes[i : i + size] for every i, a block at a time. spread: codes to 64-bit numbers."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    power, inverse = powers(base, BLOCK + size)
    for low in range(0, n, BLOCK):
        part = spread(codes[low : low + BLOCK + size - 1])
        total = np.concatenate([np.zeros(1, U), np.cumsum(part * power[: len(part)], dtype=U)])
        out[low : low + BLOCK] = mix((total[size:] - total[:-size]) * inverse[: len(part) - size + 1])
    return out


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """min(values[i : i + size]) for every i, by doubling."""
    reach = 1
    while reach * 2 <= size:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (size - reach)], values[size - reach :]) if reach < size else values


def anchors(codes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window of codes its anchor."""
    grams = rolling(codes, gram)
    return least_of(grams, window - gram + 1) if len(grams) >= window - gram + 1 else np.zeros(0, U)


def cells(hashes: np.ndarray, bits: int, rows: int = len(ROWS)) -> list[np.ndarray]:
    """The counter of each hash in each row of the sketch."""
    return [((hashes * U(m)) >> U(64 - bits)).astype(np.int64) for m in ROWS[:rows]]


def width_for(expected: int, each: int = 4) -> int:
    """Bits of a counter's number for so many anchors: so many counters each, within bounds."""
    return min(WIDEST, max(16, (each * max(1, expected) - 1).bit_length()))


def merged_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, at_least: int = 2, rows: int = len(ROWS)) -> list[np.ndarray]:
    """For each row of the sketch a bitmap of the counters that reach `at_least`."""
    return merged_levels(df, hashes, bits, (at_least,), rows)[0]


def merged_levels(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, levels: tuple[int, ...], rows: int = len(ROWS)) -> list[list[np.ndarray]]:
    """For each of the rising levels, and each row of the sketch, a bitmap of the counters that reach it.

    hashes: the anchors in a batch of df. Each task counts in its own sketch and gives away, shard by shard, the counters it
    has touched; shards are added up where they meet. Bitmaps of at most 2**WIDEST bits come to the driver.
    """
    shard, at_least = min(SHARD, bits), levels[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(seen)
            for row, number in enumerate(cells(every, bits, rows)):
                touched, counts = np.unique(number, return_counts=True)
                part = touched >> shard
                edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                keys, places, values = [], [], []
                for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                    keys.append(row << 20 | int(part[a]))
                    places.append((touched[a:b] & ((1 << shard) - 1)).astype("<u4").tobytes())
                    values.append(np.minimum(counts[a:b], at_least).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["shard", "places", "counts"])

        for batch in batches:
            for got in hashes(batch):
                seen.append(got)
                size += len(got)
            if size > HELD:
                yield from out()
                seen, size = [], 0
        if size:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, place, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(key, np.zeros(1 << shard, np.uint16))
                at = np.frombuffer(place, "<u4")
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(value, "<u2"), at_least)
        for key, total in sums.items():
            found = [np.packbits(total >= level, bitorder="little").tobytes() for level in levels]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(levels), pa.int32()), pa.array(range(len(levels)), pa.int32()), pa.array(found, pa.binary())], ["shard", "level", "bitmap"])

    own = df.mapInArrow(count, "shard int, places binary, counts binary")
    shards = rows << (bits - shard)
    total = own.repartition(max(1, min(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "shard").mapInArrow(add, "shard int, level int, bitmap binary")
    out = [[np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(rows)] for _ in levels]
    step = (1 << shard) >> 3
    for row in total.toLocalIterator():
        k = row.shard & ((1 << 20) - 1)
        out[row.level][row.shard >> 20][k * step : (k + 1) * step] = np.frombuffer(row.bitmap, np.uint8)
    return out


def reaches(bitmaps: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the least of an anchor's counters reaches the bound of the bitmaps."""
    good = np.ones(len(hashes), bool)
    for bitmap, number in zip(bitmaps, cells(hashes, bits, len(bitmaps)), strict=True):
        good &= (bitmap[number >> 3] >> (number & 7).astype(np.uint8) & 1).astype(bool)
    return good


def text_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
