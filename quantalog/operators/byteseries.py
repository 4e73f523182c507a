"""Byte patterns and tables of constants in binary content.

Patterns go through one automaton, which is built once and sent to every task; content is searched window by window, and a window
answers for the matches that start in its own part, so none is lost or told twice at a border. Tables of number-theoretic
transforms are recomputed from their public parameters in columns, and looked for as runs of integers that are nearly all
entries of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quantalog.operators.checkpoints import written

# First bytes of tables and initial values of public algorithms. Fixed values.
CONSTANTS = [
    ("aes_te0", "AES", "c66363a5f87c7c84ee777799f67b7b8dfff2f20dd66b6bbdde6f6fb191c5c554"),
    ("aes_te0", "AES", "a56363c6847c7cf8997777ee8d7b7bf60df2f2ffbd6b6bd6b16f6fde54c5c591"),
    ("sha256_k", "SHA-256", "428a2f9871374491b5c0fbcfe9b5dba53956c25b59f111f1923f82a4ab1c5ed5"),
    ("sha256_k", "SHA-256", "982f8a4291443771cffbc0b5a5dbb5e95bc25639f111f159a4823f92d55e1cab"),
    ("sha1_iv", "SHA-1", "67452301efcdab8998badcfe10325476c3d2e1f0"),
    ("sha1_iv", "SHA-1", "0123456789abcdeffedcba9876543210f0e1d2c3"),
    ("md5_t", "MD5", "d76aa478e8c7b756242070dbc1bdceeef57c0faf4787c62aa8304613fd469501"),
    ("md5_t", "MD5", "78a46ad756b7c7e8db702024eecebdc1af0f7cf52ac68747134630a8019546fd"),
    ("blowfish_p", "Blowfish", "243f6a8885a308d313198a2e03707344a4093822299f31d0"),
    ("blowfish_p", "Blowfish", "886a3f24d308a3852e8a191344737003223809a4d0319f29"),
    ("chacha_sigma", "ChaCha20", "657870616e642033322d62797465206b"),
]
#: Bytes of content that a task looks at together, and bytes of all patterns: the automaton takes some 100 for each of them.
WINDOW_BYTES, MOST_PATTERN_BYTES = 1 << 20, 1 << 20


def _parts(df: DataFrame, id_col: str, content_col: str, own: int, more: int, less: int = 0) -> DataFrame:
    """id, row, start, own (bytes that this part answers for), from (its first byte), part (with up to `less` bytes of what is before and `more` of what follows)."""
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(content_col).alias("content")).where("length(content) > 0")
    starts = F.sequence(F.lit(0), F.length("content") - 1, F.lit(own))
    first = lambda s: F.greatest(s - less, F.lit(0))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), first(s).alias("from"), F.substring(F.col("content"), first(s) + 1, s - first(s) + own + more).alias("part")))
    return rows.select("id", "row", F.explode(cut).alias("w")).select("id", "row", F.col("w.start").alias("start"), F.least(F.lit(own), F.length("w.part") - F.col("w.start") + F.col("w.from")).alias("own"), F.col("w.from").alias("from"), F.col("w.part").alias("part"))


def find_all(df: DataFrame, patterns: list[tuple[str, bytes]], most: int = 16, id_col: str = "id", content_col: str = "content", window: int = WINDOW_BYTES) -> DataFrame:
    """id, pattern, offset (from 0): where each pattern starts in each row's content, overlapping ones too, the first `most` of each name.

    Several patterns may have one name. Null and empty content has no matches; rows that repeat an id are searched one by one.
    """
    import ahocorasick

    sound = [(name, p) for name, p in patterns if p]
    if sum(len(p) for _, p in sound) > MOST_PATTERN_BYTES:
        raise ValueError(f"more than {MOST_PATTERN_BYTES} bytes of patterns")
    table = ahocorasick.Automaton()
    named: dict[str, list[str]] = {}
    for name, p in sound:
        named.setdefault(p.decode("latin-1"), []).append(name)
    for text, names in named.items():
        table.add_word(text, (len(text), tuple(dict.fromkeys(names))))
    fields = "id string, row long, pattern string, offset long"
    if not named:
        return df.sparkSession.createDataFrame([], fields).select(F.col("id").cast(df.schema[id_col].dataType), "pattern", "offset")
    table.make_automaton()
    sent = df.sparkSession.sparkContext.broadcast(table)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row, start, own, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for end, (length, names) in sent.value.iter(part.decode("latin-1")):
                    if (at := end - length + 1) < own:
                        out += [(i, row, name, start + at) for name in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["id", "row", "pattern", "offset"])

    parts = _parts(df, id_col, content_col, window, max(map(len, named)) - 1)
    kept = parts.select(F.col("id").cast("string").alias("id"), "row", F.col("start").cast("long"), F.col("own").cast("long"), "part").mapInArrow(search, fields).distinct()
    place = F.row_number().over(Window.partitionBy("row", "pattern").orderBy("offset"))
    return kept.withColumn("n", place).where(F.col("n") <= most).select(F.col("id").cast(df.schema[id_col].dataType).alias("id"), "pattern", "offset")


# Number-theoretic transforms of lattice schemes: modulus, root of unity, bits of an index, bytes of an entry. Fixed values.
TRANSFORMS = [("ML-KEM", 3329, 17, 7, 2), ("ML-DSA", 8380417, 1753, 8, 4)]
# Entries of a window, how many of them must be of a table, and how many different ones. Fixed values.
RUN, MATCH, DISTINCT = 32, 24, 16


def transform_tables(spark: SparkSession) -> DataFrame:
    """scheme, width, value: every entry of the tables as it may be stored: plain or in Montgomery form, from 0 or centred, as an unsigned integer."""
    parts = []
    for scheme, q, root, bits, width in TRANSFORMS:
        index = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("int")
        power = F.aggregate(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), F.lit(1).cast("bigint"), lambda a, n: F.when(n < F.col("index"), a * root % q).otherwise(a))
        rows = spark.range(1 << bits).withColumn("index", index).withColumn("z", power)
        forms = F.array("z", F.pmod(F.col("z") * (1 << (8 * width)), F.lit(q)))
        stored = F.flatten(F.transform(forms, lambda v: F.array(v, F.when(v > q // 2, v - q).otherwise(v))))
        unsigned = F.transform(stored, lambda v: F.pmod(v, F.lit(1 << (8 * width))))
        parts.append(rows.select(F.lit(scheme).alias("scheme"), F.lit(width).alias("width"), F.explode(unsigned).alias("value")).where("value > 1").distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pieces(part: bytes, first: int, start: int, own: int, width: int, known: np.ndarray) -> Iterator[tuple]:
    """align, the least and greatest run with a hit, and the first byte, last byte and number of the entries in this part's own bytes, for each table in it.

    Runs go by the number of their first integer. `part` has what comes RUN - 1 integers before and after its own bytes, so all runs
    that an own entry may be in are seen.
    """
    for skip in range(min(width, len(part) - RUN * width + 1)):
        values = np.frombuffer(part, f"<u{width}", (len(part) - skip) // width, skip)
        entry = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
        sums = np.concatenate(([0], np.cumsum(entry)))
        runs = np.flatnonzero(sums[RUN:] - sums[:-RUN] >= MATCH)
        if not len(runs):
            continue
        inside = np.sort(np.lib.stride_tricks.sliding_window_view(np.where(entry, values.astype("i8"), -1), RUN)[runs], axis=1)
        runs = runs[(inside[:, 0] >= 0).astype(int) + ((inside[:, 1:] != inside[:, :-1]) & (inside[:, 1:] >= 0)).sum(axis=1) >= DISTINCT]
        at = first + skip + np.arange(len(values)) * width
        mine, n = entry & (at >= start) & (at < start + own), (first + skip) // width
        for hits in np.split(runs, np.flatnonzero(np.diff(runs) > RUN) + 1) if len(runs) else ():
            within = hits[np.searchsorted(hits, np.arange(hits[0], hits[-1] + RUN), side="right") - 1] + RUN > np.arange(hits[0], hits[-1] + RUN)
            held = at[hits[0] : hits[-1] + RUN][within & mine[hits[0] : hits[-1] + RUN]]
            yield (first + skip) % width, n + hits[0], n + hits[-1], *((held[0], held[-1]) if len(held) else (None, None)), len(held)


def find_tables(df: DataFrame, id_col: str = "id", content_col: str = "content", window: int = 1 << 16) -> DataFrame:
    """id, scheme, offset, length (bytes), matched (entries): where content holds a table of a transform, in any order and with gaps.

    RUN integers in a row are a hit where MATCH of them are entries and DISTINCT of these differ. Hits that overlap or touch are one, from its
    first entry to its last. A code that computes its table when it starts holds none. Windows of content are searched in the tasks and
    give a row for each table in them; rows of neighbours become one here.
    """
    known: dict[tuple, list] = {}
    for r in transform_tables(df.sparkSession).collect():  # some 1,500 rows
        known.setdefault((r.scheme, r.width), []).append(r.value)
    schemes = [(scheme, width, np.array(sorted(values), f"<u{width}")) for (scheme, width), values in known.items()]
    widest = max(width for _, width, _ in schemes)
    kind = df.schema[id_col].dataType
    fields = "scheme string, width long, row long, align long, least long, greatest long, first long, last long, matched long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, (row, start, own, first, part) in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                for scheme, width, values in schemes:
                    for piece in _pieces(bytes(part), first, start, own, width, values):
                        of.append(i)
                        out.append((scheme, width, row, *piece))
            columns = zip(*out, strict=True) if out else [()] * 9
            types = [pa.string(), *[pa.int64()] * 8]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array([x if x is None or t == pa.string() else int(x) for x in c], t) for c, t in zip(columns, types, strict=True)]], names=["id", *[f.split()[0] for f in fields.split(", ")]])

    parts = _parts(df, id_col, content_col, window, RUN * widest - 1, (RUN - 1) * widest).select("id", "row", *[F.col(c).cast("long") for c in ("start", "own", "from")], "part")
    schema = StructType([StructField("id", kind), *[StructField(n, StringType() if t == "string" else LongType()) for n, t in map(str.split, fields.split(", "))]])
    pieces = written(parts.mapInArrow(search, schema), "pieces")
    by = ["scheme", "width", "row", "align"]
    order = Window.partitionBy(*by).orderBy("least", "greatest")
    before = F.max("greatest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = pieces.withColumn("apart", F.coalesce((F.col("least") > before + RUN).cast("int"), F.lit(1))).withColumn("span", F.sum("apart").over(order))
    found = spans.groupBy("id", *by, "span").agg(F.min("first").alias("offset"), (F.max("last") + F.max("width") - F.min("first")).alias("length"), F.sum("matched").alias("matched"))
    return found.select("id", "scheme", "offset", "length", "matched")
