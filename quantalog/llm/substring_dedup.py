"""Removal of word passages that an earlier document has, behind a count-min prefilter.

A row whose words are just those of an earlier row is wholly covered (or, below a window, not at all) and needs no windows.
Of the others, every partition counts the anchors of its windows (see sketch.py) in a count-min sketch; the merged sketch overestimates.
An anchor's count is at least that of each window that has it, so windows are overestimated too and no repeated one is lost.
The second pass groups exactly, by 128 bits made of two independent codes of every word, only windows estimated to repeat; a
unique window may be among them and is found unique there. Each document then learns which of its windows start earlier
elsewhere and drops the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import slices, written
from quantalog.llm.sketch import BASES, anchors, merged_sketch, reaches, rolling, text_bytes, width_for

#: Words of a gram. Long grams seldom outlive an edit, so few windows are taken for repeats that aren't.
GRAM = 25
#: Bytes of text for each word, low, to size the sketch.
WORD_BYTES = 5


class _Codes(dict):
    """128-bit hashes of words; forgets all when it holds many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 1 << 16:
            self.clear()
        code = self[word] = xxhash.xxh3_128_digest(word)
        return code


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent codes of all words one after the other, and how many words each text has."""
    words = [t.split() for t in texts]  # bytes.split knows no white space but \x20 and \x09-\x0D
    number = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(b"".join(map(CODES.__getitem__, chain.from_iterable(words))), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1]), number


CODES = _Codes()


def _hashes(one: np.ndarray, other: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for every window: two hashes of different codes of the words, by different multipliers."""
    return rolling(one, window, BASES[0]).view(np.int64), rolling(other, window, BASES[1]).view(np.int64)


def _windows(number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have windows, by number of their first word: start of each window among all words, and its text."""
    count = np.maximum(number - size + 1, 0)
    first = np.cumsum(number) - number
    text = np.repeat(np.arange(len(number)), count)
    ends = np.cumsum(count)
    start = np.arange(int(count.sum())) - np.repeat(ends - count, count) + np.repeat(first, count)
    return start, text


def remove_repeats(df: DataFrame, window: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A row for each row of df: id, the carried columns, n_words long, n_removed long, kept string.

    Words are runs of anything but \\x20 and \\x09-\\x0D. A word goes if a window of `window` words that covers it also starts
    in a row with a smaller id; windows are judged on the input. kept joins the other words by single spaces. A null text
    has no words. Rows with a null id count as later than all others and not as earlier than each other; rows with the same
    id are not earlier than each other. An empty table gives an empty result; columns not carried are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("rk"))
    copies = written(_copies(rows, window), "copies")
    rest = rows.join(copies, rows.id.eqNullSafe(copies.of) & (rows.rk == copies.of_rk), "left_anti")
    bits = width_for(2 * text_bytes(rows, "text") // (WORD_BYTES * (window - gram + 2)))

    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in slices(batch, 0):
            codes, _, number = _words(part.column(0).to_pylist())
            start, text = _windows(number, window)
            if len(start):
                own = anchors(codes, window, gram)[start]
                yield own[np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))]  # once for windows in a row

    bitmaps = spark.sparkContext.broadcast(merged_sketch(rest.select("text"), found, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                codes, more, number = _words(part.column(2).to_pylist())
                start, text = _windows(number, window)
                if not len(start):
                    continue
                twice = reaches(bitmaps.value, anchors(codes, window, gram)[start], bits)
                start, text = start[twice], text[twice]
                one, other = (h[start] for h in _hashes(codes, more, window))
                order = np.lexsort([other, one, text])  # a window that repeats within its text counts once
                one, other, text = one[order], other[order], text[order]
                new = np.append(True, (one[1:] != one[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])) if len(one) else np.zeros(0, bool)
                row = pa.array(text[new])
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(one[new]), pa.array(other[new])], ["id", "rk", "one", "other"])

    kind = df.schema[id_col].dataType.simpleString()
    seen = written(rest.select("id", "rk", "text").mapInArrow(suspects, f"id {kind}, rk long, one long, other long"), "windows")
    first = seen.groupBy("one", "other").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    later = seen.join(written(first, "firsts"), ["one", "other"]).where("id is null or id > first")
    marks = later.select("id", "rk", F.struct("one", "other").alias("w"), F.lit(False).alias("copy"))
    marks = marks.unionByName(copies.select(F.col("of").alias("id"), F.col("of_rk").alias("rk"), F.lit(None).cast("struct<one:bigint,other:bigint>").alias("w"), F.lit(True).alias("copy")))
    # By id and text: rows without an id, or that repeat one, don't share a list.
    of_row = marks.groupBy(F.col("id").alias("of"), F.col("rk").alias("of_rk")).agg(F.collect_set("w").alias("windows"), F.max("copy").alias("copy"))
    carried = [f"c{i}" for i in range(len(carry))]
    plain = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = df.select(F.col(id_col).alias("own"), plain.alias("text"), *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, carried, strict=True)])
    same = texts.own.eqNullSafe(F.col("of")) & (F.xxhash64(texts.text) == F.col("of_rk"))
    joined = texts.join(of_row, same, "left").select("text", "windows", "copy", "own", *carried)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                n_words, n_removed, kept = [], [], []
                for text, windows, copy in zip(*(part.column(k) for k in range(3)), strict=True):
                    words = text.as_py().split()
                    gone = 0
                    if copy.as_py():
                        gone = len(words)
                        kept.append(b"")
                    elif windows.is_valid and len(windows.values):
                        gone_at = _covered(words, *(windows.values.field(k).to_numpy() for k in (0, 1)), window)
                        gone = int(gone_at.sum())
                        kept.append(b" ".join([w for w, g in zip(words, gone_at.tolist(), strict=True) if not g]))
                    else:
                        kept.append(b" ".join(words))
                    n_words.append(len(words)), n_removed.append(gone)
                columns = [part.column(k) for k in range(3, part.num_columns)]
                names = ["own", *carried, "n_words", "n_removed", "kept"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    fields = ", ".join(f"{a} {texts.schema[a].dataType.simpleString()}" for a in ["own", *carried])
    out = joined.mapInArrow(drop, f"{fields}, n_words long, n_removed long, kept string")
    return out.select(F.col("own").alias(id_col), *[F.col(a).alias(c) for c, a in zip(carry, carried, strict=True)], "n_words", "n_removed", "kept")


def _copies(rows: DataFrame, window: int) -> DataFrame:
    """(of, of_rk) of the rows with at least a window of words whose words, one by one, are those of a row with a smaller id."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = [t.split() for t in part.column(1).to_pylist()]
                whole = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(whole, pa.binary()), pa.array([len(w) for w in words], pa.int64())], ["of", "of_rk", "whole", "n"])

    kind = rows.schema["id"].dataType.simpleString()
    every = written(rows.select("id", "text", "rk").mapInArrow(digest, f"of {kind}, of_rk long, whole binary, n long").where(F.col("n") >= window), "wholes")
    first = every.groupBy("whole").agg(F.min("of").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").drop("rows")
    # Written first: the join then deals the rows of one text out to several tasks where they are many.
    return every.join(written(first, "first"), "whole").where("of is null or of > first").select("of", "of_rk").distinct()


def _covered(words: list[bytes], ones: np.ndarray, others: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window with one of the hashes."""
    codes = np.frombuffer(b"".join(map(CODES.__getitem__, words)), np.uint64).reshape(-1, 2)
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    own = np.empty(max(0, len(words) - window + 1), pair)
    own["a"], own["b"] = _hashes(np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1]), window)
    wanted = np.empty(len(ones), pair)
    wanted["a"], wanted["b"] = ones, others
    starts = np.flatnonzero(np.isin(own, wanted))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0
