"""What the operators of this subpackage share: written tables, byte-bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import removed, scratch, shared_path, written

__all__ = ["ascii_lower", "binary_array", "list_array", "removed", "scratch", "shared_path", "slices", "spread", "word_count", "written"]

#: Bytes of text that Python code works on at once; one longer row still comes whole.
SLICE_BYTES = 1 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """The number of maximal runs of other characters than ASCII white space; null has none. Linear, and no list of words is built.

    White space between two words is made one space where it isn't yet, so that only odd places cost a replacement.
    """
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " "))
    return F.when(one == "", 0).otherwise(F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with at most `limit` bytes in `column` each (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... (lengths[i] of them), one after the other for all i."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_array(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column cut out of one buffer."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
