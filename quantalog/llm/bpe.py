"""Byte-level BPE encoding and decoding on length-bucketed matrices.

Units (see units.py) that a worker has not met before, and the pieces (matches of the split pattern) of long units, are laid
out as rows of padded matrices, one per length bucket; pairs across two pieces never merge. Every round each row merges its leftmost pair of least rank; pairs are looked up by hash for the whole
matrix, rows without a mergeable pair leave, and the rest close up by one column.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import SLICE_BYTES, binary_array, list_array, slices, spread
from quantalog.llm.units import IntMap, UnitStore, piece_starts

NONE = np.int32(np.iinfo(np.int32).max)
#: No token id: fills rows up; is added to an id where a piece begins.
PAD, OPENS = np.int32(1 << 29), np.int32(1 << 30)
#: Longer units (bytes) are cut into their pieces, a row for each. A piece of over LONGEST_PIECE bytes, without a space or a change of
#: kind in all of it, is merged with a heap: that takes n log n steps where its row would take n rounds over n columns.
LONGEST_ROW, LONGEST_PIECE = 256, 1024
MULTI_50K = "byte_bpe_multi_50k.tiktoken"


class RankEncoder:
    """Encodes by a rank file, without special tokens, each match of the pattern separately."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.pairs = IntMap(keys, np.array(merged, np.int32))
        self.pair_rank = dict(zip(keys.tolist(), merged, strict=True))
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.token_lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.store = UnitStore(self.encode_units, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs; NONE where they don't merge. A right side that opens a piece carries OPENS and so is in no pair."""
        got = self.pairs.get((left & ~OPENS).astype(np.int64) << 32 | right.astype(np.int64))
        return np.where(got < 0, NONE, got)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row of byte ids for each unit, OPENS added where a piece begins, padded with PAD. The merged rows, and their lengths."""
        out, lengths, number = np.full(ids.shape, PAD, np.int32), np.zeros(len(ids), np.int64), np.arange(len(ids))
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(number):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(number), np.int64)
            least = ranks[np.arange(len(at)), at] if ranks.shape[1] else np.full(len(at), NONE)
            done = least == NONE
            if done.any():
                out[number[done], : ids.shape[1]] = ids[done]
                lengths[number[done]] = (ids[done] != PAD).sum(1)
                ids, ranks, number, at, least = ids[~done], ranks[~done], number[~done], at[~done], least[~done]
            rows, columns = np.arange(len(at)), np.arange(ids.shape[1] - 1)
            ids[rows, at] = least | (ids[rows, at] & OPENS)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                r, c = rows[ok], side[ok]
                ranks[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        return out & ~OPENS, lengths

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece, by a heap of pairs over a linked list."""
        ids, n, rank = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), len(piece), self.pair_rank
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = following[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = r, -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (s := rank.get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := previous[i]) >= 0 and (s := rank.get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        long = {i: self.pattern.findall(t) for i, t in enumerate(texts) if len(t) * 4 > LONGEST_ROW and len(t.encode()) > LONGEST_ROW}
        if not long:
            return self._rows(texts, len(texts))
        short = [t for i, t in enumerate(texts) if i not in long]
        pieces = list(dict.fromkeys(p for found in long.values() for p in found))
        values, lengths = self._rows(short + pieces, len(short))
        number, nth = dict(zip(pieces, range(len(short), len(short) + len(pieces)), strict=True)), iter(range(len(short)))
        rows = [[number[p] for p in long[i]] if i in long else [next(nth)] for i in range(len(texts))]
        every = np.fromiter((r for x in rows for r in x), np.int64)
        starts, own = np.cumsum(lengths) - lengths, lengths[every]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])
        stops = np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))
        return values[spread(starts[every], own)], np.diff(np.concatenate([np.zeros(1, np.int64), ends[stops]]))

    def _rows(self, texts: list[str], units: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_units. The first `units` texts may fall into pieces; the others are one piece each."""
        data = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        which, offsets = piece_starts(texts[:units], data, self.pattern.findall)
        width = np.where(sizes <= 24, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        lengths, found = np.zeros(len(texts), np.int64), []
        order = np.argsort(width, kind="stable")
        cuts = np.flatnonzero(np.diff(width[order])) + 1
        row_of = np.zeros(len(texts), np.int64)
        for members in np.split(order, cuts):
            w = int(width[members[0]]) if len(members) else 0
            if w == 0:
                continue
            if w > LONGEST_PIECE:
                for i in members.tolist():
                    ids = self.merge_long(data[i])
                    lengths[i] = len(ids)
                    found.append((np.array([i]), ids[None, :]))
                continue
            row_of[members] = np.arange(len(members))
            here = np.flatnonzero(width[which] == w)
            row, column = row_of[which[here]], offsets[here]
            for first in range(0, len(members), step := max(1, (1 << 18) // w)):
                part = members[first : first + step]
                raw = np.frombuffer(b"".join([data[i].ljust(w, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), w)
                ids = np.where(np.arange(w) < sizes[part][:, None], self.byte_ids[raw], PAD)
                mine = (row >= first) & (row < first + step)
                ids[row[mine] - first, column[mine]] |= OPENS
                merged, lengths[part] = self.merge_rows(ids)
                found.append((part, merged))
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        for part, rows in found:
            here = np.arange(rows.shape[1]) < lengths[part][:, None]
            flat[(starts[part][:, None] + np.arange(rows.shape[1]))[here]] = rows[here]
        return flat, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        return self.store.values(texts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id sequences one after the other, and how many each has."""
        lengths = self.token_lengths[ids]
        data = self.token_bytes[spread(self.token_starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum(counts)
        return data, ends[stops] - ends[stops - counts]


@lru_cache(maxsize=4)
def encoder(path: str) -> RankEncoder:
    """One for each worker process and rank file."""
    return RankEncoder(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row: the token ids of its whole text.

    A null text counts as empty and has no ids; null and repeated row ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, 1, 2 * SLICE_BYTES):
                ids, counts = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, counts, pa.int32())], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary) for each row: the bytes that its token ids stand for. Null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                data, lengths = coder.decode(ids, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, binary_array(np.ascontiguousarray(data), lengths)], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
