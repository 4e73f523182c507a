"""Mixture-controlled packing of documents into training windows.

Each source is a queue of tokens (small sources share queues where there are very many). Deficit round-robin serves the queues
by quanta of QUANTUM tokens: in every round each queue's deficit grows by its share, a queue that is owed more than half a
quantum beyond what it has had is served one, and the rest is carried to the next round, over windows and partitions. That has
a closed form: by the end of a round, how many quanta of each queue have been served is arithmetic, and the round in which so
many windows are full is found by bisection. So there is no sequential pass: each task places its own tokens, given how many
of their queue come before them. It looks at the windows that its own quanta fall in, and at no others. A queue that runs dry
ends a phase; the others share what follows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantalog.llm.bpe import RankEncoder
from quantalog.llm.shared import SLICE_BYTES, binary_array, slices, spread, written
from quantalog.llm.units import IntMap, UnitStore, byte_of_letter

#: Tokens of a queue that are served at once.
QUANTUM = 64
#: The tokens of so many (block, source) counts are sent to every executor (about 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Sources with a queue of their own, the largest ones; the others share POOLS queues by a hash of their names. A source beyond the
#: largest 768 has less than a 768th of the tokens, a window's share of one or two tokens at most.
OWN_QUEUES, POOLS = 768, 256
#: Numbers of a matrix (windows or quanta by queues) that are worked out at once.
ROWS = 1 << 18


class LibraryEncoder(RankEncoder):
    """Ids that the tokenizers library gives, its special strings included, for a byte-level BPE file without ignored merges.

    Units are merged in matrices (see bpe.py); the library itself encodes units that contain a special string, and all of
    them if the file's ids don't follow the order of its merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = byte_of_letter()
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [x["content"] for x in spec["added_tokens"]]
        made = [vocab[a + b] for a, b in merges]
        self.ordered = not spec["model"].get("ignore_merges") and all(x < y for x, y in zip(made, made[1:], strict=False))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in of.items():
            self.byte_ids[byte] = vocab[letter]
        keys = [vocab[a] << 32 | vocab[b] for a, b in merges]
        self.pairs, self.pair_rank, self.ranks = IntMap(keys, made), dict(zip(keys, made, strict=True)), {}
        self.store = UnitStore(self.encode_units, np.int32)

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)] if self.ordered else list(range(len(texts)))
        if not odd:
            return super().encode_units(texts)
        hidden = set(odd)
        values, lengths = super().encode_units(["" if i in hidden else t for i, t in enumerate(texts)])
        parts = np.split(values, np.cumsum(lengths)[:-1])
        for i, found in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            parts[i] = np.array(found.ids, np.int32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    """One for each worker process and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


class Mixture:
    """Which tokens of which queue stand where. totals: tokens of each queue; weights: its share (none given: its part of all)."""

    def __init__(self, totals: Mapping[str, int], weights: Mapping[str, float] | None, window: int, quantum: int = QUANTUM):
        self.names = sorted(totals)
        self.number = {name: k for k, name in enumerate(self.names)}
        self.window, self.quantum, self.total = window, quantum, sum(totals.values())
        left = np.array([totals[name] for name in self.names], np.int64)
        share = np.array([float((weights or {}).get(name, 0)) for name in self.names])
        self.phases: list[tuple[int, np.ndarray]] = []  # tokens before it, its tokens of each queue
        at = 0
        while (served := (left > 0) & (share > 0)).any():
            turns = (left[served] / share[served]).min()
            take = np.where(served, np.minimum(left, np.rint(share * turns).astype(np.int64)), 0)
            take[served & (left <= share * turns)] = left[served & (left <= share * turns)]
            self.phases.append((at, take))
            at, left = at + int(take.sum()), left - take
        if left.any():  # no weights, or queues without one: in proportion to what they hold
            self.phases.append((at, left))
        full, rest = divmod(self.total, window)
        tail = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
        self.full, self.tail = full, np.cumsum([full * window, *tail])  # the rest goes into sequences of a power of two
        self.last = full + len(tail) - 1

    def _served(self, take: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first b tokens of a phase; a row for each b."""
        size = int(take.sum())
        _, times, kind = self._rounds(take)
        slack = self.quantum * (len(take) + 2)
        guess = lambda x: np.clip(x / size * times, 0, times - 1).astype(np.int64).astype(kind)
        low, high = guess(b.astype(float) - slack) - 2, guess(b.astype(float) + slack) + 2
        low, high = np.maximum(low, 0), np.minimum(high, times - 1)
        while (low < high).any():  # the first round by which b tokens are due
            middle = (low + high) // 2
            enough = self._upto(take, middle).sum(1) >= b
            low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
        before, after = self._upto(take, low - 1), self._upto(take, low)
        own = after - before  # due in the same round: queue by queue
        return before + np.clip((b - before.sum(1))[:, None] - (np.cumsum(own, 1) - own), 0, own)

    def served(self, b: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first b tokens of all; a row for each b."""
        out = np.zeros((len(b), len(self.names)), np.int64)
        for at, take in self.phases:
            inside = np.clip(b - at, 0, int(take.sum()))
            some = inside > 0
            if some.any():
                out[some] += self._served(take, inside[some])
        return out

    def ends(self, sequence: np.ndarray) -> np.ndarray:
        """Tokens of all in the sequences before each given one."""
        return np.where(sequence <= self.full, sequence * self.window, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def sequence_of(self, position: np.ndarray) -> np.ndarray:
        """The sequence that holds each token, by its number among all."""
        late = self.full + np.searchsorted(self.tail, position, "right") - 1
        return np.where(position < self.full * self.window, position // self.window, np.minimum(late, self.last))

    def _rounds(self, take: np.ndarray) -> tuple[np.ndarray, int, type]:
        """Quanta of each queue in a phase, the rounds of the phase, and a type of numbers that holds their products."""
        quanta = -(-take // self.quantum)
        bits = max(4, (16 * max(1, int(take.sum()) // self.quantum)).bit_length())
        kind = object if bits + 2 + int(quanta.max()).bit_length() > 62 else np.int64
        return quanta.astype(kind), 1 << bits, kind

    def _upto(self, take: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due by the end of each round."""
        quanta, times, _ = self._rounds(take)
        done = ((time[:, None] + 1) * 2 * quanta - 1) // times
        return np.minimum(np.maximum((done + 1) // 2, 0) * self.quantum, take).astype(np.int64)

    def touched(self, queue: int, low: int, high: int) -> np.ndarray:
        """The sequences that hold tokens low to high (exclusive) of a queue: those of its own quanta, worked out from each one's round."""
        found, had = [], 0
        for at, take in self.phases:
            own = int(take[queue])
            a, b = max(low - had, 0), min(high - had, own)
            had += own
            if a >= b:
                continue
            quanta, times, kind = self._rounds(take)
            for first in range(a // self.quantum, -(-b // self.quantum), step := max(1, ROWS // len(take))):
                k = np.arange(first, min(first + step, -(-b // self.quantum))).astype(kind)
                time = -((-((2 * k + 1) * times + 1)) // (2 * quanta[queue])) - 1
                before, after = self._upto(take, time - 1), self._upto(take, time)
                start = at + before.sum(1) + (after - before)[:, :queue].sum(1) + k.astype(np.int64) * self.quantum - before[:, queue]
                end = start + np.minimum(self.quantum, own - k.astype(np.int64) * self.quantum) - 1
                found += [self.sequence_of(start), self.sequence_of(end)]
        every = np.unique(np.concatenate(found))
        return np.unique(np.concatenate([every, np.arange(self.full, self.last + 1)])) if every[-1] >= self.full else every

    def place(self, queue: str, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents that follow each other in a queue, from token first[0] on: document number, start, length, sequence, offset of each piece."""
        queue, low, high = self.number[queue], int(first[0]), int(first[-1] + size[-1])
        sequence = self.touched(queue, low, high)
        edge, stop, ahead = (np.empty(len(sequence), np.int64) for _ in range(3))
        for a in range(0, len(sequence), step := max(1, ROWS // len(self.names))):
            part = slice(a, a + step)
            had, then = self.served(self.ends(sequence[part])), self.served(self.ends(sequence[part] + 1))
            edge[part], stop[part], ahead[part] = had[:, queue], then[:, queue], (then - had)[:, :queue].sum(1)
        some = stop > edge
        sequence, edge, ahead = sequence[some], edge[some], ahead[some]
        cut = np.unique(np.concatenate([first, edge[(edge > low) & (edge < high)]]))
        document = np.searchsorted(first, cut, "right") - 1
        at = np.searchsorted(edge, cut, "right") - 1
        return document, cut - first[document], np.diff(np.append(cut, high)), sequence[at], ahead[at] + cut - edge[at]


@lru_cache(maxsize=2)
def id_type(path: str) -> np.dtype:
    """Numbers that hold every id of a vocabulary file."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


def tokenised(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, block, before, n_tokens, ids): before counts the tokens of the same source earlier in the block; ids are packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block, counts = library(path), TaskContext.get().partitionId(), {}
        kind = id_type(path)
        for batch in batches:
            for part in slices(batch, 2, 2 * SLICE_BYTES):
                ids, sizes = coder.encode(part.column(2).to_pylist())
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                before = []
                for source, size in zip(part.column(1).to_pylist(), sizes.tolist(), strict=True):
                    before.append(counts.get(source, 0))
                    counts[source] = before[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(sizes), block, np.int32)), pa.array(before, pa.int64()), pa.array(sizes), binary_array(ids.astype(kind), sizes * kind.itemsize)],
                    ["id", "source", "block", "before", "n_tokens", "ids"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, source string, block int, before long, n_tokens long, ids binary")


def pack(
    df: DataFrame,
    path: str,
    window: int = 1024,
    weights: Mapping[str, float] | None = None,
    end_id: int = 0,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row for each piece: id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32, and with_ids also ids.

    A document is its ids and `end_id`. ids are binary, little-endian unsigned 32-bit numbers, and ids_crc32 is of these bytes.
    Windows hold `window` tokens; what is left at the end goes into sequences whose sizes are powers of two, so nothing is
    padded. Every window has its tokens in the proportions `weights` (sources without one follow at the end), or in those of
    the corpus, to within a quantum. A null text counts as empty and a null source as ''; null and repeated ids are packed
    row by row; an empty table gives no pieces; other columns are ignored.
    """
    table = written(tokenised(df, path, end_id, id_col, text_col, source_col), "tokens")
    blocks = written(table.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "counts")
    largest = blocks.groupBy("source").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "source").limit(OWN_QUEUES).select("source", F.lit(True).alias("own"))
    named = blocks.join(F.broadcast(largest), "source", "left")  # OWN_QUEUES rows
    pool = F.concat(F.lit("\0"), F.pmod(F.xxhash64("source"), F.lit(POOLS)).cast("string"))
    queued = named.select("source", "block", "n", F.when(F.col("own"), F.col("source")).otherwise(pool).alias("queue"))
    blocks = written(queued.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("block", "source")) - F.col("n")), "blocks")
    totals = {r.queue: int(r.n) for r in blocks.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # OWN_QUEUES + POOLS at most
    mixture = Mixture(totals, weights, window)
    base = blocks.select("source", "block", "queue", "base")
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    rows = table.join(base, ["source", "block"]).select("id", "source", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids", "queue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(path)
        for batch in batches:
            for part in slices(batch, 4, 2 * SLICE_BYTES):
                queue = part.column(5).dictionary_encode()
                names, code = queue.dictionary.to_pylist(), queue.indices.to_numpy(zero_copy_only=False)
                first, size = part.column(2).to_numpy(), part.column(3).to_numpy()
                order = np.lexsort([first, code])
                follows = np.append(False, (code[order][1:] == code[order][:-1]) & (first[order][1:] == (first + size)[order][:-1]))
                found = []
                for members in np.split(order, np.flatnonzero(~follows)[1:]):
                    document, *more = mixture.place(names[code[members[0]]], first[members], size[members])
                    found.append((members[document], *more))
                row, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
                ids = np.frombuffer(b"".join(part.column(4).to_pylist()), kind).astype("<u4")
                begin = (np.cumsum(size) - size)[row] + start
                raw = memoryview(ids).cast("B")
                crc = [crc32(raw[a:b]) for a, b in zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True)]
                at = pa.array(row)
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(start), pa.array(length), part.column(3).take(at), pa.array(sequence), pa.array(offset), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(binary_array(ids[spread(begin, length)], length * 4))
                yield pa.RecordBatch.from_arrays(columns, ["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
