"""Exact token counts at every prefix of a text, by dynamic programming.

For a piece w of the split pattern, the encoding of w[:i] is that of w[:j] and one more token w[j:i], where j is the only
start for which that token may follow the last token of w[:j]: two tokens may stand side by side if encoding their joined
bytes gives them back. So last[i] and count[i] = count[j] + 1 follow from shorter prefixes, for all pieces of a length at
once. A text's prefix counts are those of its pieces on top of what the pieces before them sum up to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalog.llm.shared import SLICE_BYTES, binary_array, slices, spread
from quantalog.llm.units import IntMap, UnitStore, byte_of_letter, piece_starts

BYTE_50K = "byte_bpe_50k.json"
#: Contractions of the pattern that fall into two pieces when cut after two characters.
CUT_CONTRACTIONS = {"'re", "'ve", "'ll"}
SPACES = regex.compile(r"\s{2,}")
LATE = np.iinfo(np.int64).max
#: Bytes of a unit or piece that is a row of a matrix; places of a longer piece that are looked at at once; pairs whose answers are kept.
LONGEST_ROW, PLACES, MOST_PAIRS = 256, 1 << 14, 1 << 18
#: Stands for a prefix that ends within a character.
WITHIN = -(1 << 15)


class PrefixCounter:
    """Token counts of prefixes under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of = byte_of_letter()
        raw = lambda word: bytes(of[c] for c in word)
        self.vocab = {raw(w): i for w, i in spec["model"]["vocab"].items() if all(c in of for c in w)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(pattern)
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        size = max(self.vocab.values()) + 1
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1 for single bytes
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = []
        for rank, (a, b) in enumerate(merges):
            token = self.vocab[a + b]
            pairs.append(self.vocab[a] << 32 | self.vocab[b])
            if self.born[token] < 0:
                self.born[token], self.left[token], self.right[token] = rank, self.vocab[a], self.vocab[b]
        self.pair_rank, self.rank_of = IntMap(pairs, range(len(pairs))), dict(zip(pairs, range(len(pairs)), strict=True))
        # A token that merges don't lead to never ends an encoding.
        reached = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        states, tokens, keys, targets = {b"": 0}, [-1], [], []
        for word in sorted(self.vocab):
            state = 0
            for n in range(1, len(word) + 1):
                prefix = word[:n]
                if prefix not in states:
                    states[prefix] = len(tokens)
                    tokens.append(self.vocab.get(prefix, -1) if prefix in reached else -1)
                    keys.append(state << 8 | word[n - 1]), targets.append(states[prefix])
                state = states[prefix]
        self.step = np.zeros((len(tokens), 256), np.int32)  # of the trie; 0: none
        self.step.ravel()[keys] = targets
        self.token_at = np.array(tokens, np.int32)
        self.longest = max(map(len, self.vocab))
        self.may_follow = IntMap()
        self.follows: dict[int, bool] = {}
        self.run_counts = lru_cache(maxsize=4096)(self._one)
        self.inside = lru_cache(maxsize=4096)(self._inside)
        self.store = UnitStore(self.count_units, np.int32)

    def separate(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether encoding the joined bytes of two tokens gives the two tokens back.

        Going back in time, the two sides are taken apart merge by merge, the later one first. No pair that ever stood at
        the border may have merged before one of its sides was used up by its own token.
        """
        a, b, good = first.copy(), second.copy(), np.ones(len(first), bool)
        gone_a, gone_b = np.full(len(a), LATE), np.full(len(a), LATE)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.pair_rank.get(x << 32 | y).astype(np.int64)
            clash = (rank >= 0) & (rank < gone_a[live]) & (rank <= gone_b[live])
            good[live[clash]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~clash & ((born_x >= 0) | (born_y >= 0))
            on_left = go & (born_x > born_y)
            on_right = go & ~on_left
            at = live[on_left]
            gone_a[at], a[at] = born_x[on_left], self.right[x[on_left]]
            at = live[on_right]
            gone_b[at], b[at] = born_y[on_right], self.left[y[on_right]]
            live = live[go]
        return good

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the second token may follow the first; answers are kept."""
        keys = first.astype(np.int64) << 32 | second.astype(np.int64)
        got = self.may_follow.get(keys)
        if (unknown := got < 0).any():
            if self.may_follow.n > MOST_PAIRS:
                self.may_follow, unknown = IntMap(), np.ones(len(keys), bool)
            new = np.unique(keys[unknown])
            answers = self.separate(new >> 32, new & 0xFFFFFFFF)
            self.may_follow.put(new, answers.astype(np.int32))
            got = self.may_follow.get(keys)
        return got == 1

    def count_rows(self, rows: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """rows: the bytes of texts of one length L; opens: where pieces begin. Counts at the prefixes of 1 to L bytes."""
        n, width = rows.shape
        count, last = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int64)
        piece = np.zeros(n, np.int64)  # where the piece that the walk is in begins
        state = np.zeros((n, width), np.int64)  # of the trie walk from each start; 0: no token goes on
        for end in range(1, width + 1):
            low = max(0, end - self.longest)
            opened = opens[:, end - 1]
            piece[opened] = end - 1
            state[opened, : end - 1] = 0
            at, start = np.nonzero(state[:, low : end - 1])
            start += low
            at, start = np.concatenate([at, np.arange(n)]), np.concatenate([start, np.full(n, end - 1)])
            moved = self.step[state[at, start], rows[at, end - 1]]
            state[at, start] = moved
            token = self.token_at[moved]
            here = token >= 0
            at, start, token = at[here], start[here], token[here].astype(np.int64)
            whole = start == piece[at]  # the piece so far is one token
            last[at[whole], end], count[at[whole], end] = token[whole], count[at[whole], start[whole]] + 1
            settled = np.zeros(n, bool)
            settled[at[whole]] = True
            rest = ~settled[at]
            at, start, token = at[rest], start[rest], token[rest]
            ok = self.compatible(last[at, start], token)
            at, start, token = at[ok], start[ok], token[ok]
            last[at, end], count[at, end] = token, count[at, start] + 1
        return count[:, 1:]

    def _follows(self, key: int) -> bool:
        """As `separate`, of one pair (first << 32 | second); answers are kept."""
        if len(self.follows) > MOST_PAIRS:
            self.follows.clear()
        a, b, gone_a, gone_b, good = key >> 32, key & 0xFFFFFFFF, LATE, LATE, True
        while True:
            rank = self.rank_of.get(a << 32 | b, -1)
            if 0 <= rank < gone_a and rank <= gone_b:
                good = False
                break
            born_a, born_b = int(self.born[a]), int(self.born[b])
            if born_a < 0 and born_b < 0:
                break
            if born_a > born_b:
                gone_a, a = born_a, int(self.right[a])
            else:
                gone_b, b = born_b, int(self.left[b])
        self.follows[key] = good
        return good

    def count_long(self, data: bytes) -> np.ndarray:
        """The counts at the prefixes of one long piece. The tokens at every place come from the trie, for many places at once."""
        n, raw, follows = len(data), np.frombuffer(data, np.uint8), self.follows
        count, last = [0] * (n + 1), [0] * (n + 1)
        for low in range(0, n, PLACES):
            start = np.arange(low, min(low + PLACES, n))
            state, starts, ends, tokens = np.zeros(len(start), np.int64), [], [], []
            for depth in range(1, self.longest + 1):
                inside = start + depth <= n
                start, state = start[inside], self.step[state[inside], raw[start[inside] + depth - 1]].astype(np.int64)
                start, state = start[state > 0], state[state > 0]
                if not len(start):
                    break
                token = self.token_at[state]
                real = token >= 0
                starts.append(start[real]), ends.append(start[real] + depth), tokens.append(token[real])
            order = np.argsort(np.concatenate(starts), kind="stable")
            for at, end, token in zip(*(np.concatenate(x)[order].tolist() for x in (starts, ends, tokens)), strict=True):
                if count[end]:
                    continue
                if at:
                    key = last[at] << 32 | token
                    ok = follows.get(key)
                    if not (self._follows(key) if ok is None else ok):
                        continue
                last[end], count[end] = token, count[at] + 1
        return np.array(count[1:], np.int32)

    def _one(self, piece: str) -> np.ndarray:
        return self.count_long(piece.encode())

    def count_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts at the prefixes of 1, 2, ... bytes of all texts one after the other, and how many bytes each has.

        Plain short texts are rows of matrices. Long ones, and those in which a prefix may split otherwise than the whole, go piece by piece.
        """
        data = [t.encode() for t in texts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        starts, flat = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.int32)
        odd = [i for i, t in enumerate(texts) if lengths[i] > LONGEST_ROW or "'" in t or SPACES.search(t) or self.special_pattern and self.special_pattern.search(t)]
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        whole = np.flatnonzero(plain)
        which, offsets = piece_starts([texts[i] for i in whole.tolist()], [data[i] for i in whole.tolist()], self.pattern.findall)
        for members, counts in self._matrices([data[i] for i in whole.tolist()], which, offsets):
            flat[starts[whole[members]][:, None] + np.arange(counts.shape[1])] = counts
        pieces = {i: self._split(texts[i]) for i in odd}
        distinct = [p for p in dict.fromkeys(p for found in pieces.values() for p in found) if p not in self.special]
        table, coded = {}, [p.encode() for p in distinct]
        short = [i for i, p in enumerate(coded) if len(p) <= LONGEST_ROW]
        none = np.zeros(0, np.int64)
        for members, counts in self._matrices([coded[i] for i in short], none, none):
            table.update(zip([distinct[short[m]] for m in members.tolist()], counts, strict=True))
        table.update((distinct[i], self.count_long(p)) for i, p in enumerate(coded) if len(p) > LONGEST_ROW)
        for i in odd:
            flat[starts[i] : starts[i] + lengths[i]] = self._by_pieces(texts[i], pieces[i], table, int(lengths[i]))
        return flat, lengths

    def _matrices(self, data: list[bytes], which: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, a row of counts each) of the texts of one length after the other; pieces open at the offsets of the texts `which`."""
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        row_of, order = np.zeros(len(data), np.int64), np.argsort(lengths, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            width = int(lengths[members[0]]) if len(members) else 0
            row_of[members] = np.arange(len(members))
            here = np.flatnonzero(lengths[which] == width) if len(which) else which
            row, column = row_of[which[here]], offsets[here]
            for first in range(0, len(members) * (width > 0), step := max(1, (1 << 17) // max(width, 1))):
                part = members[first : first + step]
                rows = np.frombuffer(b"".join([data[i] for i in part.tolist()]), np.uint8).reshape(len(part), width)
                opens = np.zeros(rows.shape, bool)
                mine = (row >= first) & (row < first + step)
                opens[row[mine] - first, column[mine]] = True
                yield part, self.count_rows(rows, opens)

    def _split(self, text: str) -> list[str]:
        """The pieces; a special string is one."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.pattern.findall(text)
        pieces, at = [], 0
        for match in self.special_pattern.finditer(text):
            pieces += [*self.pattern.findall(text[at : match.start()]), match.group()]
            at = match.end()
        return pieces + self.pattern.findall(text[at:])

    def _by_pieces(self, text: str, pieces: list[str], table: dict[str, np.ndarray], size: int) -> np.ndarray:
        """The counts of a text from those of its pieces, set right where a prefix splits otherwise: within contractions, special strings, white space."""
        out, at, base = np.empty(size, np.int32), 0, 0
        tail: list[tuple[str, int]] = []  # the last two pieces since a special string, and the count before each
        for piece in pieces:
            if piece in self.special:  # cut inside, it is text like any other and may join the piece before it
                n = len(piece.encode())
                out[at : at + n] = (tail[0][1] if tail else base) + self.inside("".join(p for p, _ in tail), piece)
                base += 1
                out[at + n - 1] = base
                tail.clear()
            else:
                counts = table[piece]
                n = len(counts)
                out[at : at + n] = base + counts
                if piece in CUT_CONTRACTIONS:
                    out[at + 1] = base + 2
                tail = [*tail[-1:], (piece, base)]
                base += int(counts[-1])
            at += n
        offset, place = 0, 0
        for run in SPACES.finditer(text):  # cut inside or right after it, white space so far is one piece
            start = offset + len(text[place : run.start()].encode())
            counts = self.run_counts(run.group())
            out[start : start + len(counts)] = (int(out[start - 1]) if start else 0) + counts
            offset, place = start + len(counts), run.end()
        return out

    def _inside(self, tail: str, special: str) -> np.ndarray:
        """Tokens of the tail and each prefix of a special string, as text."""
        out = np.zeros(len(special.encode()), np.int32)
        for n in range(1, len(special)):
            out[len(special[:n].encode()) - 1] = sum(int(self._one(p)[-1]) for p in self.pattern.findall(tail + special[:n]))
        return out

    def prefix_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts at every byte prefix of all texts one after the other, and the texts' lengths in bytes."""
        every, number = self.store.index(texts)
        store = self.store
        lengths = store.lengths[every]
        totals = np.where(lengths > 0, store.flat[np.maximum(store.starts[every] + lengths - 1, 0)], 0).astype(np.int64)
        before = np.cumsum(totals) - totals
        firsts = np.cumsum(number) - number
        before -= np.repeat(before[firsts], number)  # each text starts at 0
        counts = store.flat[spread(store.starts[every], lengths)] + np.repeat(before, lengths).astype(np.int32)
        sizes = np.add.reduceat(lengths, firsts) if len(firsts) else np.zeros(0, np.int64)
        return counts, sizes


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One for each worker process and vocabulary file."""
    return PrefixCounter(path)


def prefix_token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The prefix table: for each row id, n_bytes long, n_tokens long, prefix_steps binary.

    prefix_steps has a little-endian 16-bit number for each byte i, by which the tokens of the first i + 1 bytes are more than
    those of the longest shorter prefix of whole characters; -32768 where i + 1 bytes end within a character. (Rows in which a
    step needs more than 16 bits have 32-bit numbers, and so twice the length.) Their sums are the exact counts at every prefix;
    `budget_answers` reads them. A null text counts as empty: no bytes, no tokens. Null and repeated ids pass through; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            for part in slices(batch, 1, 2 * SLICE_BYTES):
                texts = part.column(1).to_pylist()
                counts, sizes = of.prefix_counts(texts)
                stops = np.cumsum(sizes)
                tokens = np.where(sizes > 0, counts[stops - 1] if len(counts) else 0, 0).astype(np.int64)
                data = np.frombuffer("".join(texts).encode(), np.uint8)
                whole = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
                steps = np.full(len(data), WITHIN, np.int32)
                at = np.flatnonzero(whole)
                text = np.searchsorted(stops, at, "right")
                before = np.append(0, counts[at[:-1]]) if len(at) else np.zeros(0, np.int32)
                before[np.append(True, text[1:] != text[:-1])[: len(at)]] = 0  # each text starts at 0
                steps[at] = counts[at] - before
                wide = np.unique(text[np.abs(steps[at]) >= -WITHIN]).tolist()
                small = steps.astype("<i2")
                if wide:
                    packed = [(steps if i in wide else small)[b - n : b].tobytes() for i, (b, n) in enumerate(zip(stops.tolist(), sizes.tolist(), strict=True))]
                    column = pa.array(packed, pa.binary())
                else:
                    column = binary_array(small, sizes * 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(tokens), column], ["id", "n_bytes", "n_tokens", "prefix_steps"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, prefix_steps binary").withColumnRenamed("id", id_col)


def prefix_counts_of(steps: bytes, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every prefix of whole characters, from a row of the prefix table."""
    values = np.frombuffer(steps, "<i2" if len(steps) == 2 * n_bytes else "<i4").astype(np.int64)
    whole = np.flatnonzero(values != WITHIN)
    return whole + 1, np.cumsum(values[whole])


def budget_answers(table: DataFrame, budgets: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """From a prefix table, without the texts: id, n_bytes long, n_tokens long, cut_bytes array<long>.

    cut_bytes has for each budget the bytes of the longest prefix of whole characters with at most so many tokens.
    """
    limits = [int(b) for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.zeros((batch.num_rows, len(limits)), np.int64)
            tokens = np.zeros(batch.num_rows, np.int64)
            for i, (size, steps) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                ends, counts = prefix_counts_of(steps.as_buffer(), size)
                tokens[i] = counts[-1] if len(counts) else 0
                for k, limit in enumerate(limits):
                    fits = np.flatnonzero(counts <= limit)
                    cuts[i, k] = ends[fits[-1]] if len(fits) else 0
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(limits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.ListArray.from_arrays(offsets, pa.array(cuts.ravel()))], ["id", "n_bytes", "n_tokens", "cut_bytes"])

    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("id"), "n_bytes", "prefix_steps")
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, cut_bytes array<long>").withColumnRenamed("id", id_col)
