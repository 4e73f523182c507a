import base64
import hashlib
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantalog.llm import bpe, packing, token_counts
from tests.llm.helpers import TEXTS, documents

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    with open(MULTI, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_rows(spark, library):
    rows = token_counts.budget_answers(token_counts.prefix_token_counts(documents(spark), JSON), budgets=(4, 512)).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((t or "").encode()), len(ids_of(library, t))) for _, t in TEXTS)
    by_id = {r.doc_id: r for r in rows}
    for i, text in TEXTS:
        if i and text:
            for budget, cut in zip((4, 512), by_id[i].cut_bytes, strict=True):
                fits = [len(text[:n].encode()) for n in range(1, min(len(text), 700) + 1) if len(ids_of(library, text[:n])) <= budget]
                assert len(text) > 700 or cut == max(fits, default=0)
    assert token_counts.budget_answers(token_counts.prefix_token_counts(documents(spark, []), JSON), (1,)).count() == 0


def test_every_prefix(spark, library):
    texts = [t for _, t in TEXTS if t and len(t) < 400] + ["foo!<|endoftext|> 're'rest  \n 'll", "a \t b  c ", "\x1c \x1f \x85"]
    rows = token_counts.prefix_token_counts(documents(spark, list(enumerate(texts))), JSON).collect()
    for r in rows:
        text = texts[r.doc_id]
        ends, counts = token_counts.prefix_counts_of(r.prefix_steps, r.n_bytes)
        assert ends.tolist() == [len(text[:n].encode()) for n in range(1, len(text) + 1)]
        assert counts.tolist() == [len(ids_of(library, text[:n])) for n in range(1, len(text) + 1)], text


HOSTILE = {
    "no spaces": "日本語の文章。" * 50_000,
    "one piece": "ab" * 500_000,
    "dashes": "-=" * 100_000 + "-" * 300_000,
    "special strings": "x<|endoftext|>" * 10_000,
    "special strings and spaces": " \n <|endoftext|>  y" * 4_000,
    "blank lines": "".join(f"w{i}\n\n \n" for i in range(60_000)),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts(library, ranks, name):
    """Long texts of the kinds that fall apart badly: whole counts as the library gives them, prefixes too, in seconds."""
    text = HOSTILE[name]
    started = time.time()
    counts, _ = token_counts.counter(JSON).prefix_counts([text])
    assert time.time() - started < 60
    assert counts[-1] == len(ids_of(library, text))
    for n in (1, 7, 333, 2_000, 9_999):
        assert counts[len(text[:n].encode()) - 1] == len(ids_of(library, text[:n])), n
    short = text[:200_000]
    assert bpe.encoder(MULTI).encode([short])[0].tolist() == ranks.encode_ordinary(short)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tabcdeés'.,!9日😀<|>tll")), max_size=40))
def test_any_text(text):
    library = Tokenizer.from_file(JSON)
    counts, _ = token_counts.counter(JSON).prefix_counts([text])
    assert [int(counts[len(text[:n].encode()) - 1]) for n in range(1, len(text) + 1)] == [len(ids_of(library, text[:n])) for n in range(1, len(text) + 1)]
    coder = bpe.encoder(MULTI)
    ids, sizes = coder.encode([text])
    assert coder.decode(ids, sizes)[0].tobytes() == text.encode()
    assert packing.library(JSON).encode([text])[0].tolist() == ids_of(library, text)


@pytest.mark.parametrize("mark", ["\n", "\r", "\t"])
def test_space_before_a_break(library, ranks, mark):
    """A line break or tab after a space is no mark of a key: such texts keep it, whatever was met before."""
    texts = ["9 x", f"9 {mark}9", f"9 9 {mark}x  9", f"x {mark}x y"]
    counts, sizes = token_counts.PrefixCounter(JSON).prefix_counts(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    assert [int(counts[n - 1]) for n in sizes.cumsum()] == [len(ids_of(library, t)) for t in texts]
    coder = bpe.encoder(MULTI)
    ids, lengths = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in ranks.encode_ordinary(t)]
    assert coder.decode(ids, lengths)[0].tobytes() == "".join(texts).encode()


def test_byte_bpe(spark, ranks):
    rows = bpe.decode(bpe.encode(documents(spark), MULTI), MULTI).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in rows) == sorted((ranks.encode_ordinary(t or ""), (t or "").encode()) for _, t in TEXTS)
    assert bpe.encode(documents(spark, []), MULTI).count() == 0
    for text in ("ab" * 600, "qzxj" * 300, "ا" * 500):
        assert bpe.encoder(MULTI).encode([text])[0].tolist() == ranks.encode_ordinary(text)


def test_store_forgets_without_harm(ranks):
    coder = bpe.RankEncoder(MULTI)
    coder.store.limit = 5
    for _, text in TEXTS:
        assert coder.encode([text or "", "more words here"])[0].tolist() == ranks.encode_ordinary(text or "") + ranks.encode_ordinary("more words here")


@pytest.mark.parametrize("weights", [None, {"s1": 3.0, "s2": 1.0}])
def test_packing(spark, library, weights):
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS * 3)]
    rows = packing.pack(documents(spark, texts), JSON, window=256, weights=weights).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids_of(library, texts[r.doc_id][1]) + [0]
        assert np.frombuffer(r.ids, "<u4").tolist() == own[r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(r.ids), len(own))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, text in texts:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids_of(library, text)) + 1
    sizes = []
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and sum(s < 256 for s in sizes) < 9
    assert packing.pack(documents(spark, []), JSON).count() == 0


def round_robin(totals, quantum):
    """Plain deficit round-robin: (queue, token) in the order served."""
    left, size = list(totals.values()), sum(totals.values())
    turns = [-(-x // quantum) for x in left]
    rounds = 1 << max(4, (16 * max(1, size // quantum)).bit_length())
    deficit, had, order = [rounds] * len(left), [0] * len(left), []
    for _ in range(rounds):
        for j, most in enumerate(left):
            deficit[j] += 2 * turns[j]
            while deficit[j] > 2 * rounds and had[j] < most:
                n = min(quantum, most - had[j])
                order += [(j, had[j] + x) for x in range(n)]
                had[j] += n
                deficit[j] -= 2 * rounds
    return order


@pytest.mark.parametrize("seed", range(12))
def test_places_are_those_of_round_robin(seed):
    rng = np.random.default_rng(seed)
    totals = {f"s{i}": int(rng.integers(1, 2500)) for i in range(rng.integers(1, 5))}
    mixture, order, windows, want = packing.Mixture(totals, None, 64, 16), round_robin(totals, 16), defaultdict(list), {}
    assert len(order) == sum(totals.values())
    for g, token in enumerate(order):
        windows[int(mixture.sequence_of(np.array([g]))[0])].append(token)
    for w, tokens in windows.items():  # within a window queue by queue
        want.update({token: (w, offset) for offset, token in enumerate(sorted(tokens))})
    got = {}
    for j, name in enumerate(totals):
        first = np.unique(np.concatenate([[0], rng.integers(0, totals[name], 3)]))
        for document, start, length, sequence, offset in zip(*mixture.place(name, first, np.diff(np.append(first, totals[name]))), strict=True):
            got.update({(j, int(first[document] + start + x)): (int(sequence), int(offset + x)) for x in range(length)})
    assert got == want


def test_small_source_beside_a_huge_one():
    mixture = packing.Mixture({"large": 10**11, "small": 100_000}, None, 1024)
    tracemalloc.start()
    document, start, length, sequence, _ = mixture.place("small", np.array([0, 50_000]), np.array([50_000, 50_000]))
    assert tracemalloc.get_traced_memory()[1] < 1 << 24
    tracemalloc.stop()
    assert length.sum() == 100_000 and np.abs(np.diff(np.unique(sequence)) / (10**11 / 1024 / 1563) - 1).max() < 0.1


def test_many_sources_share_queues(spark, monkeypatch, library):
    monkeypatch.setattr(packing, "OWN_QUEUES", 3)
    df = documents(spark, [(i, "some words here") for i in range(300)]).withColumn("source", F.concat(F.lit("host"), F.col("doc_id")))
    rows = packing.pack(df, JSON, window=64).collect()
    assert sum(r.length for r in rows) == 300 * 4 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_mixture_keeps_proportions():
    mixture = packing.Mixture({"a": 70_000, "b": 20_000, "c": 9_990, "d": 10}, None, 1000, quantum=10)
    had = mixture.served(np.arange(0, 100_001, 1000))
    assert (np.diff(had, axis=0) >= 0).all() and (np.diff(had.sum(1)) == 1000).all()
    assert np.abs(had - np.arange(101)[:, None] * 1000 * np.array([0.7, 0.2, 0.0999, 0.0001])).max() <= 20


def test_ids_hash_in_query(spark, ranks):
    row = bpe.encode(documents(spark, [(1, "some text here")]), MULTI).select(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("h")).first()
    assert row.h == hashlib.sha256(",".join(map(str, ranks.encode_ordinary("some text here"))).encode()).hexdigest()
