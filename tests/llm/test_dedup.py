import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quantalog.llm import exact_dedup, simhash, simhash_wide, sketch, substring_dedup, suffix_dedup
from tests.llm.helpers import LOWER, TEXTS, documents, prose, words


@pytest.mark.parametrize(("keep", "digest"), [("largest", 32), ("smallest", 32), ("largest", 1)])
def test_exact(spark, keep, digest):
    rows = exact_dedup.exact_duplicates(documents(spark), keep=keep, digest_bytes=digest).collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(LOWER)].append(i)
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        expected += [(i, stays, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    plain = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(plain((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == sorted(map(plain, expected))
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_index_merges_runs(spark):
    index, runs = exact_dedup.MergeIndex(spark, keep="smallest"), []
    for texts in ([(5, "a"), (6, "b")], [(2, "a"), (7, "c")], [(9, "a")]):
        runs.append(index.flush(documents(spark, texts).selectExpr("doc_id as id", "text")))
        index.compact()
    assert sorted((r.stays.id, r.n) for r in index.merged.collect()) == [(2, 3), (6, 1), (7, 1)]
    found = [(r.id, r.stays.id, r.n) for run in runs for r in index.lookup(run).collect()]
    assert sorted(found) == [(2, 2, 3), (5, 2, 3), (6, 6, 1), (7, 7, 1), (9, 2, 3)]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_filter_of_hits(spark, monkeypatch, bits):
    """The filter lets every hit through and hardly anything else; without room for one everything is looked up."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", bits)
    index = exact_dedup.MergeIndex(spark)
    rows = index.flush(spark.range(6000).selectExpr("id", "if(id < 2000, concat('t', id % 1000), concat('u', id)) as text"))
    index.compact()
    assert (index.filter() is None) == (bits == 8)
    probed = index.probed(rows).groupBy(F.expr("id < 2000").alias("hit"), "maybe").count().collect()
    n = {(r.hit, r.maybe): r["count"] for r in probed}
    assert n[True, True] == 2000 and (True, False) not in n
    assert n.get((False, True), 0) < 600 or bits == 8
    assert index.lookup(rows).groupBy("n").count().orderBy("n").collect() == [(1, 4000), (2, 2000)]


def plain_fingerprint(text, n):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, most):
    least = list(range(len(values)))
    for _ in values:
        for a in range(len(values)):
            for b in range(a):
                if (values[a] ^ values[b]).bit_count() <= most and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("most", [2, 4])
def test_simhash(spark, most):
    texts = [(i, t) for i, t in TEXTS if i is not None and i != 14]
    base = prose(30, 300).split()
    for k in range(12):
        edited = list(base)
        edited[k * 7] = f"edit{k}"
        texts.append((100 + k, " ".join(edited)))
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), most=most, segments=5 if most == 2 else 13).collect()}
    prints = [plain_fingerprint(t, 3) for _, t in texts]
    assert [rows[i].fp & (1 << 64) - 1 for i, _ in texts] == prints
    ids = sorted(range(len(texts)), key=lambda k: texts[k][0])
    least = components([prints[k] for k in ids], most)
    assert {texts[k][0]: rows[texts[k][0]].component_id for k in ids} == {texts[k][0]: texts[ids[least[j]]][0] for j, k in enumerate(ids)}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark)).count() == len(TEXTS)


@pytest.mark.parametrize("bucket", [1, 3, 10_000])
@pytest.mark.parametrize(("most", "segments"), [(1, 3), (2, 5), (2, 7), (3, 7), (4, 13)])
def test_links_of_crowded_runs(spark, most, segments, bucket):
    if most > 2 and bucket == 3:
        pytest.skip("two ways are enough")
    rng = np.random.default_rng(5)
    center = [int(x) for x in rng.integers(0, 1 << 63, 3)]
    values = sorted({c ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for c in center for n in (0, 1, 1, 2, 2, 3, 4) for _ in range(4)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most, segments, bucket).collect()
    number = {v: i for i, v in enumerate(signed)}
    least = list(range(len(values)))
    assert all((values[number[e.src]] ^ values[number[e.dst]]).bit_count() <= most for e in edges)
    for _ in values:
        for e in edges:
            a, b = number[e.src], number[e.dst]
            least[a] = least[b] = min(least[a], least[b])
    assert least == components(values, most)


def test_substring(spark):
    texts = [(i, t) for i, t in TEXTS]
    rows = substring_dedup.remove_repeats(documents(spark, texts), window=50, carry=("source", "text")).collect()
    first = {}
    for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    expected = []
    for i, t in texts:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            earlier = first.get(tuple(w[k : k + 50]))
            if earlier is not None and (i is None or earlier < i):
                gone.update(range(k, k + 50))
        expected.append((i or -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), t or ""))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept, r.text or "") for r in rows) == sorted(expected)
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


def plain_removal(texts, match, keep):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[k : k + match] for d in data for k in range(len(d) - match + 1))
    order = sorted(range(len(texts)), key=lambda j: (texts[j][0] is None, texts[j][0] or 0))
    first, out = set(), [None] * len(texts)
    for j in order:
        gone, d = np.zeros(len(data[j]), bool), data[j]
        for k in range(len(d) - match + 1):
            piece = d[k : k + match]
            if keep == "none":
                hit = seen[piece] > 1
            else:
                hit = piece in first
                first.add(piece)
            if hit:
                gone[k : k + match] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[j] = (texts[j][0] if texts[j][0] is not None else -1, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone]))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [1 << 22, 2000])
def test_suffix(spark, keep, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    texts = [x for x in TEXTS if keep == "none" or x[0] is not None and x[0] != 14]
    rows = suffix_dedup.remove_repeats(documents(spark, texts), match=400, keep=keep).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    assert got == plain_removal(texts, 400, keep)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(len(data) - 63)
    text = data.tobytes()
    array = suffix_dedup.SuffixArray(data, starts, 64)
    assert [text[i : i + 64] for i in array.order] == sorted(text[i : i + 64] for i in starts)

    def common(i, j):
        return next((n for n in range(64) if text[i + n] != text[j + n]), 64) // 8 * 8

    assert array.longest_previous().tolist() == [max((common(i, j) for j in range(i)), default=0) for i in starts]
    assert array.longest_previous(later=True).tolist() == [max((common(i, j) for j in range(i + 1, len(starts))), default=0) for i in starts]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_factors_of_any_contexts(keep):
    rng = random.Random(5)
    for n in range(60):
        texts = [bytes(rng.choice(b"ab" if n % 2 else b"abcdefgh") for _ in range(rng.randint(16, 90))) * rng.randint(1, 2) for _ in range(rng.randint(1, 6))]
        texts += [texts[0][: rng.randint(16, len(texts[0]))]]
        copies = np.array([rng.randint(1, 2) for _ in texts])
        hit, counts = suffix_dedup._factors(texts, copies, 16, keep)
        strings = [t[i : i + 16] for t in texts for i in range(len(t) - 15)]
        again = [strings.count(x) > 1 or c > 1 for x, c in zip(strings, np.repeat(copies, counts), strict=True)]
        assert hit.tolist() == (again if keep == "none" else [x in strings[:i] for i, x in enumerate(strings)])


def test_only_repeated_strings_are_sorted(monkeypatch):
    sorted_bytes = []

    class Told(suffix_dedup.SuffixArray):
        def __init__(self, data, starts, size):
            sorted_bytes.append(len(data))
            super().__init__(data, starts, size)

    monkeypatch.setattr(suffix_dedup, "SuffixArray", Told)
    rng = random.Random(6)
    texts = [bytes(rng.randrange(256) for _ in range(700)) for _ in range(20)]
    hit, _ = suffix_dedup._factors([*texts, texts[3][100:505]], np.ones(21, int), 400, "none")
    assert hit.sum() == 12 and sum(sorted_bytes) == 2 * 405


def test_rolling_and_anchors():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 5, 400).astype(np.uint64)
    hashes = sketch.rolling(codes, 7)
    for i in range(0, 390, 13):
        assert all((hashes[i] == hashes[j]) == (codes[i : i + 7] == codes[j : j + 7]).all() for j in range(394))
    assert sketch.least_of(hashes, 13).tolist() == [hashes[i : i + 13].min() for i in range(len(hashes) - 12)]
    place = suffix_dedup.first_least(hashes, 13)
    assert place.tolist() == [i + int(hashes[i : i + 13].argmin()) for i in range(len(hashes) - 12)]


def test_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 300, 4000)
    counts = Counter(values.tolist())
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    bitmaps = sketch.merged_sketch(df, lambda b: iter([sketch.mix(b.column(0).to_numpy().astype(np.uint64))]), 16, at_least=14)
    keys = np.array(sorted(counts), np.uint64)
    found = sketch.reaches(bitmaps, sketch.mix(keys), 16)
    assert all(found[k] for k, v in enumerate(keys.tolist()) if counts[v] >= 14)
    assert sum(found[k] for k, v in enumerate(keys.tolist()) if counts[v] < 14) < 5


def shingle_set(text, n=5):
    w = words((text or "").translate(LOWER))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


@pytest.mark.parametrize("bucket", [2, 64])
def test_similar_documents(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash_wide, "BUCKET", bucket)
    texts = [(i, t) for i, t in TEXTS if i is not None and i != 14]
    for g, edits in enumerate((1, 4, 9, 40)):  # the similarity to the first falls from 0.98 to none
        base = prose(60 + g, 400).split()
        for k in range(12):
            edited = list(base)
            for e in range(edits if k else 0):
                edited[(k * 31 + e * 43) % 400] = f"edit{k}x{e}"
            texts.append((100 + 20 * g + k, " ".join(edited)))
    rows = {r.doc_id: r.component_id for r in simhash_wide.similar_documents(documents(spark, texts)).collect()}
    sets = [shingle_set(t) for _, t in texts]
    least = {i: i for i, _ in texts}
    for _ in range(3):
        for a, (i, _) in enumerate(texts):
            for b, (j, _) in enumerate(texts[:a]):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[i] = least[j] = min(least[i], least[j])
    assert {i: (c, least[i]) for i, c in rows.items() if c != least[i]} == {}
    assert simhash_wide.similar_documents(documents(spark, [])).count() == 0
    assert simhash_wide.similar_documents(documents(spark)).count() == len(TEXTS)


def linked(spark, texts):
    return {r.doc_id: r.component_id for r in simhash_wide.similar_documents(documents(spark, texts)).collect()}


def test_similar_short_documents(spark):
    """Eight words and the same with one more share 4 of 5 shingles: just 0.8, and not one of the pairs may be missed."""
    texts = []
    for k in range(300):
        base = " ".join(f"{w}{k}x{i}" for i, w in enumerate(prose(300 + k, 8).split()))
        texts += [(2 * k, base), (2 * k + 1, f"{base} more{k}")]
    assert linked(spark, texts) == {i: i // 2 * 2 for i, _ in texts}


def test_similar_clusters_in_a_crowd(spark, monkeypatch):
    """Two clusters of close copies, and just one of each that reach 0.8 together: that link joins the clusters."""
    monkeypatch.setattr(simhash_wide, "BUCKET", 2)
    texts = []
    for g in range(12):
        base = prose(500 + g, 400).split()
        for k in range(24):
            edits = {5 + 40 * (k % 2) + 10 * e: f"side{g}x{k % 2}x{e}" for e in range(4)} | ({100 + 12 * k: f"own{g}x{k}"} if k > 1 else {})
            texts.append((100 * g + 23 - k, " ".join(edits.get(i, w) for i, w in enumerate(base))))
    sets = {i: shingle_set(t) for i, t in texts}
    reach = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert [(i, j) for i in range(0, 24, 2) for j in range(1, 24, 2) if reach(i, j)] == [(22, 23)]
    assert linked(spark, texts) == {i: i // 100 * 100 for i, _ in texts}


def test_similar_large_group(spark, monkeypatch):
    """Of a group of near copies the sets that are compared grow with its members, not with its pairs."""
    compared, confirmed = [], simhash_wide.Sets.confirmed
    monkeypatch.setattr(simhash_wide.Sets, "confirmed", lambda sets, pairs: compared.append(pairs.count()) or confirmed(sets, pairs))
    base, texts = prose(78, 300).split(), []
    for k in range(500):
        edited = list(base)
        for e in range(3):
            edited[(k * 31 + e * 97) % 300] = f"edit{k}x{e}"
        texts.append((k, " ".join(edited)))
    assert linked(spark, texts) == dict.fromkeys(range(500), 0)
    assert sum(compared) <= 5 * len(texts)


def plain_contexts(texts, match, gram):
    """Runs of strings by the place of each string's anchor, text by text."""
    out = []
    for n, text in enumerate(texts):
        data, before = np.frombuffer(text, np.uint8), None
        if len(data) >= match:
            grams = suffix_dedup.hashed(data, gram)
            for start, place in enumerate(suffix_dedup.first_least(grams, match - gram + 1).tolist()):
                if place != before:
                    out.append([n, start, 0, int(grams[place])])
                out[-1][2] += 1
                before = place
    return [tuple(x) for x in out]


def test_contexts_and_removal_equal_plain_versions():
    """Texts of few letters, repeated ones and empty ones; spans that meet at the end of a text stay apart."""
    rng = random.Random(4)
    for trial in range(60):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh") for _ in range(rng.choice([0, 7, 8, 9, 40]))) * rng.choice([1, 3]) for _ in range(rng.randrange(1, 7))]
        data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        text, start, count, anchor, first = suffix_dedup.contexts(data, lengths, 8, 3)
        assert list(zip(text.tolist(), start.tolist(), count.tolist(), anchor.tolist(), strict=True)) == plain_contexts(texts, 8, 3)
        assert first.tolist() == [s + int(lengths[:t].sum()) for t, s in zip(text.tolist(), start.tolist(), strict=True)]
        marks, expected = [], []
        for t in texts:
            last, own, gone = len(t) - 8, [], set()
            for _ in range(rng.choice([0, 1, 3]) if last >= 0 else 0):
                low = sorted(rng.randrange(0, last // 2 + 1) for _ in range(rng.randrange(3)))
                high = [rng.randrange(x, last // 2 + 1) + 1 for x in low]
                starts = [rng.randrange(0, last - last // 2 + 1) for _ in range(rng.randrange(1, 3))]
                own.append({"starts": starts, "low": low, "high": high})
                gone |= {i for s in starts for a, b in zip(low, high, strict=True) for i in range(s + a, s + b - 1 + 8)}
            marks.append(own or None)
            expected.append((len(t), len(gone), sum(i - 1 not in gone for i in gone), bytes(c for i, c in enumerate(t) if i not in gone)))
        kind = pa.list_(pa.struct([(n, pa.list_(pa.int32())) for n in ("starts", "low", "high")]))
        sizes, removed, spans, kept = suffix_dedup._without(data, lengths, pa.array([[]] + marks, kind).slice(1), 8)
        assert list(zip(sizes.tolist(), removed.tolist(), spans.tolist(), strict=True)) == [x[:3] for x in expected] and kept.tobytes() == b"".join(x[3] for x in expected)
