"""Source divergence, filter interactions and mixing against plain versions."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from itertools import permutations

import pytest

from quantalog.llm import filter_audit, mixing, shared, source_divergence
from tests.llm.helpers import LOWER, TEXTS, documents, prose, words


def test_word_count(spark):
    odd = [" ", "\t\n", " a", "a ", "a\x0b\x0c b", "a\x1cb\x85c d", "é 😀\r\n\r\nx", "a  \t b   c\td", " \x00 "]
    texts = [*TEXTS, *enumerate(odd, 100), (200, " ".join(["w"] * 300_000)), (201, "  " * 300_000), (202, "w" * 1_500_000)]
    rows = documents(spark, texts).select("doc_id", "text", shared.word_count("text").alias("n")).collect()
    assert len(rows) == len(texts) and all(r.n == len(words(r.text)) for r in rows)


# Mixing


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """sizes: source -> size. Shares out, stops sources at their limit and shares the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, stopped = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        rest = sum(w for s, w in weight.items() if s not in stopped)
        target = {s: Fraction(most * sizes[s]) if s in stopped else left * weight[s] / rest for s in names}
        if not (above := {s for s in names if target[s] > most * sizes[s]} - stopped):
            return target
        stopped |= above


def plain_mix(rows, seed="mix"):
    """rows: id, source, size."""
    groups, out = defaultdict(list), []
    for i, s, n in rows:
        groups[s].append((n, -1 if i is None else i))
    target = plain_targets({s: sum(n for n, _ in g) for s, g in groups.items()})
    for s, g in groups.items():
        size = sum(n for n, _ in g)
        step = target[s] / size if size else Fraction(0)
        at = Fraction(int(sha256((seed + ("" if s is None else f"/{s}")).encode()).hexdigest()[:8], 16), 1 << 32)
        for k, (n, i) in enumerate(sorted(g)):
            copies = (at + (k + 1) * step).__floor__() - (at + k * step).__floor__()
            out.append((i, s, n, size, float(target[s]), n * copies, copies))
    return out


def mixed(df):
    return [(-1 if r.doc_id is None else r.doc_id, r.source, r.size, r.source_size, r.target, r.taken, r.copies) for r in mixing.mix(df).collect()]


def test_mix(spark):
    df = documents(spark)
    found = mixed(df)
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in df.collect()]
    assert Counter(found) == Counter(plain_mix(rows))
    assert Counter(mixed(df.repartition(7))) == Counter(found), "a second run agrees"
    assert mixed(df.limit(0)) == []
    assert all(r[5:] == (0, 0) for r in mixed(documents(spark, [(1, None), (2, " "), (None, "")])))


def test_mix_comes_near_its_targets(spark):
    """Each source is off by one document's size at most; a source of a third of all rows and small ones included."""
    texts = [(f"s{i % 9 if i % 3 else 0}" if i % 50 else None, i, "w " * (i * 7919 % 400 if i % 90 else 9000)) for i in range(3000)]
    df = spark.createDataFrame(texts, "source string, doc_id long, text string").repartition(6)
    found = mixed(df)
    assert Counter(found) == Counter(plain_mix([(i, s, len(words(t))) for s, i, t in texts]))
    taken, target, largest = Counter(), {}, Counter()
    for _, s, n, _, t, k, copies in found:
        taken[s], target[s], largest[s] = taken[s] + k, t, max(largest[s], n)
        assert k == n * copies <= 2 * n
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r[2] for r in found))


def test_targets_stop_and_share_again(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 20, "d": 5000}, {"a": 1, "b": 1, "c": 1}, {"ä": 7, "z": 0, "Z": 900, None: 3}, {"x": 5}, {f"s{i}": 2**i for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert found == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})
    df = spark.createDataFrame([("a", 10), ("b", 20)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.source_targets(df, share=Fraction(5), most=2).collect()} == {"a": 20.0, "b": 40.0}, "all stop"


# Filter interactions


def plain_audit(docs, labels):
    """docs: id, text, lang; labels: id, quality, toxic."""
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        rows.append((lang or "", {f for f, x in fails.items() if x}, any(q == 1 and i is not None and i == j for j, q, _ in labels), any(x == 1 and i is not None and i == j for j, _, x in labels)))
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                all_ = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_) - len(gone), sum(r[1] == {f} for r in all_), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return out


AUDITED = [*TEXTS, (20, "A#B " * 120), (21, "SHOUTING all day " * 3), (22, prose(30, 150) + " 5%"), (23, "one"), (24, "ONE"), (3, "one"), (25, " ".join(f"w{i}" for i in range(40_000)))]
AUDITED += [(i, "copy of " + ("this" if i % 2 else "that")) for i in range(400, 100, -1)]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (14, None, 1), (None, 1, 1), (300, 1, 0), (110, 0, 1), (111, 1, 1), (9999, 1, 1)]


@pytest.mark.parametrize(("order", "batch", "buckets"), [("asc", 1, 200), ("desc", 1, 1), ("desc", 1 << 30, 200)])
def test_filters_in_all_orders(spark, tmp_path, monkeypatch, order, batch, buckets):
    """With a batch for each file, in both orders of the ids, so earlier counts are taken back; or all files in one batch."""
    monkeypatch.setattr(filter_audit, "LEAST_BUCKETS", buckets)
    docs = documents(spark, AUDITED).select("doc_id", "text", "lang", "kept", "id")
    for n in range(3):  # files in the order of their ids, one after the other
        low, high = ((0, 20), (20, 200), (200, 500))[n if order == "asc" else 2 - n]
        part = docs.where(f"coalesce(doc_id, 0) >= {low} and coalesce(doc_id, 0) < {high}").coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.interactions(spark, str(tmp_path / "documents.parquet"), labels, batch).collect()
    expected = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], LABELS)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in found} == expected
    assert len(found) == len(expected) == 2 * 120 * 5


def test_filters_of_nothing_and_of_one_file(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    documents(spark, []).coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    assert filter_audit.interactions(spark, str(tmp_path / "none.parquet"), labels).count() == 0
    documents(spark, [(1, "one"), (2, "one")]).coalesce(1).write.parquet(str(tmp_path / "some"))
    (file,) = (tmp_path / "some").glob("*.parquet")
    file.rename(tmp_path / "documents.parquet")
    found = filter_audit.counters(spark, str(tmp_path / "documents.parquet"), labels).collect()
    assert sorted((r.part, r["mask"], r.n) for r in found) == [("en", 1, 1), ("en", 17, 1)]


# Source divergence


def plain_divergence(docs, least, top):
    """docs: lang, source, text."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(lang or "", s or "", term.findall((t or "").translate(LOWER))) for lang, s, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, s, terms in own:
            count[s].update(t for t in terms if t in kept)
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o not in (s, None)]
            terms = [(-(p[s][t] - p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, -v, n) for n, (v, i) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 50), (3, 4), (1000, 50)])
def test_divergence(spark, least, top):
    texts = [*TEXTS, (31, "Zebra zebra ZEBRA ÄÖ äö x1y_z"), (32, "zebra\x00apple Äö 日本"), (33, "\U00010000 ￿ \U00010000"), (34, "apple " * 30_000), (35, "1 2 3"), (41, "a b"), (42, "b c")]
    df = documents(spark, texts)
    found = source_divergence.divergence(df, least, top).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found) == plain_divergence([(r.lang, r.source, r.text) for r in df.collect()], least, top)
    assert source_divergence.divergence(df.limit(0), least, top).count() == 0
