"""Byte patterns and tables against plain searches."""

import random

import numpy as np

from quantalog.operators import byteseries


def test_patterns_equal_a_plain_search(spark):
    rng = random.Random(5)
    few = lambda n: bytes(rng.choice(b"ab\x00\xff") for _ in range(n))
    rows = [(n, few(rng.choice([0, 1, 5, 63, 64, 65, 300]))) for n in range(60)] + [(7, b"abab" * 20), (None, b"ab"), (70, None), (71, b"\xff" * 200)]
    patterns = [("x", b"ab"), ("x", b"ab"), ("y", b"aba"), ("y", b"\xff\xff"), ("z", few(9)), ("empty", b""), ("w", b"b\x00"), ("x", b"ba")]
    df = spark.createDataFrame(rows, "id long, content binary").repartition(3)
    for window, most in ((16, 10_000), (1 << 20, 3), (1, 10_000)):
        expected = []
        for i, data in rows:
            for name in {n for n, p in patterns}:
                at = sorted({k for n, p in patterns if n == name and p for k in range(len(data or b"")) if data.startswith(p, k)})
                expected += [(i is None, i or 0, name, k) for k in at[:most]]
        found = byteseries.find_all(df, patterns, most=most, window=window).collect()
        assert sorted((r.id is None, r.id or 0, r.pattern, r.offset) for r in found) == sorted(expected)
    assert byteseries.find_all(df, []).count() == byteseries.find_all(df.limit(0), patterns).count() == 0


def plain_values(q, root, bits, width):
    powers = [pow(root, int(format(i, f"0{bits}b")[::-1], 2), q) for i in range(1 << bits)]
    both = powers + [z * (1 << (8 * width)) % q for z in powers]
    return {x % (1 << (8 * width)) for v in both for x in (v, v - q if v > q // 2 else v)} - {0, 1}


def plain_tables(blob):
    out = []
    for scheme, q, root, bits, width in byteseries.TRANSFORMS:
        known = plain_values(q, root, bits, width)
        for align in range(width):
            values = [int.from_bytes(blob[k : k + width], "little") for k in range(align, len(blob) - width + 1, width)]
            spans = []
            for i in range(len(values) - 31):
                hits = [v for v in values[i : i + 32] if v in known]
                if len(hits) >= 24 and len(set(hits)) >= 16:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + 32
                    else:
                        spans.append([i, i + 32])
            for a, e in spans:
                own = [k for k in range(a, e) if values[k] in known]
                out.append((scheme, align + own[0] * width, (own[-1] + 1 - own[0]) * width, len(own)))
    return out


def test_tables_equal_a_plain_search(spark):
    tables = {(r.scheme, r.value) for r in byteseries.transform_tables(spark).collect()}
    assert tables == {(t[0], v) for t in byteseries.TRANSFORMS for v in plain_values(*t[1:])}
    rng = np.random.default_rng(3)
    kem, dsa = sorted(plain_values(*byteseries.TRANSFORMS[0][1:])), sorted(plain_values(*byteseries.TRANSFORMS[1][1:]))
    pack = lambda values, kind: np.array(values, kind).tobytes()
    some = list(rng.permutation(kem))
    gaps = [v if n % 5 else 0 for n, v in enumerate(some[:90])]
    blobs = [
        b"", b"\x01" * 31, pack(some, "<u2"), b"x" + pack(some[:40], "<u2") + b"\0" * 200 + pack(some[:33], "<u2"), pack(gaps, "<u2"), pack([some[0]] * 100, "<u2"), b"abc" + pack(rng.permutation(dsa)[:100], "<u4") + b"z", rng.bytes(3000),
        pack(some[:32], "<u2"), pack(some[:31], "<u2"), b"\0" * 59 + pack(some[:60], "<u2"), pack(some[:30], "<u2") + b"\0" * 40 + pack(some[:30], "<u2"),
    ]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(blobs)] + [(99, None)], "id long, content binary")
    expected = sorted((n, *hit) for n, b in enumerate(blobs) for hit in plain_tables(b))
    assert len({e[0] for e in expected}) >= 6
    for window in (64, 1 << 16):
        assert sorted(tuple(r) for r in byteseries.find_tables(df, window=window).collect()) == expected


def test_tables_travel_as_rows_of_windows(spark, monkeypatch):
    """Nothing is stored for each entry: a table of 256 entries is a row for each window that it lies in."""
    kept, plain = [], byteseries.written
    monkeypatch.setattr(byteseries, "written", lambda df, *a: kept.append(plain(df, *a)) or kept[-1])
    dsa = sorted(plain_values(*byteseries.TRANSFORMS[1][1:]))[:256]
    blob = b"\0" * 1000 + np.array(dsa, "<u4").tobytes() + b"\0" * 1000
    found = byteseries.find_tables(spark.createDataFrame([(1, blob)], "id long, content binary"), window=512).collect()
    assert [tuple(r) for r in found] == [(1, *hit) for hit in plain_tables(blob)]
    assert sum(df.count() for df in kept) <= 4
