import datetime as dt
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quantalog.functions import text
from quantalog.functions.curve import slopes, survival
from quantalog.functions.constants import ANCHOR_YEARS, ARRIVAL
from quantalog.operators import certify, checkpoints, components, drift, events, graph, images, intake, joins, numbering, rules, scoring, sensitivity
from quantalog.plans import activity, evidence, risk
from quantalog.sources import estate, exports, inputs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_curve(spark):
    assert [round(s, 8) for s in slopes(ANCHOR_YEARS, tuple(1 - p for p in ARRIVAL["median"]))] == pytest.approx([-0.0975, -0.0158961, -0.01510714, -0.04321839, -0.0208, 0], abs=1e-7)
    for reading, at7, at25 in (("optimistic", 0.754354, 0.181767), ("median", 0.639966, 0.089), ("pessimistic", 0.531792, 0.028578)):
        assert one(spark, F.round(survival(F.lit(7.0), reading), 6)) == at7
        assert one(spark, F.round(survival(F.lit(25.0), reading), 6)) == at25
        values = [r.x for r in spark.range(0, 600).select(survival(F.col("id") / 10, reading).alias("x")).collect()]
        assert all(a >= b for a, b in zip(values, values[1:], strict=False)) and values[0] == 1
    assert one(spark, survival(F.lit(None))) == 1


def test_more_exposure_never_lowers_the_category(spark):
    base = dict(quantum_vulnerable=True, logical_qubits=1409, ownership="self", x_i=2.0, deadline_year=2028)
    order = ["clear", "possible", "likely", "certain"]
    for field in ("x_c", "y"):
        grid = [{**base, "x_c": 1.0, "y": 0.5, "n": n, field: n / 2} for n in range(60)]
        got = scoring.with_margins(spark.createDataFrame(grid), 2026.5).orderBy("n").collect()
        places = [order.index(r.category) for r in got]
        assert places == sorted(places)


def test_noisy_or(spark):
    data = [
        ("same", "a", "built", 0.6, "vulnerable"), ("same", "b", "built", 0.5, "vulnerable"),
        ("two", "a", "built", 0.6, "vulnerable"), ("two", "b", "held", 0.5, "vulnerable"),
        ("cap", "a", "built", 0.99, "vulnerable"), ("cap", "b", "held", 0.99, "vulnerable"),
        ("against", "a", "built", 0.6, "vulnerable"), ("against", "b", "held", 0.5, "safe"),
    ]
    got = {r.asset_id: r for r in joins.corroborated(spark.createDataFrame(data, "asset_id string, source string, plane string, confidence double, claim string")).collect()}
    assert {k: r.confidence for k, r in got.items()} == {"same": 0.6, "two": 0.8, "cap": 0.99, "against": 0.6}
    assert {k: r.flagged for k, r in got.items()} == {"same": True, "two": False, "cap": False, "against": True}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert dict(rows(got, "node", "component")) == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_identity(spark):
    keys = [("a", "fp", "1"), ("b", "fp", "1"), ("b", "serial", "9"), ("c", "serial", "9"), ("d", "fp", "7"), ("e", "fp", None), ("f", "serial", "1")]
    got = joins.identity_components(spark.createDataFrame(keys, "id string, kind string, value string"))
    assert dict(rows(got, "id", "component")) == {"a": "a", "b": "a", "c": "a"}


def test_identity_of_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    orders = [tuple(r) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()]
    least, first = {i: i for i, _ in orders}, {}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, c in orders:
        for key in [*([("c", c // 3)] if c is not None else []), ("d", i // 40)]:
            x, y = sorted((root(first.setdefault(key, i)), root(i)))
            least[y] = x
    got = rows(evidence.identity_components(spark, sf), "id", "component")
    assert got == sorted((i, root(i)) for i in least)


@pytest.mark.parametrize(
    ("edges", "depth", "cycle"),
    [
        ([(1, 2), (2, 3)], {3: 1, 2: 2, 1: 3}, {}),
        ([(1, 2), (2, 1), (2, 3)], {3: 1, 1: 2}, {2: 1}),
        ([(1, 2), (1, 3), (2, 4), (3, 4)], {4: 1, 2: 2, 3: 2, 1: 3}, {}),
        ([(i, i + 1) for i in range(40)], {i: 41 - i for i in range(41)}, {}),
    ],
)
def test_migration_order(spark, edges, depth, cycle):
    e = spark.createDataFrame(edges, "source long, target long")
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    parts = graph.strong_components(nodes, e)
    assert dict(rows(parts, "node", "component")) == {n: cycle.get(n, n) for n in {x for p in edges for x in p}}
    assert dict(rows(graph.depths(parts, e), "component", "depth")) == depth


def plain_components(edges):
    """By the nodes that each node reaches."""
    nodes = {n for e in edges for n in e}
    ahead = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in ahead[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 7)],
        [(5, 6), (6, 7), (7, 5), (1, 5), (7, 9)],  # a ring with a way in and one out
        [(1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 2)],  # a ring in a ring
        [(9, 8), (8, 9), (8, 7), (7, 6), (6, 7), (6, 5), (5, 5), (5, 4), (4, 3)],  # rings along a path
        [(a, b) for a in range(6) for b in range(6) if a < b],
        [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, (i * 11 + 5) % 60) for i in range(20)],
        [(random.Random(n).randrange(45), random.Random(-n).randrange(45)) for n in range(1, 60)],
    ],
)
def test_strong_components(spark, edges):
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "source long, target long")
    assert dict(rows(graph.strongly_connected(df), "node", "component")) == plain_components(edges)


def test_long_chain_and_ring_in_few_rounds(spark):
    """A chain of 100,000 nodes and a ring of as many: both are made one node at once, so ten rounds are enough."""
    chain = spark.range(100_000).selectExpr("id as source", "id + 1 as target")
    ring = spark.range(100_000).selectExpr("1000000 + id as source", "1000000 + (id + 1) % 100000 as target")
    found = graph.strongly_connected(chain.unionByName(ring), max_rounds=10)
    got = found.groupBy((F.col("node") >= 1_000_000).alias("ring")).agg(F.count_distinct("component").alias("n"), F.count("*").alias("of")).collect()
    assert sorted(tuple(r) for r in got) == [(False, 100_001, 100_001), (True, 1, 100_000)]
    assert graph.strongly_connected(chain.limit(0)).count() == 0


def test_tiered_lookup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randint(0, 7)))
    names = [(i, word()) for i in range(120)] + [(200, None), (201, "unique name"), (202, "")]
    refs = [word() for _ in range(60)] + ["UNIQUE", "que", "a", "B", "xy", "", None, "unique name"]
    expected = {}
    for ref in {r for r in refs if r}:
        for tier, fits in ((1, lambda n: n == ref), (2, lambda n: n.lower() == ref.lower()), (3, lambda n: ref.lower() in n.lower())):
            if hits := [i for i, n in names if n is not None and fits(n)]:
                expected[ref] = (min(hits) if tier < 3 or len(hits) == 1 else None, tier)
                break
    got = intake.tiered_lookup(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(names, "id long, name string"))
    assert {r.ref: (r.id, r.tier) for r in got.collect()} == expected
    assert intake.tiered_lookup(got.select("ref").limit(0), spark.createDataFrame(names, "id long, name string")).count() == 0


def test_whiteouts(spark):
    entries = [
        (0, "a/x", 1), (0, "a/y", 1), (0, "b/z", 1), (0, "b/c/d", 1), (0, "top", 1),
        (1, "a/.wh.x", 0), (1, "a/x", 2),  # deleted below, added again here
        (1, "b/.wh..wh..opq", 0), (1, "b/new", 3),
        (2, ".wh.top", 0), (2, "a/.wh.y", 0), (2, ".wh.b2", 0),
    ]
    got = images.merged_view(spark.createDataFrame(entries, "layer int, path string, size int"))
    assert rows(got, "path", "layer", "size") == [("a/x", 1, 2), ("b/new", 1, 3)]


def test_drift_rules_fire_and_hold(spark):
    base = dict(plane="observed", source_type="tls", system="s", hosts=["h:443"], protocol="TLSv1.2", suite="TLS_AES", kex="curve25519-sha256", library="openssl", version=3, algorithm="RSA", key_size=2048, public_key=None, fingerprint=None, serial="1", issuer="i", state="Active", not_after=dt.date(2030, 1, 1), peer_ip="10.0.0.1", name="n")
    found = [
        {**base, "id": "ok"},
        {**base, "id": "d1", "protocol": "TLSv1.0", "serial": "2"},
        {**base, "id": "d2", "suite": "TLS_RC4", "serial": "3"},
        {**base, "id": "d3m", "plane": "built", "source_type": "source", "key_size": None, "serial": "4"},
        {**base, "id": "d3", "plane": "built", "source_type": "binary", "version": 1, "key_size": None, "serial": "5"},
        {**base, "id": "d4c", "plane": "built", "source_type": "source", "key_size": 3072, "library": "x", "system": "s4", "serial": "6"},
        {**base, "id": "d4", "system": "s4", "serial": "7"},
        {**base, "id": "d5k", "plane": "held", "state": "Disabled", "public_key": "ab" * 32, "serial": "8", "name": "old key"},
        {**base, "id": "d5", "public_key": "AB:" * 20, "serial": "9"},
        {**base, "id": "d6k", "plane": "held", "serial": "10", "not_after": dt.date(2020, 1, 1), "name": "cert"},
        {**base, "id": "d6", "serial": "10"},
        {**base, "id": "d7", "source_type": "ssh", "hosts": ["k:22"], "serial": "11"},
        {**base, "id": "d8", "peer_ip": "8.8.8.8", "serial": "12"},
    ]
    fields = "id string, plane string, source_type string, system string, project string, path string, hosts array<string>, protocol string, suite string, kex string, library string, version int, algorithm string, key_size int, public_key string, fingerprint string, serial string, issuer string, state string, not_after date, peer_ip string, name string"
    said = [("tls_policy", ["h:443"], ["TLSv1.2"], "HIGH", False, [], "internal"), ("ssh_policy", ["k:22"], [], None, False, ["mlkem768x25519-sha256"], "public")]
    declared = spark.createDataFrame(said, "kind string, hosts array<string>, protocols array<string>, ciphers string, weak_enabled boolean, kex array<string>, exposure string")
    names = [f.split()[0] for f in fields.split(", ")]
    got = drift.all_drift(spark.createDataFrame([tuple(f.get(n) for n in names) for f in found], fields), declared, "2026-01-01")
    assert rows(got, "rule", "asset_id") == [(f"D{n}", f"d{n}") for n in range(1, 9)]


def expired_pairs(found, live, as_of):
    """D6 by comparing all pairs."""
    keys = lambda r: {k for k in (r["fingerprint"] and "fp:" + r["fingerprint"], r["serial"] and r["issuer"] and f"si:{r['serial']}|{r['issuer']}") if k}
    out = {}
    for h in found:
        for o in live:
            if h["not_after"] < as_of and keys(h) & keys(o):
                key = (h["name"], str(h["not_after"]), o["hosts"][0])
                out[key] = min(out.get(key, "~"), o["id"])
    return out


@pytest.mark.parametrize("most", [0, 2, 32])
def test_expired_certificates_equal_all_pairs(spark, monkeypatch, most):
    """Names with few and with many keys, hosts by one kind of key or both, and what isn't known."""
    monkeypatch.setattr(drift, "MOST_KEYS", most)
    rng = random.Random(6)
    made = lambda n, plane: {"id": f"{plane}{n:03}", "plane": plane, "name": f"n{rng.randrange(9)}", "hosts": [rng.choice(["a", "b", "c", "d", "e", None])], "fingerprint": rng.choice([None, *[c * 64 for c in "12345"]]), "serial": rng.choice([None, "1", "2", "3"]), "issuer": rng.choice(["x", "y"]), "not_after": dt.date(2025 + rng.randrange(3), 1, 1)}
    held, live = [made(n, "held") for n in range(60)], [made(n, "observed") for n in range(40)]
    f = spark.createDataFrame([tuple(r.values()) for r in held + live], "id string, plane string, name string, hosts array<string>, fingerprint string, serial string, issuer string, not_after date")
    expected = expired_pairs(held, live, dt.date(2027, 1, 1))
    got = [((r.subject, r.declared, r.observed), r.asset_id) for r in drift.expired_certificate(f, "2027-01-01").collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert drift.expired_count(f, "2027-01-01").first().n == len(expected)


def retired_pairs(found, live):
    """D5 by comparing all pairs."""
    out = {}
    for g in found:
        for o in live:
            n = min(len(g["public_key"] or ""), len(o["public_key"] or ""))
            if g["state"] in drift.RETIRED_STATES and n >= 32 and g["public_key"][:n] == o["public_key"][:n]:
                key = (g["name"], g["state"], o["hosts"][0])
                out[key] = min(out.get(key, "~"), o["id"])
    return out


@pytest.mark.parametrize("most", [0, 2, 32])
def test_retired_keys_equal_all_pairs(spark, monkeypatch, most):
    """Names with few and with many keys, keys that begin alike, and what isn't known; the count is made without the records."""
    monkeypatch.setattr(drift, "MOST_KEYS", most)
    rng = random.Random(5)
    keys = [None, "a" * 31, *[c * 32 + end for c in "12" for end in ("", "ab", "abcd", "ff")]]
    made = lambda n, plane: {"id": f"{plane}{n:03}", "plane": plane, "name": rng.choice(["n1", "n2", "n3", None]), "state": rng.choice(["Active", "Disabled", "Compromised", None]), "hosts": [rng.choice(["a", "b", "c", None])], "public_key": rng.choice(keys)}
    held, live = [made(n, "held") for n in range(40)], [made(n, "observed") for n in range(30)]
    f = spark.createDataFrame([tuple(r.values()) for r in held + live], "id string, plane string, name string, state string, hosts array<string>, public_key string")
    expected = retired_pairs(held + live, live)
    got = [((r.subject, r.declared, r.observed), r.asset_id) for r in drift.retired_key(f).collect()]
    assert len(got) == len(expected) and dict(got) == expected
    assert drift.retired_count(f).first().n == len(expected)


def test_pairs_of_certificates_and_hosts_are_not_written(spark, monkeypatch):
    """A fingerprint and a retired key on 150 certificates and 150 hosts: 45,000 records, but no table of more than a row for each finding."""
    sizes, write = {}, drift.written

    def counted(df, name, *more, **options):
        table = write(df, name, *more, **options)
        sizes[name] = max(table.count(), sizes.get(name, 0))
        return table

    monkeypatch.setattr(drift, "written", counted)
    monkeypatch.setattr(drift, "HASHES_SENT", 40)
    made = lambda n, plane: (f"{plane}{n}", plane, f"{plane} {n}", "Disabled" if plane == "held" else "Active", [f"h{n}"], "ab" * 16, "1" * 64, f"{n}", "ca", dt.date(2020, 1, 1))
    f = spark.createDataFrame([made(n, plane) for n in range(150) for plane in ("held", "observed")], "id string, plane string, name string, state string, hosts array<string>, public_key string, fingerprint string, serial string, issuer string, not_after date")
    expired, retired = drift.expired_certificate(f, "2026-01-01"), drift.retired_key(f)
    assert expired.distinct().count() == expired.count() == retired.distinct().count() == retired.count() == 150 * 150
    assert drift.expired_count(f, "2026-01-01").first().n == drift.retired_count(f).first().n == 150 * 150
    assert max(sizes.values()) <= 2 * 300, sizes


def test_drift_leaves_no_findings_behind(spark):
    """Findings written for the rules are deleted before the records are read."""
    left = lambda: {p for p in Path(checkpoints.shared_folder(spark)).rglob("observed*")}
    before = left()
    records = activity.drift_records(spark, "/root/testdata/sf0.001")
    assert left() == before and records.count() > 0


def test_binaries_meet_manifests_by_distinct_paths(spark):
    """Rows of a path and version are one before they meet the manifests of all systems above it."""
    said = [(f"m{n}", "source", f"s{n}", "/srv", None, 3) for n in range(300)]
    built = [(f"b{n:04}", "binary", f"t{n}", None, "/srv/bin/x", 1) for n in range(2000)]
    f = spark.createDataFrame([(*r, "openssl") for r in said + built], "id string, source_type string, system string, project string, path string, version int, library string")
    out = drift.library_version(f)
    assert {(r.subject, r.asset_id) for r in out.collect()} == {(f"s{n}", "b0000") for n in range(300)} and out.count() == 300


def test_conformal_with_ties(spark):
    scores = [(1, 0, True, 0.5), (2, 0, True, 0.9), (3, 0, False, 0.5), (4, 0, False, 0.95), (5, 1, False, 0.3)]
    df = spark.createDataFrame(scores, "id long, stratum long, calibration boolean, score double")
    p = certify.conformal_p(df)
    assert rows(p, "id", F.round("p", 6)) == [(3, 1.0), (4, round(1 / 3, 6))]
    assert rows(certify.bh_selected(p, "stratum", 0.7), "id", "selected") == [(3, False), (4, True)]
    assert rows(certify.bh_selected(p, "stratum", 1.0), "id", "selected") == [(3, True), (4, True)]


def test_delta_and_overlap(spark):
    old = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.1), (3, None, 0.1)], "id long, v string, band double")
    new = spark.createDataFrame([(2, "b", 0.104), (3, "c", 0.2), (4, "d", 0.1)], "id long, v string, band double")
    got = joins.delta(old, new, ["v"], "band")
    assert sorted((r.id, r.kind, r.field or "") for r in got.collect()) == [(1, "removed", ""), (3, "changed", "band"), (3, "changed", "v"), (4, "added", "")]
    assert joins.overlap(old, new.where("id = 4")).first().warning


def test_ranking_of_snapshots_rounds_as_sql_does(spark, tmp_path):
    """Prices on a half of the last place, some of which lie below it in binary."""
    prices = [1e4 * n / 2 + 50.0 for n in range(1, 80)] + [float(n) for n in (32350, 32349, 32351)]
    orders = [(n, prices[n % len(prices)], "1-URGENT", "O") for n in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    expected = con.sql(f"SELECT id, kind, places FROM ({evidence.oracle_sql()['rank_diff']})").fetchall()
    assert sorted((r.id, r.kind, 10**6 if r.places is None else r.places) for r in evidence.rank_diff(spark, str(tmp_path)).collect()) == sorted((i, k, 10**6 if p is None else p) for i, k, p in expected)


def test_chain(spark):
    import hashlib

    entries, previous = [], ""
    for i in range(20):
        h = hashlib.sha256(f"c{i}{previous}".encode()).hexdigest()
        entries.append((i, f"c{i}", previous, h))
        previous = h
    check = lambda e: tuple(events.verify_chain(spark.createDataFrame(e, "idx long, content string, prev_hash string, entry_hash string")).first())
    assert check(entries) == (20, None)
    assert check(entries[:7] + [(7, "edited", *entries[7][2:])] + entries[8:]) == (20, 7)
    assert check(entries[:7] + entries[8:]) == (19, 8)


def test_admission(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = [(i, rng.randrange(3), start + dt.timedelta(seconds=rng.randrange(400))) for i in range(300)]
    got = dict(rows(events.admitted(spark.createDataFrame(data, "id long, k long, ts timestamp"), "k", "ts", "id", 4, 60.0), "id", "admitted"))
    kept, expected = {}, {}
    for i, k, t in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        mine = kept[k] = [x for x in kept.get(k, []) if (t - x).total_seconds() <= 60]
        expected[i] = len(mine) < 4
        if expected[i]:
            mine.append(t)
    assert got == expected


def test_text(spark):
    assert one(spark, text.serial(F.lit("01:AB:0c"))) == "1ab0c"
    assert one(spark, text.serial(F.lit("255"))) == "ff"
    for number in (10**18, 2**64, 121878203918273918273918273, 7 * 10**45 + 11, 2**160 - 1):
        assert one(spark, text.serial(F.lit(f"00{number}"))) == f"{number:x}"
    assert one(spark, text.serial(F.lit("0"))) == "0" and one(spark, text.serial(F.lit(""))) is None
    assert one(spark, text.distinguished_name(F.lit("O=Acme, Inc , CN = Root"))) == one(spark, text.distinguished_name(F.lit("CN = Root,O=acme, inc")))
    assert one(spark, text.endpoint(F.lit("https://Host:8443/path"))) == "host:8443"
    assert one(spark, text.version_parts(F.lit("v1.10.2"))) == [1, 10, 2]
    assert one(spark, text.algorithm_key(F.lit("sha256WithRSA"))) == "RSA"
    assert one(spark, text.days_left(text.instant(F.lit("2026-01-01T00:00:00Z")), text.instant(F.lit("2026-01-01T01:00:00+00:00")))) == -1
    assert one(spark, text.instant(F.lit("not a date"))) is None
    assert one(spark, F.round(text.entropy(F.array(F.lit(1), F.lit(1), F.lit(2))), 6)) == 1.5
    assert one(spark, drift.is_internal(F.lit("172.31.9.9"))) and not one(spark, drift.is_internal(F.lit("172.32.0.1"))) and one(spark, drift.is_internal(F.lit("host"))) is None
    six = {"::1": True, "[::1]": True, "fd12:3456::1": True, "fe80::a:b": True, "2001:db8::1": False, "::2": False, "1:2": None, "1::2::3": None, "10.0.0.300": None, "2001:db8:0:0:0:0:0:1": False, "0:0:0:0:0:0:0:1": True, "::": False}
    assert {a: one(spark, drift.is_internal(F.lit(a))) for a in six} == six


def test_intake(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (None, 3, 0.5), (2, 4, 1.5), (3, 5, None)], "id long, seq long, v double")
    assert [r.reason for r in intake.judged(df, ["v"]).orderBy("seq").collect()] == [None, "duplicate id", "missing id", "v out of range", "v not a number"]
    assert one(spark, intake.scrubbed(F.create_map(F.lit("a"), F.lit("1"), F.lit("CKA_PRIME_1"), F.lit("2")))) == {"a": "1"}
    assert one(spark, intake.scrubbed_json(F.lit('{"a":{"private_key_pem":"x","b":1},"q":2,"l":[{"d":1}]}'))) == '{"a":{"b":1},"l":[{"d":1}]}'
    assert one(spark, intake.scrubbed_json(F.lit("[1]"))) is None and one(spark, intake.scrubbed_json(F.lit(None).cast("string"))) is None
    assert one(spark, intake.leaks(F.lit('{"x":[{"d": 1}]}'))) and not one(spark, intake.leaks(F.lit('{"x":"secret"}')))
    assert one(spark, intake.stamped(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("2")))) == {"a": "1", "b": "2"}


def test_inputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Asset Name,hostname,algo,bits\nweb,h1,RSA,2048\n,h2,AES,big\n,,DES,56\n")
    good, bad = inputs.assets_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.name, r.source_location, r.key_size or 0) for r in good.collect()) == [("h2", "h2", 0), ("web", "h1", 2048)]
    assert sorted((r.field, r.value or "") for r in bad.collect()) == [("key_size", "big"), ("name", "")]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/big.bin").write_bytes(b"\x7fELF" + b"x" * 100)
    small, large = inputs.files(spark, str(tmp_path), 90, "*.*")
    assert small.count() == 1 and large.count() == 1
    assert one(spark, inputs.format_of(F.lit(b"\x7fELF\x01"))) == "elf"
    assert one(spark, inputs.enabled_protocols(F.lit("all -SSLv3 -TLSv1"))) == ["TLSv1.1", "TLSv1.2", "TLSv1.3"]
    conf = spark.createDataFrame([("c", "config setup\n  a=1\nconn one\n  ike=aes\n# no\nconn two\n  esp=x\n")], "path string, text string")
    assert [(r.line, r.section, r.text) for r in inputs.config_lines(conf).orderBy("line").collect()] == [(2, None, "a=1"), (4, "one", "ike=aes"), (7, "two", "esp=x")]
    lists = spark.createDataFrame([("p/requirements.txt", "cryptography==41.0\nrequests>=2\n# x"), ("g/go.mod", "require golang.org/x/crypto v0.17.0"), ("d/status", "Package: openssl\nVersion: 1:3.0.11-1~deb12u2\n\nPackage: zlib\nVersion: 1.2"), ("n/package.json", '{"dependencies":{"node-forge":"^1.3.1"}}')], "path string, text string")
    assert {(r.ecosystem, r.name, r.version, r.exact) for r in inputs.packages(lists).collect()} == {("pypi", "cryptography", "41.0", True), ("pypi", "requests", "2", False), ("go", "golang.org/x/crypto", "0.17.0", True), ("deb", "openssl", "3.0.11", True), ("deb", "zlib", "1.2", True), ("npm", "node-forge", "1.3.1", False)}
    bom = '{"bomFormat":"CycloneDX","serialNumber":"s","components":[{"type":"cryptographic-asset","bom-ref":"r","name":"RSA","cryptoProperties":{"assetType":"algorithm","algorithmProperties":{"primitive":"pke","parameterSetIdentifier":"2048"}},"properties":[{"name":"k","value":"v"}]}],"dependencies":[{"ref":"r","dependsOn":["q"]}]}'
    docs = spark.createDataFrame([(bom,), ("not json",), (None,)], "document string")
    assert [(r.ref, r.key_size, r.properties) for r in inputs.components(docs).collect()] == [("r", 2048, {"k": "v"})]
    assert rows(inputs.dependencies(docs), "source", "target") == [("r", "q")]
    assert [r.start for r in inputs.windows(spark.createDataFrame([(b"0123456789",)], "content binary"), "content", 4, 1).collect()] == [1, 4, 7]


def test_rules(spark):
    df = spark.createDataFrame([(1, "plain\nuse MD5 and RSA here\nrsa"), (2, None), (3, "")], "id long, text string")
    assert rows(rules.first_matches(df), "id", "line", "rule", "match") == [(1, 2, "md5", "MD5"), (1, 3, "rsa", "rsa")]
    calls = spark.createDataFrame([(1, "RSA")], "id long, family string")
    assert rows(rules.without_imports(calls, spark.createDataFrame([(1, "RSA"), (1, "AES"), (2, "RSA")], "id long, family string")), "id", "family") == [(1, "AES"), (1, "RSA"), (2, "RSA")]


def test_nearest(spark):
    truth = spark.createDataFrame([("f", "RSA", 10), ("f", "RSA", 20), ("g", "AES", 1)], "file string, name string, line int")
    found = spark.createDataFrame([("f", "RSA", 11), ("f", "RSA", 12), ("f", "RSA", 23), ("g", "AES", 1)], "file string, name string, line int")
    assert rows(joins.nearest_matches(truth, found, 2), "file", "line", "found_line") == [("f", 10, 11), ("g", 1, 1)]


def test_inversions(spark):
    rng = random.Random(2)
    data = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)]
    expected = sum((a - c) * (b - d) < 0 for i, (a, b) in enumerate(data) for c, d in data[:i])
    assert tuple(sensitivity.inversions(spark.createDataFrame(data, "a int, b int"), "a", "b").first()) == (expected, 150 * 149 // 2)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i) for i in range(50)], "id string, v int")
    assert exports.digest(df, ["id", "v"]).first().digest == exports.digest(df.orderBy(F.desc("v")).repartition(7), ["id", "v"]).first().digest
    for scan in ("s1", "s2", "s1"):
        exports.save_scan(df, str(tmp_path / "scans"), scan)
    assert [r.scan_id for r in exports.asset_history(spark, str(tmp_path / "scans"), "7", 5).collect()] == ["s2", "s1"]


def test_streams(spark, tmp_path):
    from quantalog.streaming import limits

    start = dt.datetime(2024, 1, 1)
    data = [(i, i % 2, start + dt.timedelta(seconds=5 * i), float(i)) for i in range(60)]
    schema = "id long, k long, ts timestamp, value double"
    for n in range(3):
        spark.createDataFrame(data[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.admit(stream, "k", "ts", "id", limit=3, window=60.0).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = dict(rows(events.admitted(spark.createDataFrame(data, schema), "k", "ts", "id", 3, 60.0), "id", "admitted"))
    assert dict(rows(spark.table("admitted"), "id", "admitted")) == batch
    query = limits.tumbling(stream, "ts", "k", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 60


def test_places_by_ranges_of_bounded_rows(spark, monkeypatch):
    """Ranges grow in number with the rows; a key that is a column is named and not carried twice."""
    monkeypatch.setattr(numbering, "RANGE_ROWS", 20)
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).alias("g"))
    out = numbering.placed(rows, [-F.col("g"), "id"])
    assert out.columns == ["id", "g", "place"]
    assert [(r.g, r.id) for r in out.orderBy("place").collect()] == sorted([(r.g, r.id) for r in rows.collect()], key=lambda x: (-x[0], x[1]))
    kept = out._jdf.queryExecution().analyzed().toString()
    assert "__k1" not in kept


def test_scoring_is_compiled(spark, sf_dir="/root/testdata/sf0.001"):
    """The JVM interprets methods of over 8,000 bytes; the generated ones of the ranking's scores stay below."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is final
    rows = risk.scored(spark, sf_dir).select("algorithm", *scoring.ORDER_COLUMNS)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan))) < 7_000


def test_large_star_is_not_gathered(spark, monkeypatch):
    gathered = []

    def told(df, rows, most, *keys):
        gathered.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return checkpoints.dealt(df, rows, most, *keys)

    monkeypatch.setattr(components, "HOT_EDGES", 20)
    monkeypatch.setattr(components, "TASK_EDGES", 50)
    monkeypatch.setattr(components, "dealt", told)
    star = [(i, 500 if i % 2 else 7) for i in range(1000, 1400)] + [(500, 600), (600, 7)] + [(i, i + 1) for i in range(2000, 2030)]
    found = components.connected_components(spark.createDataFrame(star, "src long, dst long"))
    expected = {**dict.fromkeys([7, 500, 600, *range(1000, 1400)], 7), **dict.fromkeys(range(2000, 2031), 2000)}
    assert dict(map(tuple, found.collect())) == expected and max(gathered) <= 20


def test_sweep_sorts_no_copies_of_the_rows(spark):
    rng = random.Random(8)
    rows = [(f"a{i:03}", rng.randint(0, 20) / 20, rng.randint(0, 20) / 20) for i in range(300)]
    found = sensitivity.weight_sweep(spark.createDataFrame(rows, "id string, h_score double, t_score double"), steps=4, k=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "WindowGroupLimit" not in plan
    expected = []
    for w in (0.0, 0.25, 0.5, 0.75, 1.0):
        best = sorted((-round(w * h + (1 - w) * t, 6), i) for i, h, t in rows)[:7]
        expected += [(w, i, -score, n + 1) for n, (score, i) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_dashboard_sorts_nothing(spark):
    found = risk.QUERIES["dashboard"][0](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Expand" not in plan
    assert found.count() == 1


def test_lines_meet_orders_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(estate, "LINES", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line, plan = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count(), estate.findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(re.search(rf"hashpartitioning\({key}#\d+L?, {-(-line // 300)}\), REPARTITION_BY_NUM", plan) for key in ("l_orderkey", "o_orderkey"))
