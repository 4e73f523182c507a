"""Queries on the inventory as it is shown and on what follows from it, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.operators import inventory, joins
from quantalog.plans.risk import ASSETS_SQL, scored
from quantalog.sources import estate, vault
from quantalog.sources.estate import AS_OF, CLASSES, FINDINGS_SQL, pick, pick_sql, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_STATUS = "CASE WHEN classically_broken THEN 'broken' WHEN quantum_vulnerable THEN 'vulnerable' WHEN verdict = 'grover' THEN 'weakened' WHEN verdict = 'unknown' THEN 'unresolved' ELSE 'safe' END"
_TARGET = "CASE need " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in K.TARGETS.items()) + " END"
_KEY = "id || '/' || CAST(partkey AS VARCHAR) || '/' || CAST(suppkey AS VARCHAR)"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("id", F.concat_ws("/", "id", F.col("partkey").cast("string"), F.col("suppkey").cast("string"))).dropDuplicates(["id"])


@query(f"WITH {ASSETS_SQL}, k AS (SELECT DISTINCT ON (id) * FROM (SELECT * REPLACE ({_KEY} AS id) FROM assets)) SELECT id, name, algorithm, system, {_STATUS} AS status, round(slack_months, 1) AS slack_months, round(qirs, 4) AS qirs, behind, {_TARGET} AS target, partkey % 9 = 0 AS drifts FROM k")
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of assets, with status word, recommendation and drift flag."""
    assets = _keyed(spark, sf_dir)
    target = F.coalesce(*[F.when(F.col("need") == k, v[0]) for k, v in K.TARGETS.items()])
    return inventory.rows(assets, assets.where("need is not null").select("id", target.alias("target")), assets.where("partkey % 9 = 0").select(F.col("id").alias("asset_id")))


# An endpoint in each notation, its host, and what the host itself says (an address: fact; a name: hint).
_ENDPOINTS = [
    ("https://10.2.3.4:443/x", "10.2.3.4", "internal", "is a private address"),
    ("8.8.8.8:443", "8.8.8.8", "internet", "is a public address"),
    ("https://DB.corp:8443/", "db.corp", None, "is an internal name"),
    ("www.example.org:22", "www.example.org", None, "is a name"),
    ("printer:631", "printer", None, "is an internal name"),
    ("https://[2001:4860:4860::8888]:443/x", "2001:4860:4860::8888", "internet", "is a public address"),
    ("2606:4700:4700::1111", "2606:4700:4700::1111", "internet", "is a public address"),
    ("tls://[fd12:3456::1]:993", "fd12:3456::1", "internal", "is a private address"),
    ("[::1]", "::1", "internal", "is a private address"),
    (None, None, None, None),
]
_ENDPOINTS_SQL = ", ".join("(" + ", ".join([str(i), *["NULL" if v is None else f"'{v}'" for v in row]]) + ")" for i, row in enumerate(_ENDPOINTS))


@query(f"""WITH n(k, endpoint, named, fact, says) AS (VALUES {_ENDPOINTS_SQL}),
e AS (SELECT s_suppkey AS id, n.*, s_suppkey % 7 = 0 AS seen, CASE s_suppkey % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'internal' END AS declared, 'declared ' || CASE s_suppkey % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'internal' END || ' in the register for sys' || CAST(s_suppkey AS VARCHAR) AS register FROM supplier JOIN n ON n.k = s_suppkey % 10)
SELECT id, CASE WHEN endpoint IS NULL THEN coalesce(declared, 'unknown') WHEN seen THEN 'internal' ELSE coalesce(fact, declared, CASE says WHEN 'is a name' THEN 'unknown' ELSE 'internal' END) END AS exposure,
  CASE WHEN endpoint IS NULL THEN coalesce(register, 'not a network endpoint') WHEN seen THEN '192.168.1.1 is a private address' WHEN fact IS NULL AND declared IS NOT NULL THEN register ELSE named || ' ' || says END AS basis FROM e""")
def exposure_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure with what it rests on."""
    s = F.col("s_suppkey")
    declared = F.when(s % 4 == 0, "internet").when(s % 4 == 1, "internal")
    found = inventory.exposure(pick([e[0] for e in _ENDPOINTS], s % 10), F.when(s % 7 == 0, "192.168.1.1"), declared, F.concat(F.lit("sys"), s.cast("string")))
    return table(spark, sf_dir, "supplier").select(s.alias("id"), found.alias("x")).select("id", "x.*")


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT DISTINCT {_KEY} AS id, CASE WHEN partkey % 6 = 0 THEN 'cn|p' || CAST(partkey AS VARCHAR) WHEN partkey % 6 = 3 THEN 'cn|o=p' || CAST(partkey AS VARCHAR) ELSE 'at|' || lower(host) || '|' || asset_class || '|' || CASE line % 3 WHEN 0 THEN lower(usage) WHEN 1 THEN 'suite' ELSE lower(algorithm) END END AS identity, confidence, provenance, source_type AS sensor, CASE WHEN line % 2 = 0 THEN owner END AS owner FROM findings)
SELECT identity, arg_max(id, struct_pack(c := confidence, i := id)) AS id, arg_max(owner, struct_pack(c := confidence, i := id)) FILTER (owner IS NOT NULL) AS owner, round(greatest(max(confidence), least({K.BONUS_CEILING}, max(confidence) + {K.BONUS} * (count(DISTINCT provenance) - 1))), 4) AS confidence, count(DISTINCT sensor) AS sensors, count(*) AS findings FROM f GROUP BY identity""")
def identity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about one object folded into the best-evidenced one, its gaps filled."""
    p = F.col("partkey")
    subject = F.when(p % 6 == 0, F.concat(F.lit("O=x, CN=P"), p.cast("string"))).when(p % 6 == 3, F.concat(F.lit("O=P"), p.cast("string")))
    what = F.when(F.col("line") % 3 == 2, F.col("algorithm")), F.when(F.col("line") % 3 == 0, F.col("usage")), F.lit("SUITE")
    rows = estate.findings(spark, sf_dir).select(
        F.concat_ws("/", "id", p.cast("string"), F.col("suppkey").cast("string")).alias("id"), inventory.identity(subject, F.col("host"), F.col("asset_class"), *what).alias("identity"),
        "confidence", "provenance", F.col("source_type").alias("sensor"), F.when(F.col("line") % 2 == 0, F.col("owner")).alias("owner"),
    )
    return inventory.folded(rows.distinct(), "identity", ["owner"])


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'own' END, s.name) AS system FROM orders LEFT JOIN (SELECT 'h' || CAST(s_suppkey AS VARCHAR) AS host, 'S' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 3, '0') AS name FROM supplier) s ON s.host = 'h' || CAST(o_custkey % 300 AS VARCHAR)""")
def attached_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without a system take that of their host."""
    k = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "own").alias("system"), F.concat(F.lit("H"), (F.col("o_custkey") % 300).cast("string")).alias("host"))
    s = F.col("s_suppkey")
    systems = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("S"), F.lpad((s % 20).cast("string"), 3, "0")).alias("name")).agg(F.collect_list(F.concat(F.lit("h"), s.cast("string"))).alias("hosts"))
    return inventory.with_system(found, systems).select("id", "system")


@query("""WITH m AS (SELECT p_partkey AS id, UNNEST(CASE WHEN p_partkey % 3 = 0 THEN [p_partkey, p_partkey + 1] ELSE [p_partkey] END) AS member FROM part), r AS (SELECT s_suppkey AS record_id, UNNEST([s_suppkey * 3, s_suppkey * 3 + 1]) AS member FROM supplier)
SELECT CAST(id AS VARCHAR) AS id, count(DISTINCT record_id) AS records FROM m JOIN r USING (member) GROUP BY id""")
def drift_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that drift records name, by themselves or by a merged member."""
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    assets = table(spark, sf_dir, "part").select(p.cast("string").alias("id"), F.when(p % 3 == 0, F.array((p + 1).cast("string"))).alias("merged_ids"))
    records = table(spark, sf_dir, "supplier").select(s.alias("record_id"), F.array((s * 3).cast("string"), (s * 3 + 1).cast("string")).alias("asset_ids"))
    return inventory.linked(assets, records)


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey % 3 <> 0 AS v FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS id, o_custkey % 4 <> 0 AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT coalesce(o.v, false) AS was, n.v AS now FROM o FULL JOIN n USING (id))
SELECT CAST(count_if(was AND now = false) AS BIGINT) AS migrated, CAST(count_if(was AND now IS NULL) AS BIGINT) AS removed_vulnerable, CAST(count_if(coalesce(now, false) AND NOT was) AS BIGINT) AS newly_vulnerable, CAST(count_if(was) AS BIGINT) AS before, round(100.0 * (count_if(was AND now = false) + count_if(was AND now IS NULL)) / count_if(was), 1) AS progress_pct FROM b""")
def migration_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was migrated, removed or has become vulnerable between two snapshots."""
    orders, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return inventory.progress(orders.where(k % 5 != 0).select(k.alias("id"), (c % 3 != 0).alias("vulnerable")), orders.where(k % 7 != 0).select(k.alias("id"), (c % 4 != 0).alias("vulnerable")))


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT need, CASE WHEN need IN {(*K.MIGRATION_NEEDS, 'replace_now')} THEN {_TARGET} END AS r0, qirs FROM assets WHERE quantum_vulnerable AND contains(host, 'h1') AND asset_class IN ('tls_certificate', 'tls_key_exchange', 'root_ca', 'ssh_key')),
t AS (SELECT need, CASE WHEN r0 = 'X25519MLKEM768' THEN 'ML-KEM-768' ELSE r0 END AS replacement, qirs AS before, CASE WHEN r0 IS NULL THEN qirs ELSE 0.0 END AS after FROM s)
SELECT coalesce(replacement, '(not simulated)') AS replacement, count(*) AS n, round(CAST(avg(CAST(before AS DECIMAL(38, 10))) AS DOUBLE), 6) AS before, round(CAST(avg(CAST(after AS DECIMAL(38, 10))) AS DOUBLE), 6) AS after FROM t GROUP BY 1""")
def hybrid_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores before and after a simulated migration of selected assets, by replacement."""
    rows = inventory.simulated(scored(spark, sf_dir), "h1", ["tls_certificate", "tls_key_exchange", "root_ca", "ssh_key"], pqc_only=True)
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(38,10)")).cast("double"), 6).alias(c)
    return rows.groupBy(F.coalesce("replacement", F.lit("(not simulated)")).alias("replacement")).agg(F.count("*").alias("n"), mean("before"), mean("after"))


@query(f"""WITH {ASSETS_SQL}, s AS (SELECT *, CASE WHEN need IN {(*K.MIGRATION_NEEDS, 'replace_now')} THEN {_TARGET} END AS r FROM assets WHERE quantum_vulnerable AND contains(host, 'h2')),
t AS (SELECT r, qirs, h_score, t_score, behind, CASE WHEN r IS NULL THEN qirs ELSE 0.0 END AS q2, CASE WHEN r IS NULL THEN h_score ELSE 0.0 END AS h2, CASE WHEN r IS NULL THEN t_score ELSE 0.0 END AS t2 FROM s),
m AS (SELECT count(*) AS selected, count(r) AS moved, CAST(count_if(r IS NULL) AS BIGINT) AS skipped, {", ".join(f"round(CAST(avg(CAST({c} AS DECIMAL(38, 10))) AS DOUBLE), 6) AS {n}" for c, n in (("qirs", "qirs_before"), ("q2", "qirs_after"), ("h_score", "h_before"), ("h2", "h_after"), ("t_score", "t_before"), ("t2", "t_after")))},
  max(qirs) AS most_before, CAST(max(q2) AS DOUBLE) AS most_after, CAST(count_if(r IS NULL) AS BIGINT) AS vulnerable_after, CAST(count_if(behind) AS BIGINT) AS behind_before, CAST(count_if(behind AND r IS NULL) AS BIGINT) AS behind_after FROM t)
SELECT *, CASE WHEN qirs_before > 0 THEN round((qirs_before - qirs_after) / qirs_before * 100, 1) ELSE 0.0 END AS reduction_pct FROM m""")
def migration_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a simulated migration of the hosts of one name does to scores, slack and exposure: they are classified and scored again."""
    return inventory.effect(inventory.simulated(scored(spark, sf_dir), "h2"))


@query(f"""WITH {ASSETS_SQL}, o AS (SELECT CAST(count_if(expiry_days < 0) AS BIGINT) AS a, CAST(count_if(expiry_days BETWEEN 0 AND 30) AS BIGINT) AS b, CAST(count_if(expiry_days BETWEEN 31 AND 90) AS BIGINT) AS c, CAST(count_if(slack_months < 0) AS BIGINT) AS d, min(slack_months) AS w FROM assets), n AS (SELECT count(*) AS blind FROM nation WHERE n_nationkey % 6 = 5)
SELECT 'expiry' AS kind, CASE WHEN a + b > 0 THEN 'critical' ELSE 'warning' END AS severity, a + b + c AS n, format('{{}} expired, {{}} critical, {{}} warning', a, b, c) AS body FROM o WHERE a + b + c > 0 UNION ALL SELECT 'negative-slack', 'critical', d, printf('worst slack %.1f months', w) FROM o WHERE d > 0 UNION ALL SELECT 'blind-spots', 'warning', blind, format('{{}} sensors never ran', blind) FROM n WHERE blind > 0""")
def estate_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that the estate gives rise to."""
    assets = scored(spark, sf_dir).withColumn("expiry_days", F.datediff("not_after", F.lit(AS_OF).cast("date")))
    return inventory.notifications(assets, table(spark, sf_dir, "nation").where("n_nationkey % 6 = 5"))


@query("""WITH r AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS sensor, c_custkey % 10 AS findings, c_custkey % 17 = 0 AS failed FROM customer WHERE c_nationkey % 6 <> 5)
SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS sensor, count(r.sensor) AS runs, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings, CAST(count_if(coalesce(failed, false)) AS BIGINT) AS failed, count(r.sensor) = 0 AS not_run FROM nation LEFT JOIN r ON r.sensor = 'n' || CAST(n_nationkey AS VARCHAR) GROUP BY n_nationkey""")
def sensor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered sensor with its runs; those that never ran are told."""
    named = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("sensor")
    runs = table(spark, sf_dir, "customer").where("c_nationkey % 6 <> 5").select(named("c_nationkey"), (F.col("c_custkey") % 10).alias("findings"), (F.col("c_custkey") % 17 == 0).alias("failed"))
    return inventory.coverage(table(spark, sf_dir, "nation").select(named("n_nationkey")), runs)


@query(f"""WITH e(asset_class, share) AS (VALUES {", ".join(f"('{c}', CAST({(i + 1) / 100} AS DOUBLE))" for i, c in enumerate(CLASSES[:10]))}), o AS (SELECT {pick_sql(CLASSES, "p_partkey % 19 + 4")} AS asset_class FROM part), h AS (SELECT asset_class, count(*) / (SELECT count(*) FROM o) AS have FROM o GROUP BY 1)
SELECT coalesce(e.asset_class, h.asset_class) AS asset_class, coalesce(share, 0) AS expected, round(coalesce(have, 0), 6) AS observed, round(coalesce(have, 0) - coalesce(share, 0), 6) AS off FROM e FULL JOIN h USING (asset_class)""")
def profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sector is expected to have beside what was found."""
    expected = spark.createDataFrame([(c, (i + 1) / 100) for i, c in enumerate(CLASSES[:10])], "asset_class string, share double")
    return inventory.fit(expected, table(spark, sf_dir, "part").select(pick(CLASSES, F.col("p_partkey") % 19 + 4).alias("asset_class")))


@query("""WITH c AS (SELECT event_type AS model, event_id AS moment, user_id % 7 <> 0 AS ok, value AS latency FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY moment DESC) AS n FROM c)
SELECT model, count(*) AS calls, round((1 + count_if(ok)) / (2 + count(*)), 6) AS reliability, round(median(latency) FILTER (n <= 20), 6) AS median_latency FROM r GROUP BY model""")
def model_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed success and median of the last twenty latencies for each model."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("at"), (F.col("user_id") % 7 != 0).alias("ok"), F.col("value").alias("latency"))
    return inventory.reliability(rows)


@query("SELECT p.p_partkey AS id, 'r' || CAST(s_suppkey AS VARCHAR) AS name FROM part p JOIN supplier s ON p.p_partkey >= s_suppkey * 13 AND p.p_partkey < s_suppkey * 13 + 20 + s_suppkey % 50")
def range_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in ranges, by equality on buckets."""
    s = F.col("s_suppkey")
    ranges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), s.cast("string")).alias("name"), (s * 13).alias("low"), (s * 13 + 20 + s % 50).alias("high"))
    return inventory.intervals(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("at")), ranges, 64)


@query("""WITH n AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS own FROM part) SELECT id, CAST(len(list_intersect(own, ['part', '7', 'steel', 'blue'])) AS INTEGER) AS shared FROM n WHERE len(list_intersect(own, ['part', '7', 'steel', 'blue'])) > 0""")
def reference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share parts with a reference."""
    return inventory.reference_candidates("Part 7, steel (blue)", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""WITH c AS (SELECT e.event_id, e.event_type, CASE event_type WHEN 'click' THEN 'intake' WHEN 'view' THEN 'scoring' ELSE 'other' END AS stage FROM events e) SELECT stage, count(*) AS events, count(DISTINCT event_type) AS operations, min(event_id) AS first, max(event_id) AS last FROM c GROUP BY stage""")
def trace_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's trace by stage."""
    stage = F.when(F.col("event_type") == "click", "intake").when(F.col("event_type") == "view", "scoring").otherwise("other")
    return table(spark, sf_dir, "events").groupBy(stage.alias("stage")).agg(F.count("*").alias("events"), F.countDistinct("event_type").alias("operations"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""WITH d AS (SELECT *, CAST(ts AS DATE) AS day FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS place FROM d) SELECT event_id, place, place <= 3 AS within_budget FROM n""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's calls of a day beyond its budget are refused; the next day starts anew."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")).cast("bigint")  # a key's calls of one day
    return rows.select("event_id", place.alias("place"), (place <= 3).alias("within_budget"))


@query(f"""WITH {ASSETS_SQL}, t AS (SELECT count(*) AS n, count_if(quantum_vulnerable) AS v, count_if(behind) AS b, count_if(gated) AS g, count_if(asset_class IN ('root_ca', 'issuing_ca', 'code_signing', 'payment_hsm', 'device_identity', 'firmware_signing')) AS hard, count_if(expiry_days < 90) AS soon FROM assets)
SELECT round(100.0 * v / n, 2) AS vulnerable_pct, round(100.0 * b / n, 2) AS behind_pct, round(100.0 * g / n, 2) AS gated_pct, round(100.0 * (n - hard) / n, 2) AS actionable_pct, round(100.0 * soon / n, 2) AS expiring_pct, CASE WHEN b > 0 THEN 'behind' WHEN v > 0 THEN 'exposed' ELSE 'ready' END AS verdict FROM t""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline figures and a verdict, in one pass."""
    hard = ("root_ca", "issuing_ca", "code_signing", "payment_hsm", "device_identity", "firmware_signing")
    days = F.datediff("not_after", F.lit(AS_OF).cast("date"))
    one = scored(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("quantum_vulnerable").alias("v"), F.count_if("behind").alias("b"), F.count_if("gated").alias("g"), F.count_if(F.col("asset_class").isin(*hard)).alias("hard"), F.count_if(days < 90).alias("soon"))
    share = lambda c, name: F.round(100.0 * c / F.col("n"), 2).alias(name)
    verdict = F.when(F.col("b") > 0, "behind").when(F.col("v") > 0, "exposed").otherwise("ready")
    return one.select(share(F.col("v"), "vulnerable_pct"), share(F.col("b"), "behind_pct"), share(F.col("g"), "gated_pct"), share(F.col("n") - F.col("hard"), "actionable_pct"), share(F.col("soon"), "expiring_pct"), verdict.alias("verdict"))


@query("""SELECT n_nationkey AS id, CAST(nullif(regexp_extract(b, 'OpenSSH_([0-9]+)[.]([0-9]+)', 1), '') AS INTEGER) AS major, CAST(nullif(regexp_extract(b, 'OpenSSH_([0-9]+)[.]([0-9]+)', 2), '') AS INTEGER) AS minor, 'pkg:deb/' || lower(trim(n_name)) || '@' || CAST(n_nationkey AS VARCHAR) || '.' || CAST(n_regionkey AS VARCHAR) AS purl
FROM (SELECT *, CASE WHEN n_nationkey % 3 = 0 THEN 'SSH-2.0-dropbear' ELSE 'SSH-2.0-OpenSSH_' || CAST(n_nationkey AS VARCHAR) || '.' || CAST(n_regionkey AS VARCHAR) || 'p1 Ubuntu-3' END AS b FROM nation)""")
def banner_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of SSH banners, and package addresses."""
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    banner = F.when(F.col("n_nationkey") % 3 == 0, "SSH-2.0-dropbear").otherwise(F.concat(F.lit("SSH-2.0-OpenSSH_"), k, F.lit("."), r, F.lit("p1 Ubuntu-3")))
    part = lambda n: F.nullif(F.regexp_extract(banner, r"OpenSSH_([0-9]+)\.([0-9]+)", n), F.lit("")).cast("int")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), part(1).alias("major"), part(2).alias("minor"), F.concat(F.lit("pkg:deb/"), F.lower(F.trim("n_name")), F.lit("@"), k, F.lit("."), r).alias("purl"))


@query(f"""WITH {ASSETS_SQL}, o AS (SELECT CAST(count_if(expiry_days < 0) AS BIGINT) AS a, CAST(count_if(expiry_days BETWEEN 0 AND 30) AS BIGINT) AS b, CAST(count_if(expiry_days BETWEEN 31 AND 90) AS BIGINT) AS c, CAST(count_if(slack_months < 0) AS BIGINT) AS d, min(slack_months) AS w FROM assets),
x(kind, severity, most, text) AS (VALUES ('failed-checks', 'critical', 3, 'output checks failed'), ('blind-spots', 'warning', 3, 'sensors never ran'), ('inactive-sensors', 'warning', 5, 'required sensors are inactive'), ('retired-models', 'warning', 3, 'models are out of rotation')),
m AS (SELECT 'failed-checks' AS kind, c_name AS name FROM customer WHERE c_custkey % 50 = 7 UNION ALL SELECT 'blind-spots', n_name FROM nation WHERE n_nationkey % 6 = 5 UNION ALL SELECT 'inactive-sensors', n_name FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'retired-models', s_name FROM supplier WHERE s_suppkey % 9 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS k, count(*) OVER (PARTITION BY kind) AS n FROM m), g AS (SELECT r.kind, severity, n, text || ': ' || string_agg(name, ', ' ORDER BY name) FILTER (k <= most) || CASE WHEN n > any_value(most) THEN ' and ' || (n - any_value(most)) || ' more' ELSE '' END AS body FROM r JOIN x USING (kind) GROUP BY r.kind, severity, n, text),
u AS (SELECT 'expiry' AS kind, CASE WHEN a + b > 0 THEN 'critical' ELSE 'warning' END AS severity, a + b + c AS n, format('{{}} expired, {{}} critical, {{}} warning', a, b, c) AS body FROM o WHERE a + b + c > 0 UNION ALL SELECT 'negative-slack', 'critical', d, printf('worst slack %.1f months', w) FROM o WHERE d > 0
  UNION ALL SELECT kind, severity, n, body FROM g UNION ALL SELECT 'announcement-' || r_name, CASE r_regionkey WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END, 1, 'about ' || r_name FROM region)
SELECT row_number() OVER (ORDER BY list_position(['critical', 'warning', 'info'], severity), kind) AS place, * FROM u""")
def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the state of the estate has to say, the most urgent first."""
    flag = lambda name, column, ok, as_: table(spark, sf_dir, name).select(F.col(column).alias("name"), ok.alias(as_))
    news = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 0, "critical").when(F.col("r_regionkey") == 1, "warning").otherwise("unheard of").alias("severity"), F.concat(F.lit("about "), "r_name").alias("body"))
    return inventory.alerts(
        scored(spark, sf_dir).withColumn("expiry_days", F.datediff("not_after", F.lit(AS_OF).cast("date"))), flag("nation", "n_name", F.col("n_nationkey") % 6 != 5, "ran").where("not ran"), flag("customer", "c_name", F.col("c_custkey") % 50 != 7, "passed"), flag("nation", "n_name", F.col("n_nationkey") % 4 == 1, "active"),
        flag("supplier", "s_name", F.col("s_suppkey") % 9 != 1, "available"), news,
    )


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CAST(DATE '2026-01-01' AS DATE) + CAST(o_orderkey % 3000 AS INTEGER) AS VARCHAR) AS day, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as ISO dates and moments in RFC 3339."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("o_orderkey") % 3000).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.cast("string").alias("day"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("""WITH k(name, low, high, qubits) AS (VALUES ('RSA', 1024, 1024, 700), ('RSA', 2048, 2048, 1409), ('RSA', 4096, 4096, 2820), ('RSA', NULL, NULL, 1409), ('ECDSA', 256, 256, 1193)), s AS (SELECT p_partkey AS id, ['RSA', 'ECDSA', 'DH'][CAST(p_partkey % 3 AS INTEGER) + 1] AS name, [1024, 2048, 256, 3000][CAST(p_partkey % 4 AS INTEGER) + 1] AS size FROM part),
m AS (SELECT id, qubits, CASE WHEN s.name = k.name AND low = size THEN 1 WHEN s.name = k.name AND low IS NULL THEN 2 WHEN k.name = 'RSA' AND low = 2048 THEN 3 END AS tier FROM s, k) SELECT id, CAST(arg_min(qubits, tier) AS INTEGER) AS qubits, CAST(min(tier) AS INTEGER) AS tier FROM m WHERE tier IS NOT NULL GROUP BY id""")
def resource_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table of resources by size, else without a size, else those of the reference."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), pick(["RSA", "ECDSA", "DH"], p % 3).alias("name"), pick([1024, 2048, 256, 3000], p % 4).alias("size"))
    known = spark.createDataFrame([("RSA", 1024, 700), ("RSA", 2048, 1409), ("RSA", 4096, 2820), ("RSA", None, 1409), ("ECDSA", 256, 1193)], "name string, size int, qubits int")
    own, plain = known.where("size is not null"), known.where("size is null").select("name", F.col("qubits").alias("unsized"))
    out = rows.join(F.broadcast(own), ["name", "size"], "left").join(F.broadcast(plain), "name", "left")  # five rows
    return out.select("id", F.coalesce("qubits", "unsized", F.lit(1409)).alias("qubits"), F.when(F.col("qubits").isNotNull(), 1).when(F.col("unsized").isNotNull(), 2).otherwise(3).alias("tier"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty of each owner; older ones are evicted."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", "event_id", place.alias("place")).where("place <= 20")


@query("""WITH t AS (SELECT o_custkey % 50 AS file, o_orderkey % 40 AS line FROM orders), k AS (SELECT DISTINCT file, line FROM t) SELECT file, count(*) AS lines, min(line) AS first FROM k GROUP BY file""")
def sighting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places of sightings in each file."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") % 40).alias("line")).distinct()
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.min("line").alias("first"))


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS ended, o_custkey FROM orders) SELECT id, ended, coalesce(d.n, 0) AS dependents FROM o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) d ON d.l_orderkey = id ORDER BY ended, dependents DESC, id LIMIT 50""")
def expiry_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ends first, with how much depends on it."""
    hang = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("dependents"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("ended")).join(hang, "id", "left").na.fill(0, ["dependents"])
    return rows.orderBy("ended", F.desc("dependents"), "id").limit(50)


@query("""WITH k AS (SELECT 'm' || CAST(s_suppkey % 40 AS VARCHAR) AS scope, 'l' || CAST(s_nationkey % 3 AS VARCHAR) AS library, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 2 AS VARCHAR) END AS version, s_suppkey AS id FROM supplier), v AS (SELECT scope, library, min(version) AS low, max(version) AS high FROM k GROUP BY ALL)
SELECT id, coalesce(version, CASE WHEN low = high THEN low END) AS version FROM k JOIN v USING (scope, library)""")
def adopted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library without a version takes the only one that its scope knows."""
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s.alias("id"), F.concat(F.lit("m"), (s % 40).cast("string")).alias("scope"), F.concat(F.lit("l"), (F.col("s_nationkey") % 3).cast("string")).alias("library"), F.when(s % 3 != 0, (s % 2).cast("string")).alias("version"))
    return joins.only_version(rows).select("id", "version")


_LABELS = ["Firmware Key", "release code", "device-ca", "PIN verify", "jwt signer", "bulk", "root of trust"]
_TYPES = ["CKK_RSA", "CKK_EC", "CKK_AES", "CKK_DES3", "CKK_OTHER"]


@query(f"""WITH o AS (SELECT s_suppkey, s_nationkey, {pick_sql(_LABELS, "s_suppkey % 7")} || ' ' || CAST(s_suppkey AS VARCHAR) AS label, {pick_sql(_TYPES, "s_suppkey % 5")} AS t FROM supplier)
SELECT 'vault-hsm-tok' || CAST(s_nationkey AS VARCHAR) || '-' || replace(lower(label), ' ', '-') AS id, CASE s_suppkey % 7 WHEN 0 THEN 'firmware_signing' WHEN 1 THEN 'code_signing' WHEN 2 THEN 'issuing_ca' WHEN 3 THEN 'payment_hsm' WHEN 4 THEN 'token_signing' ELSE CASE WHEN t IN ('CKK_AES', 'CKK_DES3') THEN 'backup_encryption' WHEN s_suppkey % 2 = 0 THEN 'code_signing' ELSE 'generic_key' END END AS asset_class,
  CASE t WHEN 'CKK_RSA' THEN 'RSA' WHEN 'CKK_EC' THEN 'ECDSA' WHEN 'CKK_AES' THEN 'AES' WHEN 'CKK_DES3' THEN '3DES' ELSE 'OTHER' END AS algorithm, CAST(CASE t WHEN 'CKK_RSA' THEN 2048 WHEN 'CKK_AES' THEN 256 END AS INTEGER) AS key_size, CASE WHEN s_suppkey % 2 = 0 THEN 'sign' ELSE 'encrypt' END AS usage, s_nationkey % 3 <> 0 AS blocked FROM o""")
def vault_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of hardware modules, a document for each token, read back."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    kind = pick(_TYPES, s % 5)
    obj = F.struct(
        F.concat(pick(_LABELS, s % 7), F.lit(" "), s.cast("string")).alias("CKA_LABEL"), kind.alias("CKA_KEY_TYPE"), F.when(kind == "CKK_RSA", 2048).alias("CKA_MODULUS_BITS"), F.when(kind == "CKK_AES", 32).alias("CKA_VALUE_LEN"), (s % 2 == 0).alias("CKA_SIGN"), F.lit("x").alias("CKA_VALUE"),
    )
    slots = table(spark, sf_dir, "supplier").groupBy(n).agg(F.collect_list(obj).alias("objects"))  # a nation's suppliers make up one document
    slot = F.array(F.struct(n.cast("string").alias("slot_id"), F.concat(F.lit("Tok"), n.cast("string")).alias("token_label"), (n % 3 == 0).alias("pqc_ready"), "objects"))
    documents = slots.select(F.concat(F.lit("v/"), n.cast("string"), F.lit("/pkcs11.json")).alias("path"), F.to_json(F.struct(slot.alias("slots"))).alias("text"))
    return vault.pkcs11(documents).select("id", "asset_class", "algorithm", "key_size", "usage", "blocked")


@query("""SELECT 'vault-aws-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id, CASE s_suppkey % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'AES' ELSE 'HMAC_256' END AS algorithm, CAST(CASE s_suppkey % 3 WHEN 0 THEN 3072 WHEN 1 THEN 256 END AS INTEGER) AS key_size, CASE WHEN s_suppkey % 3 = 1 THEN 'generic_key' ELSE 'token_signing' END AS asset_class FROM supplier
UNION ALL SELECT 'vault-gcp-k' || CAST(s_suppkey AS VARCHAR) || '-' || CAST(s_nationkey AS VARCHAR), 'ECDSA', 256, 'token_signing' FROM supplier""")
def vault_cloud_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of two cloud services in their own shapes, read back as one table."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    aws = F.struct(F.concat(F.lpad(s.cast("string"), 8, "0"), F.lit("-x")).alias("KeyId"), F.lit("arn:aws:kms:x:1:key/1").alias("Arn"), pick(["RSA_3072", "SYMMETRIC_DEFAULT", "HMAC_256"], s % 3).alias("KeySpec"))
    gcp = F.struct(F.concat(F.lit("p/l/cryptoKeys/k"), s.cast("string"), F.lit("/cryptoKeyVersions/"), n).alias("name"), F.lit("EC_SIGN_P256_SHA256").alias("algorithm"))
    document = F.struct(F.struct(F.array(aws).alias("keys")).alias("aws_kms"), F.struct(F.array(gcp).alias("crypto_key_versions")).alias("gcp_kms"))
    documents = table(spark, sf_dir, "supplier").select(F.concat(F.lit("v/"), s.cast("string"), F.lit("/cloud_kms.json")).alias("path"), F.to_json(document).alias("text"))
    return vault.cloud_keys(documents).select("id", "algorithm", "key_size", "asset_class")


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
