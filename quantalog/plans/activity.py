"""Queries on drift, images, event logs and text rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import drift, events, images, rules
from quantalog.sources import estate
from quantalog.sources.estate import AS_OF, FINDINGS_SQL, pick, pick_sql

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


PROTOCOLS = ["TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3"]
SUITES = ["TLS_AES_256_GCM", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_AES_128_GCM", "TLS_RSA_WITH_RC4_128"]
KEXES = ["curve25519-sha256", "mlkem768x25519-sha256", "diffie-hellman-group14-sha256"]
ADDRESSES = ["10.1.2.3", "172.20.0.9", "8.8.4.4", "192.168.7.7", "203.0.113.5"]
STATES = ["Active", "Deactivated", "Active", "Compromised", "Active"]


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = estate.findings(spark, sf_dir)
    p, s, n = F.col("partkey"), F.col("suppkey"), F.col("line")
    digits = F.lpad((p * 7919 % 100003).cast("string"), 32, "0")
    return f.select(
        F.concat_ws("/", "id", p.cast("string"), s.cast("string")).alias("id"), "name", "plane", "source_type", "system", "algorithm", F.array("host").alias("hosts"),
        pick(PROTOCOLS, (p + n) % 4).alias("protocol"), pick(SUITES, (p + s) % 4).alias("suite"), pick(KEXES, (s + F.floor(p / 7)) % 3).alias("kex"),
        F.concat(F.lit("/srv/r"), (s % 40).cast("string")).alias("project"), F.concat(F.lit("/srv/r"), (p % 40).cast("string"), F.lit("/bin/b"), (p % 9).cast("string")).alias("path"),
        F.lit("openssl").alias("library"), (1 + (p + n) % 3).cast("int").alias("version"), F.when(F.col("algorithm") == "RSA-2048", 2048).when(F.col("algorithm") == "RSA-4096", 4096).alias("key_size"),
        digits.alias("public_key"), pick(STATES, p % 5).alias("state"), F.concat(digits, digits).alias("fingerprint"),
        (p % 997).cast("string").alias("serial"), F.concat(F.lit("ca"), (s % 3).cast("string")).alias("issuer"), "not_after", pick(ADDRESSES, (p + s) % 5).alias("peer_ip"),
    )


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    strings = lambda *x: F.array(*map(F.lit, x))
    rows = estate.table(spark, sf_dir, "supplier").select(
        F.when(s % 2 == 0, "tls_policy").otherwise("ssh_policy").alias("kind"),
        F.array(F.concat(F.lit("h"), s.cast("string"), F.lit(":443"))).alias("hosts"),
        F.when(s % 3 == 0, strings("TLSv1.1", "TLSv1.2")).otherwise(strings("TLSv1.2", "TLSv1.3")).alias("protocols"),
        F.when(s % 4 == 0, "HIGH:!aNULL").alias("ciphers"),
        (s % 8 == 0).alias("weak_enabled"),
        F.when(s % 5 == 0, strings("mlkem768x25519-sha256", "curve25519-sha256")).otherwise(strings("curve25519-sha256")).alias("kex"),
        F.when(s % 6 == 0, "internal").otherwise("public").alias("exposure"),
    )
    return rows


_DIGITS = "lpad(CAST(partkey * 7919 % 100003 AS VARCHAR), 32, '0')"
DRIFT_SQL = f"""{FINDINGS_SQL}, o AS (SELECT id || '/' || CAST(partkey AS VARCHAR) || '/' || CAST(suppkey AS VARCHAR) AS id, name, plane, source_type, system, algorithm, host, suppkey, partkey,
    {pick_sql(PROTOCOLS, "(partkey + line) % 4")} AS protocol, {pick_sql(SUITES, "(partkey + suppkey) % 4")} AS suite, {pick_sql(KEXES, "(suppkey + partkey // 7) % 3")} AS kex, 1 + (partkey + line) % 3 AS version,
    '/srv/r' || CAST(suppkey % 40 AS VARCHAR) AS project, '/srv/r' || CAST(partkey % 40 AS VARCHAR) || '/bin/b' || CAST(partkey % 9 AS VARCHAR) AS path,
    CASE algorithm WHEN 'RSA-2048' THEN 2048 WHEN 'RSA-4096' THEN 4096 END AS key_size, {_DIGITS} AS public_key, {pick_sql(STATES, "partkey % 5")} AS state, {_DIGITS} || {_DIGITS} AS fingerprint,
    CAST(partkey % 997 AS VARCHAR) AS serial, 'ca' || CAST(suppkey % 3 AS VARCHAR) AS issuer, not_after, {pick_sql(ADDRESSES, "(partkey + suppkey) % 5")} AS peer_ip FROM findings),
d AS (SELECT s_suppkey AS k, 'h' || CAST(s_suppkey AS VARCHAR) || ':443' AS host FROM supplier),
rec AS (
  SELECT 'D1' AS rule, 'high' AS severity, o.host AS subject, CASE WHEN k % 3 = 0 THEN 'TLSv1.1 TLSv1.2' ELSE 'TLSv1.2 TLSv1.3' END AS declared, protocol AS observed, id FROM o JOIN d USING (host)
    WHERE plane = 'observed' AND source_type = 'tls' AND k % 2 = 0 AND (protocol = 'TLSv1.0' OR (protocol = 'TLSv1.1' AND k % 3 <> 0))
  UNION ALL SELECT 'D2', 'high', o.host, 'HIGH:!aNULL', suite, id FROM o JOIN d USING (host) WHERE plane = 'observed' AND source_type = 'tls' AND k % 2 = 0 AND k % 4 = 0 AND k % 8 <> 0 AND (contains(suite, '3DES') OR contains(suite, 'RC4'))
  UNION ALL SELECT 'D3', 'high', b.system, 'OpenSSL ' || CAST(s.version AS VARCHAR), 'OpenSSL ' || CAST(b.version AS VARCHAR), b.id FROM o b JOIN (SELECT DISTINCT system, version FROM o WHERE source_type = 'source' AND version >= 3) s USING (system) WHERE b.source_type = 'binary' AND b.version < 3
  UNION ALL SELECT 'D3', 'high', s.system, 'OpenSSL ' || CAST(s.version AS VARCHAR), 'OpenSSL ' || CAST(b.version AS VARCHAR), b.id FROM o b JOIN (SELECT DISTINCT system, project, version FROM o WHERE source_type = 'source' AND version >= 3) s ON starts_with(b.path, s.project || '/') WHERE b.source_type = 'binary' AND b.version < 3
  UNION ALL SELECT 'D4', 'medium', l.system, 'RSA-' || CAST(c.key_size AS VARCHAR), 'RSA-' || CAST(l.key_size AS VARCHAR), l.id FROM o l JOIN (SELECT DISTINCT system, key_size FROM o WHERE source_type = 'source' AND key_size IS NOT NULL) c ON l.system = c.system AND l.key_size < c.key_size WHERE l.plane IN ('observed', 'held')
  UNION ALL SELECT 'D5', 'high', g.name, g.state, l.host, l.id FROM o l JOIN (SELECT DISTINCT public_key, state, name FROM o WHERE state IN ('Deactivated', 'Compromised')) g USING (public_key) WHERE l.plane = 'observed'
  UNION ALL SELECT 'D6', 'critical', h.name, CAST(h.not_after AS VARCHAR), l.host, l.id FROM o l JOIN o h ON (l.fingerprint = h.fingerprint) WHERE l.plane = 'observed' AND h.plane = 'held' AND h.not_after < DATE '{AS_OF}'
  UNION ALL SELECT 'D6', 'critical', h.name, CAST(h.not_after AS VARCHAR), l.host, l.id FROM o l JOIN o h ON l.serial = h.serial AND l.issuer = h.issuer WHERE l.plane = 'observed' AND h.plane = 'held' AND h.not_after < DATE '{AS_OF}'
  UNION ALL SELECT 'D7', 'medium', o.host, 'mlkem768x25519-sha256', '(none)', min(id) FROM o JOIN d USING (host) WHERE plane = 'observed' AND source_type = 'ssh' AND k % 2 = 1 AND k % 5 = 0 GROUP BY o.host HAVING NOT bool_or(kex = 'mlkem768x25519-sha256')
  UNION ALL SELECT 'D8', 'high', o.host, 'internal', peer_ip, id FROM o JOIN d USING (host) WHERE plane = 'observed' AND k % 6 = 0 AND peer_ip IN ('8.8.4.4', '203.0.113.5')),
drift AS (SELECT rule, severity, subject, declared, observed, min(id) AS asset_id FROM rec GROUP BY ALL)"""


@query(f"WITH {DRIFT_SQL} SELECT * FROM drift")
def drift_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules D1 to D8 over all findings and declarations."""
    return drift.all_drift(observed(spark, sf_dir), declarations(spark, sf_dir), AS_OF)


@query(f"WITH {DRIFT_SQL} SELECT CASE GROUPING_ID(rule, severity) WHEN 1 THEN 'rule' WHEN 2 THEN 'severity' ELSE 'all' END AS level, coalesce(rule, severity, '') AS name, count(*) AS n FROM drift GROUP BY GROUPING SETS ((rule), (severity), ())")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_counts(observed(spark, sf_dir), declarations(spark, sf_dir), AS_OF)


IMAGE_SQL = """e AS (SELECT CAST(l_linenumber AS INTEGER) AS layer, 'd' || CAST(l_suppkey % 7 AS VARCHAR) || '/e' || CAST(l_partkey % 11 AS VARCHAR) || '/' ||
  CASE WHEN l_orderkey % 400 = 0 THEN '.wh..wh..opq' WHEN l_orderkey % 97 = 0 THEN '.wh.f' || CAST(l_partkey % 50 AS VARCHAR) ELSE 'f' || CAST(l_partkey % 50 AS VARCHAR) END AS path, CAST(max(l_partkey) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {IMAGE_SQL}, x AS (SELECT *, split_part(path, '/', 3) AS base, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM e),
f AS (SELECT path, max(layer) AS layer, arg_max(size, layer) AS size FROM x WHERE NOT starts_with(base, '.wh.') GROUP BY path)
SELECT path, layer, size FROM f WHERE NOT EXISTS (SELECT 1 FROM x w WHERE w.layer > f.layer AND ((w.base = '.wh..wh..opq' AND starts_with(f.path, w.folder || '/'))
  OR (w.base <> '.wh..wh..opq' AND starts_with(w.base, '.wh.') AND f.path = w.folder || '/' || substr(w.base, 5))))""")
def image_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are left after all layers and whiteouts."""
    p = F.col("l_partkey")
    name = F.concat(F.lit("f"), (p % 50).cast("string"))
    base = F.when(F.col("l_orderkey") % 400 == 0, ".wh..wh..opq").when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit(".wh."), name)).otherwise(name)
    path = F.concat(F.lit("d"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/e"), (p % 11).cast("string"), F.lit("/"), base)
    rows = estate.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("layer"), path.alias("path")).agg(F.max("l_partkey").alias("size"))
    return images.merged_view(rows)


EVENTS = ["ts", "event_id"]


@query("""WITH r AS (SELECT *, row_number() OVER w AS place, coalesce(CAST(lag(event_type) OVER w <> event_type AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r) SELECT user_id, event_type, min(place) AS first, count(*) AS length FROM n GROUP BY user_id, run, event_type""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.runs(estate.table(spark, sf_dir, "events"), "user_id", EVENTS, "event_type")


@query("""SELECT a || '>' || b || '>' || c AS gram, count(*) AS n FROM (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL GROUP BY 1""")
def event_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.ngrams(estate.table(spark, sf_dir, "events"), "user_id", EVENTS, "event_type", 3)


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS median FROM events")
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rolling_median(estate.table(spark, sf_dir, "events"), "user_id", EVENTS, "value").select("event_id", F.round("median", 6).alias("median"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def attempts_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estate.table(spark, sf_dir, "events")
    return rows.select("event_id", events.attempts(rows, "user_id", F.unix_seconds(F.col("ts").cast("timestamp")), 3600).alias("attempts"))


_FAULT = "event_type IN ('error', 'click', 'view')"


@query(f"""WITH m AS (SELECT *, CAST({_FAULT} AS INTEGER) AS f FROM events), s AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sound FROM m),
t AS (SELECT *, sum(f) OVER (PARTITION BY user_id, sound ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM s) SELECT event_id, CAST(streak AS BIGINT) AS streak, f = 1 AND streak >= 3 AS opens FROM t""")
def breaker_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of faults, and where they open the breaker."""
    return events.breaker(estate.table(spark, sf_dir, "events"), "user_id", EVENTS, F.expr(_FAULT)).select("event_id", "streak", "opens")


@query("""WITH m AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_type <> 'purchase' AS f FROM events)
SELECT event_id, coalesce(sum(CAST(f AS INTEGER)) OVER w >= 5 AND s - max(CASE WHEN f THEN s END) OVER w < 30000, false) AS locked FROM m WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 85399 PRECEDING AND 1 PRECEDING)""")
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estate.table(spark, sf_dir, "events")
    out = events.lockouts(rows, "user_id", F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_type") != "purchase", 5, 85400, 30000)
    return out.select("event_id", "locked")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, [t] AS kept, true AS admitted FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3 FROM (SELECT e.*, list_filter(r.kept, lambda x: e.t - x <= 21600000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, admitted FROM r""")
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 admitted events a user in 6 hours; rejected ones use up nothing."""
    return events.admitted(estate.table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 21600.0)


@query("""WITH c AS (SELECT event_id AS idx, CAST(user_id AS VARCHAR) || '|' || event_type AS content, CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN '' ELSE sha256(CAST(event_id AS VARCHAR)) END AS prev_hash FROM events),
h AS (SELECT idx, content, prev_hash, sha256(content || prev_hash) AS entry_hash FROM c),
l AS (SELECT *, lag(entry_hash) OVER (ORDER BY idx) AS expected, lag(idx) OVER (ORDER BY idx) AS before FROM h)
SELECT count(*) AS entries, min(idx) FILTER (WHERE CASE WHEN before IS NULL THEN prev_hash <> '' ELSE coalesce(prev_hash <> expected, true) END) AS first_broken FROM l""")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks the links of a hash chain; here the second link is broken on purpose."""
    rows = estate.table(spark, sf_dir, "events")
    low = rows.agg(F.min("event_id").alias("low"))
    prev = F.when(F.col("event_id") == F.col("low"), "").otherwise(F.sha2(F.col("event_id").cast("string"), 256))
    log = rows.crossJoin(F.broadcast(low)).select(F.col("event_id").alias("idx"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("content"), prev.alias("prev_hash"))
    return events.verify_chain(log.withColumn("entry_hash", F.sha2(F.concat("content", "prev_hash"), 256)))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows."""
    rows = estate.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 AS INTEGER), 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, count(*) AS n, min(event_id) AS least FROM s GROUP BY user_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after two quiet hours."""
    rows = estate.table(spark, sf_dir, "events")
    return rows.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("event_id").alias("least")).select("user_id", "n", "least")


_PATTERNS = [(n, p, f) for n, p, f in rules.RULES]
_FIRST = " ".join(f"WHEN regexp_matches(raw, '{p}') THEN '{n}'" for n, p, _ in _PATTERNS)
_FAMILY = " ".join(f"WHEN '{n}' THEN '{f}'" for n, _, f in _PATTERNS)
_MATCH = " ".join(f"WHEN '{n}' THEN regexp_extract(raw, '{p}')" for n, p, _ in _PATTERNS)
RULES_SQL = f"""hits AS (SELECT doc_id AS id, line, rule, CASE rule {_FAMILY} END AS family, CASE rule {_MATCH} END AS match FROM (
  SELECT doc_id, line, raw, CASE {_FIRST} END AS rule FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)) WHERE rule IS NOT NULL)"""


@query(f"WITH {RULES_SQL} SELECT id, CAST(line AS BIGINT) AS line, rule, family, match FROM hits")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching rule of each line of each document."""
    return rules.first_matches(estate.table(spark, sf_dir, "documents"), id_col="doc_id")


@query(f"""WITH {RULES_SQL}, j AS (SELECT d.lang, d.source, l.toxic = 1 AS truth, h.id IS NOT NULL AS found FROM labels l JOIN documents d USING (doc_id) LEFT JOIN (SELECT DISTINCT id FROM hits) h ON h.id = doc_id),
c AS (SELECT lang, source, CAST(count_if(truth AND found) AS BIGINT) AS tp, CAST(count_if(NOT truth AND found) AS BIGINT) AS fp, CAST(count_if(truth AND NOT found) AS BIGINT) AS fn FROM j GROUP BY CUBE (lang, source))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def label_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well having any rule hit tells toxic documents, by language, source, both and overall."""
    docs, labels = estate.table(spark, sf_dir, "documents"), estate.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    hits = rules.first_matches(docs, id_col="doc_id").select(F.col("id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    judged = labels.join(docs.select("doc_id", "lang", "source"), "doc_id").join(hits, "doc_id", "left")
    return rules.precision_recall(judged.select("lang", "source", (F.col("toxic") == 1).alias("truth"), F.coalesce("hit", F.lit(False)).alias("found")), ["lang", "source"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of a JSON column."""
    return estate.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
