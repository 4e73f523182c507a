"""Queries on what algorithms, suites and protocols are, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import taxonomy as T
from quantalog.plans.more import SUITES
from quantalog.sources.estate import pick, table

QUERIES: dict[str, tuple] = {}

NAMES = [
    "RSA", "rsa 4096", "sha256WithRSAEncryption", "ECDSA", "prime256v1", "ECDH", "AES-128-GCM", "AES", "aes_256_cbc", "SHA1", "SHA-3", "ChaCha20-Poly1305", "DESede", "ML-KEM-768-X25519",
    "Kyber768", "dilithium", "X25519", "curve25519", "EdDSA", "MD5", "ecdsa-with-SHA384", "HMAC", "Blowfish", "SPHINCS+", "frobnicate", "", "RSASSA-PSS", "DHE", "SHA-224", "AES-192",
]
SIZES = [2048, 256, 128, 384, None, 521, 0]
PROTOCOLS = ["TLSv1.2", "TLS v1", "SSLv3", "tlsv1.3", None, "QUIC", "TLSv1.1"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


def _list(values, number: str) -> str:
    return f"([{', '.join(map(_text, values))}])[CAST({number} AS INTEGER) + 1]"


def _pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def _facts_sql(source: str) -> str:
    """Facts of the names in `source` (name, size), by joins: aliases, then whole keys, then the longest known key that a name begins with."""
    return f"""facts(key, canonical, primitive, verdict, bits, level, replacement) AS (VALUES {_values(T.FACTS)}), aliases(alias, key) AS (VALUES {_values(T.ALIASES.items())}),
rsa(size, bits) AS (VALUES {_values(T.RSA_BITS.items())}), curves(size, bits, curve) AS (VALUES {_values([(k, v, T.CURVES[k]) for k, v in T.CURVE_BITS.items()])}),
n0 AS (SELECT DISTINCT name, size FROM {source}), n1 AS (SELECT *, upper(regexp_replace(trim(name), '[\\s_]+', '-', 'g')) AS k0 FROM n0),
n2 AS (SELECT *, CASE WHEN regexp_matches(k0, '^(SHA-?[0-9]+|MD5)-?WITH-?(RSA|ECDSA|DSA)') THEN regexp_extract(k0, 'WITH-?(RSA|ECDSA|DSA)', 1) WHEN regexp_matches(k0, '^(ECDSA|RSASSA-PSS|RSA)-WITH-SHA-?[0-9]+$') THEN regexp_extract(k0, '^(ECDSA|RSASSA-PSS|RSA)', 1) ELSE k0 END AS k1 FROM n1),
n3 AS (SELECT n2.*, coalesce(a.key, k1) AS key, nullif(size, 0) AS given FROM n2 LEFT JOIN aliases a ON a.alias = k1),
n4 AS (SELECT *, coalesce(given, try_cast(nullif(regexp_extract(key, '([0-9]{{3,5}})', 1), '') AS INTEGER)) AS modulus, coalesce(try_cast(nullif(regexp_extract(key, '(128|192|256)', 1), '') AS INTEGER), given) AS width FROM n3),
n5 AS (SELECT name, size, key, arg_max(f.key, length(f.key)) AS known FROM n4 n LEFT JOIN facts f USING (key) WHERE f.key IS NOT NULL GROUP BY ALL
  UNION ALL SELECT name, size, n.key, arg_max(f.key, length(f.key)) FROM n4 n JOIN facts f ON starts_with(n.key, f.key) WHERE n.key NOT IN (SELECT key FROM facts) GROUP BY ALL),
classified AS (SELECT n.name, n.size,
    CASE WHEN n.key = '' OR n.key IS NULL THEN 'Unknown' WHEN starts_with(n.key, 'RSA') THEN concat_ws('-', 'RSA', CAST(modulus AS VARCHAR)) WHEN n.key IN ('ECDSA', 'ECDH') THEN concat_ws('-', n.key, coalesce(c.curve, CAST(given AS VARCHAR))) WHEN starts_with(n.key, 'AES') THEN coalesce(s.canonical, 'AES') ELSE coalesce(f.canonical, trim(n.name)) END AS canonical,
    CASE WHEN n.key = '' OR n.key IS NULL THEN 'unknown' WHEN starts_with(n.key, 'RSA') THEN 'pke' WHEN n.key = 'ECDSA' THEN 'signature' WHEN n.key = 'ECDH' THEN 'key-agree' WHEN starts_with(n.key, 'AES') THEN 'block-cipher' ELSE coalesce(f.primitive, 'unknown') END AS primitive,
    CASE WHEN n.key = '' OR n.key IS NULL THEN 'unknown' WHEN starts_with(n.key, 'RSA') OR n.key IN ('ECDSA', 'ECDH') THEN 'shor' WHEN starts_with(n.key, 'AES') THEN coalesce(s.verdict, 'grover') ELSE coalesce(f.verdict, 'unknown') END AS verdict,
    CASE WHEN starts_with(n.key, 'RSA') THEN r.bits WHEN n.key IN ('ECDSA', 'ECDH') THEN c.bits WHEN starts_with(n.key, 'AES') THEN s.bits ELSE f.bits END AS classical_bits,
    CASE WHEN starts_with(n.key, 'AES') THEN coalesce(s.level, 0) ELSE coalesce(f.level, 0) END AS nist_level,
    CASE WHEN starts_with(n.key, 'RSA') THEN 'ML-KEM-768 (encryption) / ML-DSA-65 (signature)' WHEN n.key = 'ECDSA' THEN 'ML-DSA-65 (signature)' WHEN n.key = 'ECDH' THEN 'ML-KEM-768 (key establishment)' WHEN starts_with(n.key, 'AES') THEN s.replacement ELSE f.replacement END AS replacement
  FROM n4 n LEFT JOIN n5 ON n5.name = n.name AND n5.size IS NOT DISTINCT FROM n.size LEFT JOIN facts f ON f.key = n5.known LEFT JOIN facts s ON s.key = 'AES-' || CAST(width AS VARCHAR) LEFT JOIN rsa r ON r.size = modulus LEFT JOIN curves c ON c.size = given)"""


@query(f"WITH src AS (SELECT p_partkey AS id, {_list(NAMES, f'p_partkey % {len(NAMES)}')} AS name, CAST({_list(SIZES, f'p_partkey // {len(NAMES)} % {len(SIZES)}')} AS INTEGER) AS size FROM part), {_facts_sql('src')} SELECT id, c.* EXCLUDE (name, size) FROM src JOIN classified c ON c.name = src.name AND c.size IS NOT DISTINCT FROM src.size")
def algorithm_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of algorithms as they are spelled, and what is known about them."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), _pick(NAMES, p % len(NAMES)).alias("name"), _pick(SIZES, F.floor(p / len(NAMES)) % len(SIZES)).alias("size"))
    return rows.select("id", T.algorithm_facts(F.col("name"), F.col("size")).alias("f")).select("id", "f.*")


@query(f"SELECT s_suppkey AS id, v AS version, CASE WHEN v IS NULL THEN 'unknown' WHEN k = 'TLSV1' THEN 'classical' WHEN contains(k, 'SSLV2') OR contains(k, 'SSLV3') OR contains(k, 'TLSV1.0') OR contains(k, 'TLSV1.1') THEN 'classical' WHEN contains(k, 'TLSV1.2') OR contains(k, 'TLSV1.3') THEN 'pqc' ELSE 'unknown' END AS verdict FROM (SELECT *, upper(regexp_replace(v, '[\\s_]+', '', 'g')) AS k FROM (SELECT s_suppkey, {_list(PROTOCOLS, 's_suppkey % 7')} AS v FROM supplier))")
def protocol_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s.alias("id"), _pick(PROTOCOLS, s % 7).alias("version"))
    return rows.withColumn("verdict", T.protocol_verdict(F.col("version")))


_FOUND = f"""found AS (SELECT l_partkey AS id, CASE WHEN l_partkey % 3 = 0 THEN {_list(NAMES, f'l_partkey % {len(NAMES)}')} END AS algorithm, CAST({_list(SIZES, 'l_suppkey % 7')} AS INTEGER) AS key_size,
  CASE WHEN l_partkey % 3 = 1 THEN {_list([s[0] for s in SUITES], f'l_suppkey % {len(SUITES)}')} END AS cipher_suite, CASE WHEN l_partkey % 6 = 2 THEN 'X25519' END AS key_exchange, {_list(PROTOCOLS, 'l_orderkey % 7')} AS protocol FROM (SELECT o_orderkey AS l_partkey, o_custkey AS l_suppkey, o_orderkey // 3 AS l_orderkey FROM orders))"""


@query(f"""WITH {_FOUND}, r(suite, kex, auth, bulk, bits, mode, mac) AS (VALUES {_values(SUITES)}),
parts AS (SELECT id, 0 AS n, algorithm AS name, key_size AS size FROM found WHERE algorithm <> '' UNION ALL SELECT id, 1, key_exchange, key_size FROM found WHERE key_exchange IS NOT NULL
  UNION ALL SELECT id, 2, kex, NULL FROM found JOIN r ON suite = cipher_suite WHERE kex IS NOT NULL UNION ALL SELECT id, 3, auth, NULL FROM found JOIN r ON suite = cipher_suite WHERE auth IS NOT NULL
  UNION ALL SELECT id, 4, bulk, bits FROM found JOIN r ON suite = cipher_suite WHERE bulk IS NOT NULL UNION ALL SELECT id, 5, mac, NULL FROM found JOIN r ON suite = cipher_suite WHERE mac IS NOT NULL),
{_facts_sql('parts')}, c AS (SELECT p.id, p.n, f.* FROM parts p JOIN classified f ON f.name = p.name AND f.size IS NOT DISTINCT FROM p.size),
a AS (SELECT f.id, protocol, CASE WHEN protocol IN ('TLS v1', 'SSLv3', 'TLSv1.1') THEN 'classical' WHEN protocol IN ('TLSv1.2', 'tlsv1.3') THEN 'pqc' ELSE 'unknown' END AS pv, coalesce(bool_or(verdict = 'shor'), false) AS s, coalesce(bool_or(verdict = 'classical'), false) AS b, coalesce(bool_or(verdict = 'grover'), false) AS g, coalesce(bool_or(verdict = 'unknown'), false) AS u, coalesce(bool_or(verdict = 'pqc'), false) AS q, count(n) AS k FROM found f LEFT JOIN c USING (id) GROUP BY ALL),
v AS (SELECT *, CASE WHEN b OR pv = 'classical' THEN 'classical' WHEN s THEN 'shor' WHEN g THEN 'grover' WHEN u THEN 'unknown' WHEN q THEN 'pqc' ELSE 'unknown' END AS verdict FROM a)
SELECT v.id, v.verdict, coalesce(arg_min(c.canonical, c.n) FILTER (c.verdict = v.verdict), CASE WHEN v.verdict = 'classical' AND pv = 'classical' THEN protocol END) AS driver, s AS quantum_vulnerable, b OR pv = 'classical' AS classically_broken, g AS grover_weakened,
  arg_min(c.replacement, c.n) FILTER (c.verdict = v.verdict AND c.replacement IS NOT NULL) AS replacement, CAST(k AS INTEGER) AS components FROM v LEFT JOIN c USING (id) GROUP BY v.id, v.verdict, pv, protocol, s, b, g, k""")
def finding_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every finding over all that it names, with flags that the verdict doesn't hide."""
    p, s, o = F.col("o_orderkey"), F.col("o_custkey"), F.floor(F.col("o_orderkey") / 3)
    found = table(spark, sf_dir, "orders").select(
        p.alias("id"),
        F.when(p % 3 == 0, _pick(NAMES, p % len(NAMES))).alias("algorithm"),
        _pick(SIZES, s % 7).alias("key_size"),
        F.when(p % 3 == 1, pick([x[0] for x in SUITES], s % len(SUITES))).alias("cipher_suite"),
        F.when(p % 6 == 2, "X25519").alias("key_exchange"),
        _pick(PROTOCOLS, o % 7).alias("protocol"),
    )
    return T.classified(found).select("id", "verdict", "driver", "quantum_vulnerable", "classically_broken", "grover_weakened", "replacement", "components")


@query(f"WITH f(key, canonical, primitive, verdict, bits, level, replacement) AS (VALUES {_values(T.FACTS)}) SELECT p_partkey AS id, primitive, CASE WHEN primitive = 'hash' THEN bits WHEN bits > 0 AND primitive IN ('block-cipher', 'stream-cipher', 'mac', 'kdf') THEN bits // 2 END AS residual_bits, CASE WHEN primitive = 'hash' OR bits <= 0 OR bits IS NULL OR primitive NOT IN ('block-cipher', 'stream-cipher', 'mac', 'kdf') THEN NULL WHEN bits // 2 >= 128 THEN 'comfortable' WHEN bits // 2 >= 112 THEN 'adequate' WHEN bits // 2 >= 64 THEN 'weakened' ELSE 'inadequate' END AS band FROM part JOIN f ON key = {_list([f[0] for f in T.FACTS], f'p_partkey % {len(T.FACTS)}')}")
def grover_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), T.algorithm_facts(_pick([f[0] for f in T.FACTS], p % len(T.FACTS)), F.lit(None).cast("int")).alias("f"))
    return rows.select("id", "f.primitive", T.grover(F.col("f.classical_bits"), F.col("f.primitive")).alias("g")).select("id", "primitive", "g.residual_bits", "g.band")


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
