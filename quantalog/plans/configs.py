"""Queries on configuration files and what they declare, each beside its SQL, which states the expected facts by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import configs, drift
from quantalog.operators.checkpoints import written
from quantalog.sources.estate import pick, pick_sql, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# A file for each supplier ({s}), of six kinds; {x} changes between two values.
_FILES = [
    ("sshd_config", "Port 2222\nListenAddress h{s}\nListenAddress 10.0.0.1:22\nKexAlgorithms {x}\nCiphers aes256-gcm@openssh.com,+3des-cbc\n# MACs hmac-md5\n", "mlkem768x25519-sha256,curve25519-sha256", "diffie-hellman-group14-sha1"),
    ("nginx.conf", "http {\n  ssl_protocols TLSv1.2 TLSv1.3; # {\n  server {\n    listen 443 ssl;\n    server_name h{s} www.h{s};\n    ssl_ciphers {x};\n    location / { root x; }\n  }\n  server { listen 0.0.0.0:8443 ssl;\n    server_name _ b{s};\n    ssl_protocols TLSv1 TLSv1.3;\n    ssl_ecdh_curve X25519:prime256v1;\n  }\n}\n", "HIGH:!RC4:DES-CBC3-SHA", "HIGH:!RC4"),
    ("site.conf", "<VirtualHost *:443>\n  ServerName h{s}\n  SSLProtocol {x}\n  SSLCipherSuite SSL ECDHE:!MD5:AES128-SHA\n</VirtualHost>\nSSLProtocol all\n", "all -TLSv1 -TLSv1.1", "all -TLSv1.3"),
    ("haproxy.cfg", "global\n  ssl-default-bind-ciphers {x}\nfrontend f\n  bind :443 ssl crt a.pem ssl-min-ver TLSv1.1 curves X25519:P-384\n", "ECDHE-RSA-AES128-GCM-SHA256:RC4", "!aNULL:TLS_AES_128_GCM_SHA256"),
    ("openssl.cnf", "[system]\nMinProtocol = {x}\nCipherString = DEFAULT@SECLEVEL=2:NULL\nGroups = X25519MLKEM768:?ffdhe2048:-x448\n", "TLSv1", "TLSv1.2"),
    ("java.security", "a=b\njdk.tls.disabledAlgorithms=SSLv3, {x}, RC4, DES, \\\n  3DES_EDE_CBC, RSA keySize < 1024\nc=d\n", "TLSv1, MD5withRSA", "TLSv1, TLSv1.1, MD5withRSA"),
]
# k, which of the two values (null: both), line, directive, token, position, algorithm, size, protocol, suite, usage
_FACTS = """(0, 0, 4, 'KexAlgorithms', 'mlkem768x25519-sha256', 0, 'X25519MLKEM768', NULL, NULL, NULL, 'key_exchange'), (0, 0, 4, 'KexAlgorithms', 'curve25519-sha256', 1, 'X25519', NULL, NULL, NULL, 'key_exchange'), (0, 1, 4, 'KexAlgorithms', 'diffie-hellman-group14-sha1', 0, 'DH', 2048, NULL, NULL, 'key_exchange'),
(0, NULL, 5, 'Ciphers', 'aes256-gcm@openssh.com', 0, 'AES-256', 256, NULL, NULL, 'encryption'), (0, NULL, 5, 'Ciphers', '3des-cbc', 1, '3DES', NULL, NULL, NULL, 'encryption'), (1, 0, 6, 'ssl_ciphers', 'DES-CBC3-SHA', 2, NULL, NULL, NULL, 'DES-CBC3-SHA', 'encryption'),
(1, NULL, 11, 'ssl_protocols', 'TLSv1.0', NULL, NULL, NULL, 'TLSv1.0', NULL, 'encryption'), (1, NULL, 12, 'ssl_ecdh_curve', 'X25519', 0, 'X25519', NULL, NULL, NULL, 'key_exchange'), (1, NULL, 12, 'ssl_ecdh_curve', 'prime256v1', 1, 'ECDH', 256, NULL, NULL, 'key_exchange'),
(2, 1, 3, 'SSLProtocol', 'TLSv1.0', NULL, NULL, NULL, 'TLSv1.0', NULL, 'encryption'), (2, 1, 3, 'SSLProtocol', 'TLSv1.1', NULL, NULL, NULL, 'TLSv1.1', NULL, 'encryption'), (2, NULL, 6, 'SSLProtocol', 'TLSv1.0', NULL, NULL, NULL, 'TLSv1.0', NULL, 'encryption'), (2, NULL, 6, 'SSLProtocol', 'TLSv1.1', NULL, NULL, NULL, 'TLSv1.1', NULL, 'encryption'),
(2, NULL, 4, 'SSLCipherSuite', 'AES128-SHA', 2, NULL, NULL, NULL, 'AES128-SHA', 'encryption'), (3, 0, 2, 'ssl-default-bind-ciphers', 'ECDHE-RSA-AES128-GCM-SHA256', 0, NULL, NULL, NULL, 'ECDHE-RSA-AES128-GCM-SHA256', 'encryption'), (3, 0, 2, 'ssl-default-bind-ciphers', 'RC4', 1, 'RC4', NULL, NULL, NULL, 'encryption'),
(3, 1, 2, 'ssl-default-bind-ciphers', 'TLS_AES_128_GCM_SHA256', 1, NULL, NULL, NULL, 'TLS_AES_128_GCM_SHA256', 'encryption'), (3, NULL, 4, 'ssl-min-ver', 'TLSv1.1', NULL, NULL, NULL, 'TLSv1.1', NULL, 'encryption'), (3, NULL, 4, 'curves', 'X25519', 0, 'X25519', NULL, NULL, NULL, 'key_exchange'), (3, NULL, 4, 'curves', 'P-384', 1, 'ECDH', 384, NULL, NULL, 'key_exchange'),
(4, 0, 2, 'MinProtocol', 'TLSv1.0', NULL, NULL, NULL, 'TLSv1.0', NULL, 'encryption'), (4, NULL, 3, 'CipherString', 'NULL', 1, NULL, NULL, NULL, 'NULL', 'encryption'), (4, NULL, 4, 'Groups', 'X25519MLKEM768', 0, 'X25519MLKEM768', NULL, NULL, NULL, 'key_exchange'), (4, NULL, 4, 'Groups', '?ffdhe2048', 1, 'DH', 2048, NULL, NULL, 'key_exchange'),
(5, 0, 2, 'jdk.tls.disabledAlgorithms', 'TLSv1.1', NULL, NULL, NULL, 'TLSv1.1', NULL, 'encryption'), (5, NULL, 2, 'jdk.tls.disabledAlgorithms', 'RSA keySize < 1024', NULL, 'RSA', 1024, NULL, NULL, 'signing')"""


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text."""
    s = F.col("s_suppkey")
    first = (F.floor(s / 6) % 2) == 0
    text = lambda k: F.replace(F.replace(F.lit(_FILES[k][1]), F.lit("{x}"), F.when(first, _FILES[k][2]).otherwise(_FILES[k][3])), F.lit("{s}"), s.cast("string"))
    every = reduce(lambda rest, k: F.when(s % 6 == k, text(k)).otherwise(rest), range(6), F.lit(None).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("etc/s"), s.cast("string"), F.lit("/"), pick([f[0] for f in _FILES], s % 6)).alias("path"), every.alias("text"))


@query(f"""WITH f(k, n, line, directive, token, position, algorithm, key_size, protocol, cipher_suite, usage) AS (VALUES {_FACTS})
SELECT 'etc/s' || CAST(s_suppkey AS VARCHAR) || '/' || {pick_sql([f[0] for f in _FILES], "k")} AS path, CAST(line AS INTEGER) AS line, directive, token, CAST(position AS INTEGER) AS position, algorithm, CAST(key_size AS INTEGER) AS key_size, protocol, cipher_suite, usage
FROM supplier JOIN f ON k = s_suppkey % 6 AND (n IS NULL OR n = (s_suppkey // 6) % 2)""")
def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What configuration files of six formats name or let through."""
    found = configs.findings(configs.settings(configs.lines(config_files(spark, sf_dir))))
    return found.select("path", "line", "directive", "token", "position", "algorithm", "key_size", "protocol", "cipher_suite", "usage")


_DECLARED = """f(k, n, line, kind, hosts, protocols, ciphers, weak, kex) AS (VALUES
  (0, 0, 4, 'ssh_policy', 'h{s}:2222 10.0.0.1:22', NULL, NULL, false, 'mlkem768x25519-sha256 curve25519-sha256'), (0, 1, 4, 'ssh_policy', 'h{s}:2222 10.0.0.1:22', NULL, NULL, false, 'diffie-hellman-group14-sha1'),
  (1, 0, 3, 'tls_policy', 'h{s}:443 www.h{s}:443', 'TLSv1.2 TLSv1.3', 'HIGH:!RC4:DES-CBC3-SHA', true, NULL), (1, 1, 3, 'tls_policy', 'h{s}:443 www.h{s}:443', 'TLSv1.2 TLSv1.3', 'HIGH:!RC4', false, NULL), (1, NULL, 9, 'tls_policy', 'b{s}:8443', 'TLSv1.0 TLSv1.3', NULL, false, NULL),
  (2, 0, 1, 'tls_policy', 'h{s}:443', 'TLSv1.2 TLSv1.3', 'SSL ECDHE:!MD5:AES128-SHA', false, NULL), (2, 1, 1, 'tls_policy', 'h{s}:443', 'TLSv1.0 TLSv1.1 TLSv1.2', 'SSL ECDHE:!MD5:AES128-SHA', false, NULL)),
d AS (SELECT s_suppkey AS s, k, line, kind, replace(hosts, '{s}', CAST(s_suppkey AS VARCHAR)) AS hosts, protocols, ciphers, weak, kex FROM supplier JOIN f ON k = s_suppkey % 6 AND (n IS NULL OR n = (s_suppkey // 6) % 2))"""


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.declarations(configs.lines(config_files(spark, sf_dir)))


@query(f"""WITH {_DECLARED} SELECT 'etc/s' || CAST(s AS VARCHAR) || '/' || {pick_sql([f[0] for f in _FILES], "k")} AS path, CAST(line AS INTEGER) AS line, kind, hosts, protocols, ciphers, weak AS weak_enabled, kex FROM d""")
def config_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What configuration files declare for hosts: servers and virtual hosts with what they take from above, and SSH."""
    text = lambda c: F.array_join(c, " ").alias(c)
    return declared(spark, sf_dir).select("path", "line", "kind", text("hosts"), text("protocols"), "ciphers", "weak_enabled", text("kex"))


@query(f"""WITH {_DECLARED}, h AS (SELECT s, k, kind, UNNEST(string_split(hosts, ' ')) AS host, protocols, ciphers, weak, kex FROM d),
o AS (SELECT o_orderkey AS id, 'h' || CAST(o_custkey % 200 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ':2222' ELSE ':443' END AS host, o_orderkey % 3 = 0 AS ssh, ['TLSv1.0', 'TLSv1.1', 'TLSv1.2'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS protocol, CASE WHEN o_orderkey % 5 = 0 THEN 'TLS_RSA_WITH_3DES_EDE_CBC_SHA' ELSE 'TLS_AES_256_GCM_SHA384' END AS suite, CASE WHEN o_orderkey % 7 = 0 THEN 'mlkem768x25519-sha256' ELSE 'curve25519-sha256' END AS kex FROM orders)
SELECT 'D1' AS rule, h.host AS subject, protocols AS declared, protocol AS observed, min(id) AS asset_id FROM h JOIN o ON h.host = o.host WHERE NOT ssh AND kind = 'tls_policy' AND protocol IN ('TLSv1.0', 'TLSv1.1') AND NOT contains(protocols, protocol) GROUP BY ALL
UNION ALL SELECT 'D2', h.host, ciphers, suite, min(id) FROM h JOIN o ON h.host = o.host WHERE NOT ssh AND kind = 'tls_policy' AND ciphers IS NOT NULL AND NOT weak AND contains(suite, '3DES') GROUP BY ALL
UNION ALL SELECT 'D7', h.host, 'mlkem768x25519-sha256', '(none)', min(id) FROM h JOIN o ON h.host = o.host WHERE ssh AND kind = 'ssh_policy' AND contains(h.kex, 'mlkem') GROUP BY h.host HAVING NOT bool_or(o.kex LIKE 'mlkem%')""")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is observed on hosts against what their configuration files declare."""
    k = F.col("o_orderkey")
    shell = k % 3 == 0
    host = F.concat(F.lit("h"), (F.col("o_custkey") % 200).cast("string"), F.when(shell, ":2222").otherwise(":443"))
    seen = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit("observed").alias("plane"), F.when(shell, "ssh").otherwise("tls").alias("source_type"), F.array(host).alias("hosts"), pick(["TLSv1.0", "TLSv1.1", "TLSv1.2", None], k % 4).alias("protocol"),
        F.when(k % 5 == 0, "TLS_RSA_WITH_3DES_EDE_CBC_SHA").otherwise("TLS_AES_256_GCM_SHA384").alias("suite"), F.when(k % 7 == 0, "mlkem768x25519-sha256").otherwise("curve25519-sha256").alias("kex"),
    )
    said = written(declared(spark, sf_dir).withColumn("exposure", F.lit(None).cast("string")), "declared")
    found = drift.tls_protocol(seen, said).unionByName(drift.weak_cipher(seen, said)).unionByName(drift.missing_hybrid(seen, said))
    return found.groupBy("rule", "subject", "declared", "observed").agg(F.min("asset_id").alias("asset_id"))


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
