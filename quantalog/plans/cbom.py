"""Queries on documents of components: export, validation, conformance and the way back, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import cbom
from quantalog.sources.estate import pick, spread, table

QUERIES: dict[str, tuple] = {}
AT = "2026-09-01T00:00:00Z"
#: Assets of a task; their components take some hundred times the bytes of their keys.
ASSETS = 25_000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset for each part: a certificate, a stored key, a TLS suite, an SSH server, a library, a hash in code."""
    p = F.col("p_partkey")
    n = p.cast("string")
    of = lambda *values: pick(list(values), p % 6)
    only = lambda k, value: F.when(p % 6 == k, value)
    return spread(table(spark, sf_dir, "part").select("p_partkey"), ASSETS).select(
        F.concat(F.lit("a"), n).alias("id"), F.concat(F.lit("asset "), n).alias("name"), of("RSA", "AES", "X25519", "DH", None, "MD5").alias("algorithm"), of(2048, 256, None, 2048, None, None).cast("int").alias("key_size"),
        of(None, "gcm", None, None, None, None).alias("mode"), only(1, F.lit("NoPadding")).alias("padding"), of("signing", "encryption", "key_exchange", "key_exchange", None, "hashing").alias("usage"),
        of("tls_certificate", "generic_key", "tls_key_exchange", "ssh_key", "crypto_library", "source").alias("asset_class"), of("keystore", "keystore", "tls", "ssh", "dependency", "source").alias("source_type"), F.concat(F.lit("h"), n, F.lit(":443")).alias("source_location"),
        only(2, F.lit("TLSv1.3 TLSv1.2")).alias("protocol"), only(2, F.lit("ECDHE-RSA-AES256-GCM-SHA384")).alias("cipher_suite"), only(0, F.concat(F.lit("CN=h"), n)).alias("cert_subject"), only(0, F.lit("CN=ca")).alias("cert_issuer"), only(0, n).alias("cert_serial"),
        only(0, F.lit("2025-01-01 00:00:00")).alias("not_before"), only(0, F.when(p % 4 == 0, "2026-01-01 00:00:00").otherwise("2027-01-01 00:00:00")).alias("not_after"), only(1, F.concat(F.lit("k"), n)).alias("key_id"), only(1, F.lit("PendingDeletion")).alias("state"),
        F.lit(None).cast("string").alias("created"), only(4, F.lit("npm")).alias("ecosystem"), only(4, F.lit("@noble/curves")).alias("package"), only(4, F.concat(F.lit("1."), (p % 5).cast("string"))).alias("version"), F.create_map(F.lit("rank"), n, F.lit("owner"), F.lit("o")).alias("properties"),
    )


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cbom.components(assets(spark, sf_dir), AT)


# What the SQL knows by itself: the references of an asset, and a component of each kind as text.
_OWN = "'crypto:' || substr(sha256('{}|a' || p), 1, 24)"
_ALGORITHM = '{{"bom-ref":"{ref}","cryptoProperties":{{"algorithmProperties":{{"certificationLevel":["none"],{bits}"cryptoFunctions":[{does}],"executionEnvironment":"software-plain-ram","implementationPlatform":"generic",{mode}"nistQuantumSecurityLevel":{level},{size}"primitive":"{primitive}"}},"assetType":"algorithm"}},"name":"{name}","properties":[{props}],"type":"cryptographic-asset"}}'
_PROPS, _PART = '{{"name":"owner","value":"o"}},{{"name":"rank","value":"@p"}}', '{{"name":"suite-part-of","value":"@alg"}}'


def _line(name, primitive, does, bits, level, size="", mode="", props=_PROPS, ref="@alg"):
    bits = f'"classicalSecurityLevel":{bits},' if bits is not None else ""
    does = ",".join(f'"{d}"' for d in does.split())
    return _ALGORITHM.format(ref=ref, bits=bits, does=does, mode=mode, level=level, size=size, primitive=primitive, name=name, props=props.format())


_SIZED = '"parameterSetIdentifier":"{}",'
_COMPONENTS = [  # k, kind, reference, depends, line
    (0, "algorithm", "@alg", "", _line("RSA-2048", "pke", "sign verify", 112, 0, _SIZED.format(2048))),
    (0, "related-crypto-material", "@mat", "@alg", '{"bom-ref":"@mat","cryptoProperties":{"assetType":"related-crypto-material","relatedCryptoMaterialProperties":{"activationDate":"2025-01-01T00:00:00Z","algorithmRef":"@alg","expirationDate":"@end-01-01T00:00:00Z","size":2048,"state":"@state","type":"private-key"}},"name":"asset @p (key material)","type":"cryptographic-asset"}'),
    (0, "certificate", "@cer", "@two", '{"bom-ref":"@cer","cryptoProperties":{"assetType":"certificate","certificateProperties":{"certificateExtension":"crt","certificateFormat":"X.509","issuerName":"CN=ca","notValidAfter":"@end-01-01T00:00:00Z","notValidBefore":"2025-01-01T00:00:00Z","serialNumber":"@p","signatureAlgorithmRef":"@alg","subjectName":"CN=h@p","subjectPublicKeyRef":"@mat"}},"name":"CN=h@p","type":"cryptographic-asset"}'),
    (1, "algorithm", "@alg", "", _line("AES-256-GCM", "block-cipher", "encrypt decrypt", 256, 5, '"padding":"raw",' + _SIZED.format(256), '"mode":"gcm",')),
    (1, "related-crypto-material", "@mat", "@alg", '{"bom-ref":"@mat","cryptoProperties":{"assetType":"related-crypto-material","relatedCryptoMaterialProperties":{"algorithmRef":"@alg","id":"k@p","size":256,"state":"deactivated","type":"secret-key"}},"name":"asset @p (key material)","type":"cryptographic-asset"}'),
    (2, "algorithm", "@alg", "", _line("X25519", "key-agree", "keygen encapsulate decapsulate", 128, 0)),
    (2, "algorithm", "@kex", "", _line("ECDHE", "key-agree", "keygen keyderive", 128, 0, props=_PART, ref="@kex")),
    (2, "algorithm", "@aut", "", _line("RSA", "pke", "encrypt decrypt", None, 0, props=_PART, ref="@aut")),
    (2, "algorithm", "@cip", "", _line("AES-256-GCM", "block-cipher", "encrypt decrypt", 256, 5, _SIZED.format(256), '"mode":"gcm",', props=_PART, ref="@cip")),
    (2, "algorithm", "@mac", "", _line("SHA-384", "hash", "digest", 192, 4, props=_PART, ref="@mac")),
    (2, "protocol", "@pro", "@all", '{"bom-ref":"@pro","cryptoProperties":{"assetType":"protocol","protocolProperties":{"cipherSuites":[{"algorithms":["@kex","@aut","@cip","@mac"],"name":"ECDHE-RSA-AES256-GCM-SHA384"}],"cryptoRefArray":[@list],"type":"tls","version":"1.2"}},"name":"asset @p","type":"cryptographic-asset"}'),
    (3, "algorithm", "@alg", "", _line("Diffie-Hellman", "key-agree", "keygen encapsulate decapsulate", 112, 0, _SIZED.format(2048))),
    (3, "protocol", "@pro", "@alg", '{"bom-ref":"@pro","cryptoProperties":{"assetType":"protocol","protocolProperties":{"cryptoRefArray":["@alg"],"type":"ssh"}},"name":"asset @p","type":"cryptographic-asset"}'),
    (4, "library", "@lib", "", '{"bom-ref":"@lib","name":"@noble/curves","properties":[{"name":"owner","value":"o"},{"name":"rank","value":"@p"}],"purl":"pkg:npm/%40noble/curves@1.@five","type":"library","version":"1.@five"}'),
    (5, "algorithm", "@alg", "", _line("MD5", "hash", "digest", 0, 0)),
]
_ROWS = ", ".join("({}, '{}', '{}', '{}', '{}')".format(*c) for c in _COMPONENTS)
_MARKS = {"@alg": "alg", "@mat": "mat", "@cer": "cer", "@pro": "pro", "@lib": "lib", "@kex": "kex", "@aut": "aut", "@cip": "cip", "@mac": "mac", "@two": "array_to_string(list_sort([alg, mat]), ' ')", "@all": "array_to_string(list_sort([alg, kex, aut, cip, mac]), ' ')",
          "@list": """'"' || array_to_string(list_sort([alg, kex, aut, cip, mac]), '","') || '"'""", "@end": "CASE WHEN p % 4 = 0 THEN '2026' ELSE '2027' END", "@state": "CASE WHEN p % 4 = 0 THEN 'deactivated' ELSE 'active' END", "@five": "CAST(p % 5 AS VARCHAR)", "@p": "CAST(p AS VARCHAR)"}


def _filled(column: str) -> str:
    for mark, value in _MARKS.items():
        column = f"replace({column}, '{mark}', {value})"
    return column


_REFS_SQL = f"""r AS (SELECT p_partkey AS p, {_OWN.format('algorithm')} AS alg, {_OWN.format('material')} AS mat, {_OWN.format('certificate')} AS cer, {_OWN.format('protocol')} AS pro, {_OWN.format('library')} AS lib,
  'crypto:' || substr(sha256('algorithm|a' || p || '|key_exchange|ECDHE'), 1, 24) AS kex, 'crypto:' || substr(sha256('algorithm|a' || p || '|authentication|RSA'), 1, 24) AS aut, 'crypto:' || substr(sha256('algorithm|a' || p || '|cipher|AES-256'), 1, 24) AS cip, 'crypto:' || substr(sha256('algorithm|a' || p || '|mac|SHA-384'), 1, 24) AS mac FROM part)"""


@query(f"""WITH {_REFS_SQL}, c(k, kind, ref, depends, line) AS (VALUES {_ROWS})
SELECT 'a' || CAST(p AS VARCHAR) AS asset, {_filled('ref')} AS ref, kind, {_filled('depends')} AS depends, {_filled('line')} AS line FROM r JOIN c ON c.k = p % 6""")
def cbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all assets with what they depend on, each as canonical JSON."""
    return cbom.lines(made(spark, sf_dir)).select("asset", "ref", "kind", F.array_join("depends", " ").alias("depends"), "line")


# What is broken in a document, by the number of its asset: a text and what stands for it.
_BREAKS = [
    None, ('"CycloneDX"', '"Cyclone"'), ('"specVersion":"1.7"', '"specVersion":"1.5"'), ("urn:uuid:", "uuid:"), ('"version":1}', '"version":0}'), ('"timestamp":"2026-09', '"timestamp":"2026-13'), ('"primitive":"', '"primitive":"x-'), ('"assetType":"algorithm"', '"assetType":"algo"'),
    ('"nistQuantumSecurityLevel":', '"nistQuantumSecurityLevel":9'), ('"algorithmRef":"crypto:', '"algorithmRef":"lost:'), ('"type":"cryptographic-asset"', '"type":"device"'), ('"cryptoFunctions":[', '"cryptoFunctions":["spin",'), ('"notValidAfter":"2', '"notValidAfter":"x2'), ('{"bomFormat"', 'x{"bomFormat"'),
]


def texts(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    docs = cbom.documents(made(spark, sf_dir), "estate", AT, by_asset=True).select(F.col("number").alias("document"), F.col("document").alias("text"))
    text, n = F.col("text"), F.substring("document", 2, 20).cast("bigint") % len(_BREAKS)
    for i, change in enumerate(_BREAKS):
        if broken and change:
            text = F.when(n == i, F.replace(F.col("text"), *map(F.lit, change))).otherwise(text)
    return docs.select("document", text.alias("text"))


@query("""WITH n(k, algorithms, components) AS (VALUES (0, 1, 3), (1, 1, 2), (2, 5, 6), (3, 1, 2), (4, 0, 0), (5, 1, 1)), d AS (SELECT p_partkey AS p, p_partkey % 14 AS b, p_partkey % 6 AS k, algorithms, components FROM part JOIN n ON n.k = p_partkey % 6),
v AS (SELECT p, 'envelope' AS rule, CASE WHEN b = 13 THEN 4 ELSE 1 END AS n FROM d WHERE b IN (1, 2, 3, 4, 13) UNION ALL SELECT p, 'metadata', CASE WHEN b = 13 THEN 3 ELSE 1 END FROM d WHERE b IN (5, 13) UNION ALL SELECT p, 'components', 1 FROM d WHERE b = 13
  UNION ALL SELECT p, 'primitive', algorithms FROM d WHERE b = 6 UNION ALL SELECT p, 'asset_type', algorithms FROM d WHERE b = 7 UNION ALL SELECT p, 'nist_level', algorithms FROM d WHERE b = 8 UNION ALL SELECT p, 'ref_integrity', 1 FROM d WHERE b = 9 AND k IN (0, 1)
  UNION ALL SELECT p, 'component_required', components FROM d WHERE b = 10 UNION ALL SELECT p, 'crypto_functions', algorithms FROM d WHERE b = 11 UNION ALL SELECT p, 'dates', 1 FROM d WHERE b = 12 AND k = 0),
r(rule) AS (VALUES ('envelope'), ('metadata'), ('components'), ('component_required'), ('bomref_unique'), ('asset_type'), ('property_object'), ('primitive'), ('crypto_functions'), ('execution_env'), ('mode_padding'), ('material_type'), ('protocol_type'), ('certification_level'), ('nist_level'), ('dates'), ('ref_integrity'))
SELECT rule, count(p) = 0 AS passed, CAST(coalesce(sum(n), 0) AS BIGINT) AS violations, count(DISTINCT p) AS documents FROM r LEFT JOIN (SELECT * FROM v WHERE n > 0) USING (rule) GROUP BY rule""")
def cbom_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each rule in documents of which most are broken in some way."""
    return cbom.validation(texts(spark, sf_dir, broken=True)).select("rule", "passed", "violations", "documents")


# Of each kind of asset (k from 0 to 5): where an element applies, and where it is there.
_ELEMENTS = [
    ("algorithm", "Name", "115101", "115101"), ("algorithm", "Asset type", "115101", "115101"), ("algorithm", "Primitive", "115101", "115101"), ("algorithm", "Mode", "011000", "011000"), ("algorithm", "Crypto functions", "115101", "115101"), ("algorithm", "Classical security level", "115101", "114101"),
    ("related-crypto-material", "Name", "110000", "110000"), ("related-crypto-material", "Asset type", "110000", "110000"), ("related-crypto-material", "Id", "110000", "010000"), ("related-crypto-material", "State", "110000", "110000"), ("related-crypto-material", "Size", "110000", "110000"),
    ("related-crypto-material", "Creation date", "110000", "000000"), ("related-crypto-material", "Activation date", "110000", "100000"), ("protocol", "Name", "001100", "001100"), ("protocol", "Asset type", "001100", "001100"), ("protocol", "Version", "001100", "001000"), ("protocol", "Cipher suites", "001100", "001100"),
    *[("certificate", e, "100000", "100000") for e in ("Name", "Asset type", "subjectName", "issuerName", "notValidBefore", "notValidAfter", "signatureAlgorithmRef", "subjectPublicKeyRef", "certificateFormat", "certificateExtension")],
]


@query(f"""WITH e(asset_type, element, a, t) AS (VALUES {", ".join(map(str, _ELEMENTS))}), k AS (SELECT CAST(p_partkey % 6 AS INTEGER) AS k, count(*) AS n FROM part GROUP BY 1),
s AS (SELECT asset_type, element, CAST(sum(n * CAST(substr(a, k + 1, 1) AS INTEGER)) AS BIGINT) AS applicable, CAST(sum(n * CAST(substr(t, k + 1, 1) AS INTEGER)) AS BIGINT) AS present FROM e, k GROUP BY ALL) SELECT *, round(100.0 * present / applicable, 1) AS percent FROM s""")
def cbom_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that components of each type should have, and how many have them."""
    return cbom.conformance(texts(spark, sf_dir, broken=False)).select("asset_type", "element", "applicable", "present", "percent")


@query(f"""WITH {_REFS_SQL} SELECT CASE p % 6 WHEN 4 THEN lib ELSE alg END AS ref, CAST(p AS VARCHAR) AS rank, CASE p % 6 WHEN 0 THEN 'RSA-2048' WHEN 1 THEN 'AES-256-GCM' WHEN 2 THEN 'X25519' WHEN 3 THEN 'Diffie-Hellman' WHEN 5 THEN 'MD5' END AS algorithm,
  CAST(CASE p % 6 WHEN 0 THEN 2048 WHEN 1 THEN 256 WHEN 3 THEN 2048 END AS INTEGER) AS key_size, CASE p % 6 WHEN 1 THEN 'gcm' END AS mode, CASE p % 6 WHEN 1 THEN 'k' || p END AS key_id, CASE p % 6 WHEN 0 THEN 'CN=h' || p END AS cert_subject, CASE p % 6 WHEN 2 THEN '1.2' END AS protocol_version,
  CASE p % 6 WHEN 2 THEN 'ECDHE-RSA-AES256-GCM-SHA384' END AS cipher_suite, CASE p % 6 WHEN 4 THEN '@noble/curves' END AS package, CASE p % 6 WHEN 4 THEN '1.' || (p % 5) END AS version FROM r""")
def cbom_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that come back from the documents that they were written to."""
    docs = cbom.documents(made(spark, sf_dir), "estate", AT, most=500).select(F.col("document").alias("text"))
    return cbom.assets(docs).select("ref", F.col("properties")["rank"].alias("rank"), "algorithm", "key_size", "mode", "key_id", "cert_subject", "protocol_version", "cipher_suite", "package", "version")


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
