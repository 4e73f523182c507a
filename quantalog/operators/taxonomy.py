"""What is known about named algorithms, suites and protocol versions, and the verdict on a finding over all that it names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.functions.text import algorithm_key, cipher_suite
from quantalog.operators.checkpoints import sent
from quantalog.operators.numbering import BROADCAST_ROWS

# Worst first. A break of today outranks one that waits for a quantum computer.
SEVERITY = ("classical", "shor", "grover", "unknown", "pqc")
# Key, name, primitive, verdict, classical bits, NIST quantum level, replacement. Fixed values of public standards.
FACTS = [
    ("DSA", "DSA", "signature", "shor", 112, 0, "ML-DSA-65"),
    ("DH", "Diffie-Hellman", "key-agree", "shor", 112, 0, "ML-KEM-768"),
    ("DHE", "DHE", "key-agree", "shor", 112, 0, "ML-KEM-768"),
    ("ECDHE", "ECDHE", "key-agree", "shor", 128, 0, "X25519MLKEM768 (hybrid)"),
    ("X25519", "X25519", "key-agree", "shor", 128, 0, "X25519MLKEM768 (hybrid)"),
    ("X448", "X448", "key-agree", "shor", 224, 0, "ML-KEM-1024"),
    ("ED25519", "Ed25519", "signature", "shor", 128, 0, "ML-DSA-65"),
    ("ED448", "Ed448", "signature", "shor", 224, 0, "ML-DSA-87"),
    ("AES-128", "AES-128", "block-cipher", "grover", 128, 0, "AES-256"),
    ("AES-192", "AES-192", "block-cipher", "pqc", 192, 3, None),
    ("AES-256", "AES-256", "block-cipher", "pqc", 256, 5, None),
    ("AES", "AES", "block-cipher", "grover", None, 0, None),
    ("CHACHA20", "ChaCha20", "stream-cipher", "pqc", 256, 5, None),
    ("3DES", "3DES", "block-cipher", "classical", 112, 0, "AES-256"),
    ("DES", "DES", "block-cipher", "classical", 56, 0, "AES-256"),
    ("BLOWFISH", "Blowfish", "block-cipher", "classical", 64, 0, "AES-256"),
    ("RC4", "RC4", "stream-cipher", "classical", None, 0, "AES-256-GCM"),
    ("MD5", "MD5", "hash", "classical", 0, 0, "SHA-256"),
    ("SHA-1", "SHA-1", "hash", "classical", 63, 0, "SHA-256"),
    ("SHA-224", "SHA-224", "hash", "grover", 112, 0, "SHA-256"),
    ("SHA-256", "SHA-256", "hash", "pqc", 128, 2, None),
    ("SHA-384", "SHA-384", "hash", "pqc", 192, 4, None),
    ("SHA-512", "SHA-512", "hash", "pqc", 256, 5, None),
    ("SHA3-256", "SHA3-256", "hash", "pqc", 128, 2, None),
    ("HMAC", "HMAC", "mac", "pqc", 256, 0, None),
    ("HKDF", "HKDF", "kdf", "pqc", 256, 0, None),
    ("ML-KEM-512", "ML-KEM-512", "kem", "pqc", 128, 1, None),
    ("ML-KEM-768", "ML-KEM-768", "kem", "pqc", 192, 3, None),
    ("ML-KEM-1024", "ML-KEM-1024", "kem", "pqc", 256, 5, None),
    ("ML-DSA-44", "ML-DSA-44", "signature", "pqc", 128, 2, None),
    ("ML-DSA-65", "ML-DSA-65", "signature", "pqc", 192, 3, None),
    ("ML-DSA-87", "ML-DSA-87", "signature", "pqc", 256, 5, None),
    ("ML-KEM", "ML-KEM", "kem", "pqc", 128, 1, None),
    ("ML-DSA", "ML-DSA", "signature", "pqc", 128, 2, None),
    ("SLH-DSA", "SLH-DSA", "signature", "pqc", 128, 1, None),
    ("X25519MLKEM768", "X25519MLKEM768", "kem", "pqc", 192, 3, None),
    ("SECP256R1MLKEM768", "SecP256r1MLKEM768", "kem", "pqc", 192, 3, None),
    ("SECP384R1MLKEM1024", "SecP384r1MLKEM1024", "kem", "pqc", 256, 5, None),
    ("SNTRUP761X25519", "sntrup761x25519", "kem", "pqc", 128, 0, None),
]
# Other spellings of keys. Fixed values.
ALIASES = {
    "ECC": "ECDSA",
    "EC": "ECDSA",
    "SECP256R1": "ECDSA",
    "PRIME256V1": "ECDSA",
    "P-256": "ECDSA",
    "SHA1": "SHA-1",
    "SHA224": "SHA-224",
    "SHA256": "SHA-256",
    "SHA384": "SHA-384",
    "SHA512": "SHA-512",
    "SHA-3": "SHA3-256",
    "SHA3": "SHA3-256",
    "DESEDE": "3DES",
    "TRIPLEDES": "3DES",
    "DES-EDE3": "3DES",
    "CHACHA20-POLY1305": "CHACHA20",
    "POLY1305": "CHACHA20",
    "CURVE25519": "X25519",
    "EDDSA": "ED25519",
    "KYBER": "ML-KEM-768",
    "KYBER768": "ML-KEM-768",
    "DILITHIUM": "ML-DSA-65",
    "DILITHIUM3": "ML-DSA-65",
    "SPHINCS+": "SLH-DSA",
    "SPHINCSPLUS": "SLH-DSA",
    "RSAENCRYPTION": "RSA",
    "RSASSA-PSS": "RSA",
    "MLKEM768X25519": "X25519MLKEM768",
    "MLKEM768NISTP256": "SECP256R1MLKEM768",
    "MLKEM1024NISTP384": "SECP384R1MLKEM1024",
}
# Strength by size of RSA moduli and of curves, and the curves' names. Fixed values.
RSA_BITS = {1024: 80, 2048: 112, 3072: 128, 4096: 152, 7680: 192}
CURVE_BITS = {224: 112, 256: 128, 384: 192, 521: 256}
CURVES = {224: "P-224", 256: "P-256", 384: "P-384", 521: "P-521"}
# Protocol versions, and how they are judged. Fixed values.
PROTOCOLS = {"SSLV2": "classical", "SSLV3": "classical", "TLSV1.0": "classical", "TLSV1.1": "classical", "TLSV1.2": "pqc", "TLSV1.3": "pqc"}
# Least residual bits of each band under Grover's search. Fixed values.
GROVER_BANDS = ((128, "comfortable"), (112, "adequate"), (64, "weakened"), (0, "inadequate"))
GROVER_PRIMITIVES = ("block-cipher", "stream-cipher", "ae", "mac", "kdf")
FACT_NAMES = ("canonical", "primitive", "verdict", "classical_bits", "nist_level", "replacement")
FACT = "struct<canonical:string,primitive:string,verdict:string,classical_bits:int,nist_level:int,replacement:string>"


def _map(values: dict, kind: str = "string") -> Column:
    """A constant map, told as one literal; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def _fact(canonical, primitive, verdict, bits, level, replacement) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*map(column, (canonical, primitive, verdict, bits, level, replacement))).cast(FACT)


def algorithm_facts(name: Column, size: Column) -> Column:
    """What is known about a named algorithm; size counts for RSA, curves and AES. An unknown name is no safe one."""
    plain = algorithm_key(name)
    key = F.coalesce(_map(ALIASES)[plain], plain)
    given = F.nullif(size, F.lit(0))
    modulus = F.coalesce(given, F.nullif(F.regexp_extract(key, r"(\d{3,5})", 1), F.lit("")).cast("int"))
    rsa = _fact(F.when(modulus.isNotNull(), F.concat(F.lit("RSA-"), modulus.cast("string"))).otherwise("RSA"), "pke", "shor", _map(RSA_BITS, "int")[modulus.cast("string")], 0, "ML-KEM-768 (encryption) / ML-DSA-65 (signature)")
    curve = F.coalesce(_map(CURVES)[given.cast("string")], given.cast("string"))
    signs = key == "ECDSA"
    elliptic = _fact(
        F.concat_ws("-", key, curve), F.when(signs, "signature").otherwise("key-agree"), "shor", _map(CURVE_BITS, "int")[given.cast("string")], 0, F.when(signs, "ML-DSA-65 (signature)").otherwise("ML-KEM-768 (key establishment)")
    )
    width = F.coalesce(F.nullif(F.regexp_extract(key, r"(128|192|256)", 1), F.lit("")).cast("int"), given)
    facts = _map({k: dict(zip(FACT_NAMES, rest, strict=True)) for k, *rest in FACTS}, FACT)
    aes = F.coalesce(facts[F.concat(F.lit("AES-"), width.cast("string"))], facts["AES"])
    longest = F.split(F.lit(" ".join(sorted((f[0] for f in FACTS), key=len, reverse=True))), " ")
    known = F.coalesce(facts[key], facts[F.get(F.filter(longest, lambda k: F.startswith(key, k)), F.lit(0))])
    unknown = _fact(F.when(key.isNull(), "Unknown").otherwise(F.trim(name)), "unknown", "unknown", None, 0, None)
    return F.when(key.isNull(), unknown).when(key.startswith("RSA"), rsa).when(key.isin("ECDSA", "ECDH"), elliptic).when(key.startswith("AES"), aes).otherwise(F.coalesce(known, unknown))


def protocol_verdict(version: Column) -> Column:
    """Of a protocol version by itself: what it negotiates is judged apart."""
    key = F.upper(F.regexp_replace(version, r"[\s_]+", ""))
    key = F.when(key == "TLSV1", "TLSV1.0").otherwise(key)
    longest = sorted(PROTOCOLS, key=len, reverse=True)
    found = F.get(F.filter(F.array(*map(F.lit, longest)), lambda k: F.contains(key, k)), F.lit(0))
    return F.coalesce(_map(PROTOCOLS)[found], F.lit("unknown"))


def grover(bits: Column, primitive: Column) -> Column:
    """applies, residual_bits, band. Hashes keep their bits (a collision bound already); nothing is said of asymmetric primitives."""
    applies = F.coalesce(primitive.isin(*GROVER_PRIMITIVES), F.lit(False))
    half = F.when(applies & (bits > 0), F.floor(bits / 2).cast("int"))
    band = F.lit(None).cast("string")
    for least, name in reversed(GROVER_BANDS):
        band = F.when(half >= least, name).otherwise(band)
    return F.struct(applies.alias("applies"), F.when(primitive == "hash", bits).otherwise(half).alias("residual_bits"), band.alias("band"))


def classified(findings: DataFrame) -> DataFrame:
    """findings: id, algorithm, key_size, cipher_suite, key_exchange, protocol. For each id the verdict over all that it names.

    The verdict is the worst among the components; a protocol version counts only where it is broken. Flags are told apart from
    the verdict, so none is hidden by it. Each name and each suite is looked up once, not once for each row.
    """
    named = F.col("cipher_suite") != ""
    suites = findings.where(named).select("cipher_suite").distinct().select("cipher_suite", cipher_suite(F.col("cipher_suite")).alias("suite"))
    rows = findings.join(sent(suites, "suites", BROADCAST_ROWS), "cipher_suite", "left")
    none = F.lit(None)
    parts = [
        ("algorithm", F.col("algorithm"), F.col("key_size")),
        ("key_exchange", F.col("key_exchange"), F.col("key_size")),
        ("suite_key_exchange", F.col("suite.key_exchange"), none),
        ("suite_authentication", F.col("suite.authentication"), none),
        ("suite_bulk_cipher", F.col("suite.bulk_cipher"), F.col("suite.bulk_key_bits")),
        ("suite_mac", F.col("suite.mac"), none),
    ]
    part = lambda name, size: F.when(name != "", F.struct(name.alias("name"), size.cast("int").alias("size")))
    rows = rows.select("id", "protocol", *[part(name, size).alias(role) for role, name, size in parts])
    names = rows.select(F.explode(F.array_compact(F.array(*[F.col(role) for role, _, _ in parts]))).alias("p")).select("p.name", "p.size").distinct()
    facts = sent(names.withColumn("fact", algorithm_facts(F.col("name"), F.col("size"))), "facts", BROADCAST_ROWS)
    for role, _, _ in parts:
        rows = rows.join(facts.select("name", "size", F.col("fact").alias(f"{role}_fact")), (F.col(f"{role}.name") == F.col("name")) & F.col(f"{role}.size").eqNullSafe(F.col("size")), "left").drop("name", "size")
    told = [F.when(F.col("id").isNotNull() & F.col(role).isNotNull(), F.struct(F.lit(n).alias("n"), F.lit(role).alias("role"), F.col(f"{role}_fact").alias("fact"))) for n, (role, _, _) in enumerate(parts)]
    rows = rows.select("id", "protocol", F.array_compact(F.array(*told)).alias("components"))
    # An id of several findings is told over all of them; as a rule there is none, so only such rows are gathered.
    several = sent(findings.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "several", BROADCAST_ROWS)
    of_id = rows.join(several, "id", "left_semi").groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("components"))).alias("all"))
    if not several.isEmpty():
        rows = rows.join(sent(of_id, "of_id", BROADCAST_ROWS), "id", "left").select("id", "protocol", F.coalesce("all", "components").alias("components"))
    all_ = rows.withColumn("protocol_verdict", protocol_verdict(F.col("protocol")))
    has = lambda v: F.exists("components", lambda c: c["fact"]["verdict"] == v)
    broken = has("classical") | (F.col("protocol_verdict") == "classical")
    verdict = F.lit("unknown")
    for v in reversed(SEVERITY):
        verdict = F.when(broken if v == "classical" else has(v), v).otherwise(verdict)
    first = F.get(F.filter("components", lambda c: c["fact"]["verdict"] == F.col("verdict")), F.lit(0))["fact"]
    lead = F.get("components", F.lit(0))["fact"]
    replaced = F.get(F.filter("components", lambda c: (c["fact"]["verdict"] == F.col("verdict")) & c["fact"]["replacement"].isNotNull()), F.lit(0))["fact"]["replacement"]
    judged = all_.withColumn("verdict", verdict)
    return judged.select(
        "id",
        "verdict",
        F.coalesce(first["canonical"], F.when((F.col("verdict") == "classical") & (F.col("protocol_verdict") == "classical"), F.col("protocol"))).alias("driver"),
        F.coalesce(first["primitive"], F.lit("unknown")).alias("primitive"),
        has("shor").alias("quantum_vulnerable"),
        broken.alias("classically_broken"),
        has("grover").alias("grover_weakened"),
        lead["classical_bits"].alias("classical_bits"),
        F.coalesce(lead["nist_level"], F.lit(0)).alias("nist_level"),
        replaced.alias("replacement"),
        "protocol_verdict",
        F.size("components").alias("components"),
        grover(lead["classical_bits"], F.coalesce(lead["primitive"], F.lit("unknown"))).alias("grover"),
    )
