"""Queries on what source files, packages and binaries use, each beside its SQL, which states the expected facts by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import callsites, libraries
from quantalog.operators.checkpoints import written
from quantalog.sources.estate import pick, pick_sql, spread, table

QUERIES: dict[str, tuple] = {}
#: Files that a task cuts into tokens.
FILES = 2_500


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# A file for each document, in the language of its number: the text stands in a comment and in a string, before some calls. {size}
# and {name} change from file to file.
_CODE = [
    ("py", '# {text}\nimport hashlib\nkey = rsa.generate_private_key(65537, key_size={size})\nmark = hashlib.new({name}, data(1, 2))\ncontext = ssl.SSLContext(ssl.PROTOCOL_TLSv1)  # hashlib.md5()\nnote = "{text} hashlib.sha1()"\n', '"sha384"', "chosen(1, 2)"),
    ("java", '/* {text} */\nclass A {\n  Cipher c = Cipher.getInstance({name});\n  Object o = new RSAKeyGenParameterSpec({size}, RSAKeyGenParameterSpec.F4);\n  String s = "{text} MD5";\n  SSLContext a = SSLContext.getInstance("TLSv1.1"), b = SSLContext.getInstance("TLS");\n}\n', '"DESede/CBC/PKCS5Padding"', "cipher"),
    ("go", '// {text}\nimport (\n  "crypto/md5"\n  "crypto/des"\n)\nfunc f() {\n  k, _ := rsa.GenerateKey(rand.Reader, {size})\n  h := md5.New({name})\n  c := tls.Config{MinVersion: tls.VersionTLS10}\n}\n', "", "x"),
    ("c", '/* {text} */\n#include <openssl/rc4.h>\nint f(void) {\n  RSA_generate_key_ex(rsa, {size}, e, NULL);\n  const char *s = "{text} MD5()";\n  EVP_aes_256_gcm(); OQS_KEM_new({name});\n}\n', "OQS_KEM_alg_ml_kem_768", "wanted"),
    ("ts", '// {text}\nconst a = crypto.generateKeyPairSync("rsa", {{ modulusLength: {size}, list: [1, 2] }});\nconst b = crypto.createCipheriv({name}, key, iv);\nconst s = "{text} createHash(1)";\nconst t = jwt.sign({{ a: 1 }}, key, {{ algorithm: "ES256" }});\n', '"aes-192-cbc"', "config.cipher"),
    ("rs", '/* {text} */\nuse des::Des;\nfn f() {\n  let k = RsaPrivateKey::new(&mut rng, {size});\n  let s = "{text} Md5::new()";\n  let h = Md5::new({name});\n}\n', "", "x"),
    ("cs", '/* {text} */\nclass S {\n  var a = RSA.Create({size});\n  var s = "{text} MD5.Create()";\n  var c = ECDsa.Create({name});\n  var p = SslProtocols.Tls11;\n}\n', "ECCurve.NamedCurves.nistP384", "curve"),
]
# k (of the document's number), n (0: named, 1: chosen elsewhere, null: both), line, kind, callee, algorithm, size (-1: as written), mode, protocol
_FACTS = """(0, NULL, 3, 'call', 'rsa.generate_private_key', 'RSA', -1, NULL, NULL), (0, 0, 4, 'call', 'hashlib.new', 'SHA-384', NULL, NULL, NULL), (0, 1, 4, 'call', 'hashlib.new', NULL, NULL, NULL, NULL),
(0, NULL, 5, 'reference', 'ssl.PROTOCOL_TLSv1', NULL, NULL, NULL, 'TLSv1.0'), (1, 0, 3, 'call', 'Cipher.getInstance', '3DES', NULL, 'CBC', NULL), (1, 1, 3, 'call', 'Cipher.getInstance', NULL, NULL, NULL, NULL),
(1, NULL, 4, 'new', 'RSAKeyGenParameterSpec', 'RSA', -1, NULL, NULL), (1, NULL, 6, 'call', 'SSLContext.getInstance', NULL, NULL, NULL, 'TLSv1.1'), (2, NULL, 4, 'import', 'crypto/des', 'DES', NULL, NULL, NULL),
(2, NULL, 7, 'call', 'rsa.GenerateKey', 'RSA', -1, NULL, NULL), (2, NULL, 8, 'call', 'md5.New', 'MD5', NULL, NULL, NULL), (2, NULL, 9, 'reference', 'tls.VersionTLS10', NULL, NULL, NULL, 'TLSv1.0'),
(3, NULL, 2, 'import', '#include<openssl/rc4.h>', 'RC4', NULL, NULL, NULL), (3, NULL, 4, 'call', 'RSA_generate_key_ex', 'RSA', -1, NULL, NULL), (3, NULL, 6, 'call', 'EVP_aes_256_gcm', 'AES-256', NULL, 'GCM', NULL),
(3, 0, 6, 'call', 'OQS_KEM_new', 'ML-KEM-768', NULL, NULL, NULL), (3, 1, 6, 'call', 'OQS_KEM_new', NULL, NULL, NULL, NULL), (4, NULL, 2, 'call', 'crypto.generateKeyPairSync', 'RSA', -1, NULL, NULL),
(4, 0, 3, 'call', 'crypto.createCipheriv', 'AES-192', NULL, 'CBC', NULL), (4, 1, 3, 'call', 'crypto.createCipheriv', NULL, NULL, NULL, NULL), (4, NULL, 5, 'call', 'jwt.sign', 'ECDSA', NULL, NULL, NULL),
(5, NULL, 2, 'import', 'use des::Des', 'DES', NULL, NULL, NULL), (5, NULL, 4, 'call', 'RsaPrivateKey::new', 'RSA', -1, NULL, NULL), (5, NULL, 6, 'call', 'Md5::new', 'MD5', NULL, NULL, NULL),
(6, NULL, 3, 'call', 'RSA.Create', 'RSA', -1, NULL, NULL), (6, 0, 5, 'call', 'ECDsa.Create', 'ECDSA', 384, NULL, NULL), (6, 1, 5, 'call', 'ECDsa.Create', 'ECDSA', NULL, NULL, NULL), (6, NULL, 6, 'reference', 'SslProtocols.Tls11', NULL, NULL, NULL, 'TLSv1.1')"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text."""
    i = F.col("doc_id")
    plain = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/|//|\\", " "), "\n\r\"", "   ")
    named = (F.floor(i / 7) % 2) == 0

    def filled(code: str, first: str, other: str) -> Column:
        out = F.lit(code.replace("{{", "{").replace("}}", "}"))
        for mark, value in (("{size}", (1024 * (1 + i % 4)).cast("string")), ("{name}", F.when(named, first).otherwise(other)), ("{text}", plain)):
            out = F.replace(out, F.lit(mark), value)
        return out

    text = reduce(lambda rest, k: F.when(i % 7 == k, filled(*_CODE[k][1:])).otherwise(rest), range(7), F.lit(None).cast("string"))
    # Written once they are dealt: the filters of the scan would be worked out before the deal, where one task has a whole file of the table.
    dealt = written(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), FILES), "files")
    return dealt.select(F.concat(i.cast("string"), F.lit("."), pick([c[0] for c in _CODE], i % 7)).alias("path"), text.alias("text"))


@query(f"""WITH f(k, n, line, kind, callee, algorithm, size, mode, protocol) AS (VALUES {_FACTS})
SELECT CAST(doc_id AS VARCHAR) || '.' || {pick_sql([c[0] for c in _CODE], "doc_id % 7")} AS path, CAST(line AS BIGINT) AS line, kind, callee, algorithm, CAST(CASE WHEN size = -1 THEN 1024 * (1 + doc_id % 4) ELSE size END AS INTEGER) AS key_size, mode, protocol,
  algorithm IS NULL AND protocol IS NULL AS unresolved FROM documents JOIN f ON k = doc_id % 7 AND (n IS NULL OR n = (doc_id // 7) % 2)""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, references and imports in files of seven languages, with algorithm, size and mode from names and arguments."""
    files = code_files(spark, sf_dir).select(F.col("path").alias("id"), callsites.language_of(F.col("path")).alias("language"), "text")
    return callsites.scan(files).select(F.col("id").alias("path"), F.col("line").cast("bigint").alias("line"), "kind", "callee", "algorithm", "key_size", "mode", "protocol", "unresolved")


@query(f"""WITH f(k, n, line, kind, callee, algorithm, size, mode, protocol) AS (VALUES {_FACTS}), s AS (SELECT k, algorithm FROM documents JOIN f ON k = doc_id % 7 AND (n IS NULL OR n = (doc_id // 7) % 2))
SELECT {pick_sql(["python", "java", "go", "c", "javascript", "rust", "csharp"], "k")} AS language, coalesce(algorithm, '(none)') AS algorithm, count(*) AS sites FROM s GROUP BY ALL""")
def algorithms_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each language uses each algorithm."""
    files = code_files(spark, sf_dir).select(F.col("path").alias("id"), callsites.language_of(F.col("path")).alias("language"), "text")
    return callsites.scan(files).groupBy("language", F.coalesce("algorithm", F.lit("(none)")).alias("algorithm")).agg(F.count("*").alias("sites"))


# Packages of parts: ecosystem, name as it is written, version ({a} to {c} change).
_PACKAGES = [
    ("deb", "libssl3", "3.{a}.{b}-1~deb12u2"), ("maven", "org.bouncycastle:bcprov-jdk18on", "1.{c}"), ("nuget", "bouncycastle.cryptography", "2.4.0"), ("pypi", "Python_Jose", "3.3.0"), ("npm", "@noble/Curves", "1.2.0"),
    ("runtime", "go-stdlib", "go1.{d}"), ("pypi", "oqs", None), ("cargo", "rsa", "0.9"), ("npm", "left-pad", "1.3.0"), ("npm", "bcrypt", "5.1"),
]


def package_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    version = pick([x[2] for x in _PACKAGES], p % 10)
    for mark, value in (("{a}", p % 8), ("{b}", p % 3), ("{c}", 75 + p % 9), ("{d}", 20 + p % 8)):
        version = F.replace(version, F.lit(mark), value.cast("string"))
    exact = F.coalesce(p % 4 != 0, F.lit(False))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), (F.floor(p / 10) % 60).cast("string"), F.lit("/"), F.when(exact, "lock").otherwise("list")).alias("path"), pick([x[0] for x in _PACKAGES], p % 10).alias("ecosystem"), pick([x[1] for x in _PACKAGES], p % 10).alias("name"),
        F.when(exact, version).alias("version"), F.when(~exact, F.lit(">=1")).alias("spec"), exact.alias("exact"), (p % 3 == 0).alias("direct"), p.alias("pos"),
    )


@query("""WITH s AS (SELECT p_partkey AS p, p_partkey % 10 AS k, 'm' || CAST((p_partkey // 10) % 60 AS VARCHAR) AS project, p_partkey % 4 <> 0 AS exact FROM part WHERE p_partkey % 10 <> 8),
b AS (SELECT project, k, arg_max(p, struct_pack(a := exact, b := p % 3 = 0, c := -p)) AS p, count(DISTINCT exact) AS manifests FROM s GROUP BY project, k),
n(k, ecosystem, package, library, display) AS (VALUES (0, 'deb', 'libssl3', 'openssl', 'libssl3'), (1, 'maven', 'org.bouncycastle:bcprov-jdk18on', 'bouncycastle', 'org.bouncycastle:bcprov-jdk18on'), (2, 'nuget', 'bouncycastle.cryptography', 'bouncycastle', 'bouncycastle.cryptography'), (3, 'pypi', 'python-jose', 'jwt-libraries', 'Python_Jose'),
  (4, 'npm', '@noble/curves', 'classical-only-js', '@noble/Curves'), (5, 'runtime', 'go-stdlib', 'go-stdlib', 'Go standard library'), (6, 'pypi', 'oqs', 'liboqs', 'oqs'), (7, 'cargo', 'rsa', 'classical-only-rust', 'rsa'), (9, 'npm', 'bcrypt', 'symmetric-only', 'bcrypt')),
v AS (SELECT *, CASE WHEN p % 4 <> 0 THEN CASE k WHEN 0 THEN '3.' || (p % 8) || '.' || (p % 3) || '-1~deb12u2' WHEN 1 THEN '1.' || (75 + p % 9) WHEN 2 THEN '2.4.0' WHEN 3 THEN '3.3.0' WHEN 4 THEN '1.2.0' WHEN 5 THEN 'go1.' || (20 + p % 8) WHEN 7 THEN '0.9' WHEN 9 THEN '5.1' END END AS version,
  CASE WHEN k IN (6, 9) THEN true WHEN k IN (4, 7) THEN false WHEN p % 4 = 0 THEN NULL WHEN k = 0 THEN p % 8 >= 5 WHEN k = 1 THEN p % 9 >= 4 WHEN k = 5 THEN p % 8 >= 4 END AS capable FROM b)
SELECT project, ecosystem, package, library, version, manifests, capable, CASE WHEN k = 0 THEN '3.5.0' WHEN k = 1 THEN '1.79' WHEN k = 5 THEN '1.24' WHEN k IN (6, 9) THEN 'any' WHEN k IN (4, 7) THEN 'never' END AS since,
  CASE WHEN k = 9 THEN 'no public keys' WHEN k = 6 THEN 'post-quantum' WHEN k IN (4, 7) THEN 'only classical' WHEN k IN (2, 3) THEN 'no release is known' WHEN capable IS NULL THEN 'version not known' WHEN capable THEN 'from this release on' ELSE 'before that release' END AS reason,
  CASE WHEN p % 4 <> 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS confidence, display || ' ' || coalesce(version, CASE WHEN p % 4 = 0 THEN '>=1 (range)' END, '(version unknown)') || ' (' || ecosystem || ')' AS display,
  CASE WHEN capable THEN 'pqc' WHEN NOT capable THEN 'shor' ELSE 'unknown' END AS verdict, coalesce(NOT capable, false) AS quantum_vulnerable,
  CASE WHEN capable THEN NULL WHEN k = 0 THEN 'OpenSSL 3.5 LTS' WHEN k IN (1, 2) THEN 'bcprov 1.79 or later' WHEN k = 4 THEN 'Add @noble/post-quantum or a liboqs binding' WHEN k = 5 THEN 'Go 1.24 or later' WHEN k = 7 THEN 'Add the RustCrypto ml-kem / ml-dsa crates' END AS replacement FROM v JOIN n USING (k)""")
def library_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known libraries of each project by their most precise sighting, and whether their version can do without classical public keys."""
    return libraries.library_findings(package_sightings(spark, sf_dir), libraries.KnowledgeBase(spark))


_FILES = ["/usr/lib/libssl.so.3", "C:/Windows/BCRYPT.dll", "libssl-1_1-x64.dll", "libsslx.so", "opt/libcrypto", "oqsprovider.so", "wolfssl_fips.a", "ncrypt.dll.mui", "libgnutls30", "Security.framework"]


@query(f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 10 AS k, {pick_sql(_FILES, "s_suppkey % 10")} AS file FROM supplier)
SELECT id, file, CASE k WHEN 0 THEN 'openssl' WHEN 1 THEN 'windows-cng' WHEN 2 THEN 'openssl' WHEN 4 THEN 'openssl' WHEN 5 THEN 'liboqs' WHEN 6 THEN 'wolfssl' WHEN 7 THEN 'windows-cng' WHEN 9 THEN 'apple-security' END AS library FROM s WHERE k NOT IN (3, 8)""")
def linked_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known libraries by the names of linked files."""
    s = F.col("s_suppkey")
    return libraries.linked_files(table(spark, sf_dir, "supplier").select(s.alias("id"), pick(_FILES, s % 10).alias("file")), libraries.KnowledgeBase(spark)).select("id", "file", "library")


@query("""WITH d AS (SELECT doc_id AS id, doc_id % 9 AS a FROM documents), b AS (
  SELECT id, 'openssl' AS library, '3.' || a || '.1' || CASE WHEN a = 1 THEN 'w' ELSE '' END AS version FROM d WHERE a <> 0 UNION ALL SELECT id, 'go-stdlib', '1.' || (20 + a) FROM d WHERE a <> 0 UNION ALL SELECT id, 'boringssl', NULL FROM d WHERE a = 2)
SELECT id, library, version, CASE library WHEN 'openssl' THEN CAST(substr(version, 3, 1) AS INTEGER) >= 5 WHEN 'go-stdlib' THEN CAST(substr(version, 3) AS INTEGER) >= 24 END AS capable FROM b""")
def library_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries by the banners in texts, with their readiness."""
    a = F.col("doc_id") % 9
    n = a.cast("string")
    banner = F.concat(F.lit(" OpenSSL 3."), n, F.when(a == 1, ".1w").otherwise(".1"), F.lit(" 7 Feb, go1."), (20 + a).cast("string"), F.when(a == 2, " BoringSSL").otherwise(""), F.lit(" xgo1.22y"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.when(a != 0, banner).otherwise("")).alias("text"))
    base = libraries.KnowledgeBase(spark)
    return libraries.with_readiness(libraries.banners(docs, base).withColumn("ecosystem", F.lit(None).cast("string")), base).select("id", "library", "version", "capable")


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
