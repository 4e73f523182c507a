"""Call sites of seven languages: algorithm, size and mode from names and arguments."""

import pytest
from pyspark.sql import functions as F

from quantalog.plans import code
from quantalog.operators import callsites

FILES = {
    "sign.py": '''import hashlib
from Crypto.Cipher import DES
k = rsa.generate_private_key(65537, key_size=3072)  # hashlib.md5(b"no")
c = ec.generate_private_key(
    ec.SECP521R1(), backend)
a = hashlib.new(name=chosen(x, [1, 2]))
b = hashlib.new("sha384", b"(,")
"""hashlib.sha1() in a text"""
t = jwt.encode({"a": (1, 2)}, key, algorithm='PS512')
s = ssl.PROTOCOL_TLSv1_1
z = AES.new(key, AES.MODE_GCM, nonce=n); y = f"{hashlib.md5(q)}"
h = hashlib . sha256 (x)
''',
    "Sign.java": '''class Sign { /* Cipher.getInstance("DES") */
  Cipher c = Cipher.getInstance("DESede/CBC/PKCS5Padding");
  Signature s = Signature.getInstance("SHA512withECDSA");
  Signature d = Signature.getInstance("SHA256");
  MessageDigest m = MessageDigest.getInstance(config.get("x", 1));
  SSLContext a = SSLContext.getInstance("SSLv3"), b = SSLContext.getInstance("TLSv1.3");
  Object o = new RSAKeyGenParameterSpec(4096, F4), p = new SecretKeySpec(raw(1, 2), "Blowfish");
  String j = build().with(k, SIG.ES384); char q = '"'; KEM e = KEM.getInstance("ML-KEM-1024");
}''',
    "sign.go": '''package p
import (
  "crypto/md5"
  "crypto/rc4"
)
// rsa.GenerateKey(r, 1024)
func f() {
  k, _ := rsa.GenerateKey(rand.Reader, 4096)
  s := md5.Sum(b); t := "des.NewCipher(x)"
  e := ecdsa.GenerateKey(elliptic.P384(), r)
  c := tls.Config{MinVersion: tls.VersionTLS11, CipherSuites: []uint16{tls.TLS_RSA_WITH_AES_128_CBC_SHA}}
  m := mlkem.GenerateKey1024()
}''',
    "sign.c": '''#include <openssl/des.h>
#include  <openssl/rc4.h>
int f(void) {
  RSA_generate_key_ex(rsa, 2048, e, NULL); EVP_aes_256_gcm();
  EVP_PKEY_Q_keygen(NULL, NULL, "RSA", (size_t) 3072);
  SSL_CTX_set_min_proto_version(ctx, SSL3_VERSION); SSL_CTX_set_min_proto_version(ctx, TLS1_2_VERSION);
  OQS_SIG_new(OQS_SIG_alg_ml_dsa_87); DES_set_key(k, s);
  EVP_PKEY_CTX_new_id(EVP_PKEY_ED25519, NULL); EC_KEY_new_by_curve_name(NID_secp384r1);
  BCryptOpenAlgorithmProvider(&h, BCRYPT_RC4_ALGORITHM, NULL, 0);
}''',
    "sign.ts": '''const a = crypto.createHash(`md5`), b = createHash("sha" + n);
crypto.generateKeyPairSync('rsa', { modulusLength: 3072, x: [1, 2] });
const c = crypto.createCipheriv("aes-192-cbc", k, iv);
await crypto.subtle.generateKey({ name: "RSASSA-PKCS1-v1_5", modulusLength: 2048 }, true, ["sign"]);
jwt.sign({ algorithm: "no" }, key, { algorithm: 'HS256' });
const e = new NodeRSA({ b: 1024 }), d = ml_kem512.keygen(); createSign("RSA-SHA1"); CryptoJS.TripleDES.encrypt(m, k);
''',
    "sign.rs": '''use md5::Md5;
use p256::ecdsa::{SigningKey, Signature};
fn f<'a>(x: &'a str) {
  let k = RsaPrivateKey::new(&mut rng, 3072); let h = Md5::new();
  let s = EphemeralPrivateKey::generate(&agreement::ECDH_P384, &rng);
  let c = Aes256Gcm::new(&key); let v = Rsa::generate::<T>(1024);
  let n = r#"Des::new(x)"#;
}''',
    "Sign.cs": '''class S { void F() {
  var a = RSA.Create(3072); var b = new RSACryptoServiceProvider(2048);
  var c = ECDsa.Create(ECCurve.NamedCurves.nistP521); var d = TripleDES.Create();
  var p = SslProtocols.Tls | SslProtocols.Tls12; var s = @"MD5.Create("; var h = HashAlgorithmName.SHA1;
} }''',
    "none.py": "print('no site')",
    "open.py": "hashlib.new('md5', [1, (2",
    "readme.txt": 'hashlib.md5("x")',
}
# file, line, algorithm, size, what else is told
SITES = [
    ("sign.py", 2, "DES", None, {"kind": "import", "confidence": 0.45}), ("sign.py", 3, "RSA", 3072, {"confidence": 0.7}), ("sign.py", 4, "ECDSA", 521, {}),
    ("sign.py", 6, None, None, {"unresolved": True, "argument": "chosen(x, [1, 2])", "confidence": 0.35}), ("sign.py", 7, "SHA-384", None, {"literal": "sha384", "confidence": 0.75}),
    ("sign.py", 9, "RSA", None, {"jose": "PS512"}), ("sign.py", 10, None, None, {"protocol": "TLSv1.1", "confidence": 0.6}), ("sign.py", 11, "AES", None, {"mode": "GCM"}), ("sign.py", 12, "SHA-256", None, {"callee": "hashlib.sha256"}),
    ("Sign.java", 2, "3DES", None, {"mode": "CBC", "padding": "PKCS5Padding"}), ("Sign.java", 3, "ECDSA", None, {"digest": "SHA-512"}), ("Sign.java", 4, None, None, {"unresolved": True, "digest": "SHA-256"}),
    ("Sign.java", 5, None, None, {"argument": 'config.get("x", 1)'}), ("Sign.java", 6, None, None, {"protocol": "SSLv3"}), ("Sign.java", 7, "RSA", 4096, {"kind": "new"}), ("Sign.java", 7, "Blowfish", None, {}),
    ("Sign.java", 8, "ECDSA", None, {"kind": "reference"}), ("Sign.java", 8, "ML-KEM-1024", None, {}),
    ("sign.go", 4, "RC4", None, {"kind": "import"}), ("sign.go", 8, "RSA", 4096, {}), ("sign.go", 9, "MD5", None, {}), ("sign.go", 10, "ECDSA", 384, {"callee": "ecdsa.GenerateKey"}), ("sign.go", 10, "ECDSA", 384, {"callee": "elliptic.P384"}),
    ("sign.go", 11, None, None, {"protocol": "TLSv1.1"}), ("sign.go", 11, None, None, {"cipher_suite": "TLS_RSA_WITH_AES_128_CBC_SHA"}), ("sign.go", 12, "ML-KEM-1024", None, {}),
    ("sign.c", 4, "RSA", 2048, {}), ("sign.c", 4, "AES-256", None, {"mode": "GCM"}), ("sign.c", 5, "RSA", 3072, {}), ("sign.c", 6, None, None, {"protocol": "SSLv3"}),
    ("sign.c", 7, "ML-DSA-87", None, {}), ("sign.c", 7, "DES", None, {"kind": "call"}), ("sign.c", 8, "Ed25519", None, {}), ("sign.c", 8, "ECDSA", 384, {}), ("sign.c", 9, "RC4", None, {"kind": "call"}),
    ("sign.ts", 1, "MD5", None, {"literal": "md5"}), ("sign.ts", 1, None, None, {"argument": '"sha" + n'}), ("sign.ts", 2, "RSA", 3072, {}), ("sign.ts", 3, "AES-192", None, {"mode": "CBC"}), ("sign.ts", 4, "RSA", 2048, {}),
    ("sign.ts", 5, "HMAC", None, {"jose": "HS256"}), ("sign.ts", 6, "RSA", 1024, {"kind": "new"}), ("sign.ts", 6, "ML-KEM-512", None, {}), ("sign.ts", 6, "RSA", None, {"digest": "SHA-1"}), ("sign.ts", 6, "3DES", None, {}),
    ("sign.rs", 2, "ECDSA", None, {"kind": "import"}), ("sign.rs", 4, "RSA", 3072, {}), ("sign.rs", 4, "MD5", None, {"kind": "call"}), ("sign.rs", 5, "ECDH", 384, {}), ("sign.rs", 6, "AES-256", None, {}), ("sign.rs", 6, "RSA", 1024, {}),
    ("Sign.cs", 2, "RSA", 3072, {"kind": "call"}), ("Sign.cs", 2, "RSA", 2048, {"kind": "new"}), ("Sign.cs", 3, "ECDSA", 521, {}), ("Sign.cs", 3, "3DES", None, {}), ("Sign.cs", 4, None, None, {"protocol": "TLSv1.0"}), ("Sign.cs", 4, "SHA-1", None, {}),
    ("open.py", 1, "MD5", None, {"literal": "md5"}),
]


def test_sites_of_seven_languages(spark):
    files = [*FILES.items(), ("null.py", None), ("sign.py", FILES["sign.py"])]
    df = spark.createDataFrame(files, "id string, text string").withColumn("language", callsites.language_of(F.col("id")))
    found = [r.asDict() for r in callsites.scan(df).collect()]
    missing = []
    for file, line, algorithm, size, more in SITES:
        same = [r for r in found if r["id"] == file and r["line"] == line and r["algorithm"] == algorithm and r["key_size"] == size and all(r[k] == v for k, v in more.items())]
        if len(same) != (2 if file == "sign.py" else 1):
            missing.append(((file, line, algorithm, size, more), [(r["algorithm"], r["key_size"], r["callee"], r["mode"], r["protocol"], r["argument"], r["digest"]) for r in found if r["id"] == file and r["line"] == line]))
    assert not missing
    assert len(found) == len(SITES) + sum(s[0] == "sign.py" for s in SITES), sorted((r["id"], r["line"], r["callee"]) for r in found)
    assert not any("raw" in str(r["argument"]) or "secret" in str(r) for r in found)


def test_nothing_to_scan(spark):
    df = spark.createDataFrame([("a.py", ""), ("b.py", None), ("c.go", "}}} ))) import \"")], "id string, text string").withColumn("language", callsites.language_of(F.col("id")))
    assert callsites.scan(df).count() == 0
    assert callsites.scan(df.limit(0)).count() == 0


def test_a_large_file(spark):
    """Ten thousand sites and deep brackets in one file."""
    text = "x = [" + "[" * 300 + "]" * 300 + "]\n" + "\n".join(f"k{i} = RSA.generate({1000 + i % 9000}, f(a, b), {{'x': [1, 2]}})" for i in range(10_000))
    df = spark.createDataFrame([("a.py", "python", text)], "id string, language string, text string")
    assert callsites.scan(df).agg(F.count("*"), F.sum("key_size"), F.max("line")).first()[:] == (10_000, sum(1000 + i % 9000 for i in range(10_000)), 10_001)


@pytest.mark.parametrize(
    ("text", "signature", "expected"),
    [
        ("AES/GCM/NoPadding", False, {"algorithm": "AES", "mode": "GCM", "padding": "NoPadding"}),
        ("SHA1withDSA", False, {"algorithm": "DSA", "digest": "SHA-1"}),
        ("A256GCM", False, {"algorithm": "AES-256", "mode": "GCM"}),
        ("des-ede3-ofb", False, {"algorithm": "3DES", "mode": "OFB"}),
        ("RS384", False, {"algorithm": "RSA", "jose": "RS384"}),
        ("ml_kem_512", False, {"algorithm": "ML-KEM-512"}),
        ("Dilithium5", False, {"algorithm": "ML-DSA-87"}),
        ("ECDH_P256", False, {"algorithm": "ECDH", "key_size": 256}),
        ("SHA512", True, {"algorithm": None, "digest": "SHA-512"}),
        ("SHA512", False, {"algorithm": "SHA-512", "digest": None}),
        ("whirl-9", False, {"algorithm": "whirl-9"}),
        ("SHA1PRNG", False, {"algorithm": None}),
    ],
)
def test_names(spark, text, signature, expected):
    found = spark.range(1).select(callsites.algorithm_name(F.lit(text), F.lit(signature)).alias("n")).first().n
    assert {k: found[k] for k in expected} == expected


def test_protocols(spark):
    words = {"TLSv1": "TLSv1.0", "TLS1_1_VERSION": "TLSv1.1", "'Tls'": "TLSv1.0", "TLS": None, "SSL30": "SSLv3", "Tls12": None, "sslv2": "SSLv2", "": None}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", callsites.protocol_name(F.col("w")).alias("p")).collect()
    assert {r.w: r.p for r in rows} == words


def test_files_are_dealt(spark, monkeypatch):
    """Files are scanned in as many tasks as their number asks for, also where one file holds the table."""
    monkeypatch.setattr(code, "FILES", 10)
    files = code.code_files(spark, "/root/testdata/sf0.001")
    assert len(files.inputFiles()) == 20 and files.count() == 200
