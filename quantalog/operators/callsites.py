"""Cryptographic call sites in source code: tokens as rows, balanced arguments by windows, rules as a table.

A file is cut into tokens that cover all of it, so a name in a comment or in a string is no site. Brackets and commas of the same
depth are numbered by the opening ones before them: such a group holds an opening bracket, the commas between its arguments
and its closing one, whatever stands nested inside. What a site calls is met with the rules of its language (the first rule
wins), and a rule's sources say where algorithm, size and mode are: in the name itself or in an argument. What isn't written
down as a literal is told as unresolved, never guessed. An import counts only where no site of the file uses its algorithm.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import written

LANGUAGES = {
    "py": "python", "pyw": "python", "java": "java", "go": "go", "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "mts": "javascript", "tsx": "javascript",
    "rs": "rust", "cs": "csharp",
}

# Public programming interfaces for cryptography: language, kind, name of what is called, referred to or imported (a pattern for the
# end of the name), algorithm, usage, and where values stand. An algorithm of $1 is the pattern's first group. algorithm, protocol,
# suite, size and mode name a source: an argument's number, =keyword, .property of an object, /pattern/ within it, or $group. Fixed values.
RULES = r"""
python call hashlib\.(md5|sha1|sha224|sha256|sha384|sha512) $1 hashing
python call hashlib\.new - hashing algorithm=0,=name
python call rsa\.generate_private_key RSA signing size=1,=key_size
python call ec\.generate_private_key ECDSA signing size=0,=curve,/SECP(\d+)[RK]1/
python call dsa\.generate_private_key DSA signing size=0,=key_size
python call dh\.generate_parameters DH key_exchange size=1,=key_size
python call (Ed25519|Ed448)PrivateKey\.generate $1 signing
python call (X25519|X448)PrivateKey\.generate $1 key_exchange
python call (?:AESGCM|AESCCM|AESOCB3|AESSIV|AESGCMSIV|algorithms\.AES(?:128|256)?) AES encryption
python call (?:ChaCha20Poly1305|algorithms\.ChaCha20) ChaCha20 encryption
python call (?:algorithms\.)?TripleDES 3DES encryption
python call (?:algorithms\.)?Blowfish Blowfish encryption
python call (?:algorithms\.)?ARC4 RC4 encryption
python call hashes\.(MD5|SHA1) $1 hashing
python call Fernet AES-128 encryption
python call RSA\.generate RSA signing size=0,=bits
python call ECC\.generate ECDSA signing size=-,=curve,/(\d{3})/
python call DSA\.generate DSA signing size=0
python call (DES3|DES|ARC4|Blowfish)\.new $1 encryption
python call AES\.new AES encryption mode=1,/MODE_(\w+)/
python call (MD5|SHA1)\.new $1 hashing
python call rsa\.newkeys RSA signing size=0
python call RSAKey\.generate RSA signing size=0,=bits
python call (?:ECDSAKey|ecdsa\.SigningKey)\.generate ECDSA signing
python call DSSKey\.generate DSA signing
python call jwt\.encode - signing algorithm=2,=algorithm
python call KeyEncapsulation - key_exchange algorithm=0
python call oqs\.Signature - signing algorithm=0
python reference ssl\.PROTOCOL_(SSLv2|SSLv3|TLSv1|TLSv1_1) - encryption protocol=$1
python reference ssl\.TLSVersion\.(SSLv3|TLSv1|TLSv1_1) - encryption protocol=$1
python import from\sCrypto(?:dome)?\.Cipher\simport\s.*\bDES\b.* DES encryption
python import from\sCrypto(?:dome)?\.Hash\simport\s.*\bMD5\b.* MD5 hashing
java call Cipher\.getInstance - encryption algorithm=0
java call MessageDigest\.getInstance - hashing algorithm=0
java call Signature\.getInstance - signing algorithm=0,signature
java call (?:KeyPairGenerator|KeyFactory)\.getInstance - signing algorithm=0
java call (?:KeyAgreement|KEM)\.getInstance - key_exchange algorithm=0
java call KeyGenerator\.getInstance - encryption algorithm=0
java call Mac\.getInstance - authentication algorithm=0
java call SecretKeyFactory\.getInstance - key_derivation algorithm=0
java call SSLContext\.getInstance - encryption protocol=0
java new RSAKeyGenParameterSpec RSA signing size=0
java new ECGenParameterSpec ECDSA signing size=0,/(\d{3})/
java new SecretKeySpec - encryption algorithm=1
java new (DES|DESede)KeySpec $1 encryption
java new RSAKeyPairGenerator RSA signing
java new ECKeyPairGenerator ECDSA signing
java new (?:MLKEM|Kyber)KeyPairGenerator ML-KEM-768 key_exchange
java new (?:MLDSA|Dilithium)KeyPairGenerator ML-DSA-65 signing
java reference (?:SignatureAlgorithm|SIG|JWSAlgorithm)\.(?:RS|PS)(?:256|384|512) RSA signing
java reference (?:SignatureAlgorithm|SIG|JWSAlgorithm)\.ES(?:256|384|512) ECDSA signing
java reference (?:SignatureAlgorithm|SIG|JWSAlgorithm)\.HS(?:256|384|512) HMAC authentication
java reference (?:SignatureAlgorithm|SIG|JWSAlgorithm)\.(?:EdDSA|Ed25519) Ed25519 signing
go call rsa\.GenerateKey RSA signing size=1
go call rsa\.(?:Sign|Verify)(?:PKCS1v15|PSS) RSA signing
go call rsa\.(?:Encrypt|Decrypt)(?:PKCS1v15|OAEP) RSA signing
go call ecdsa\.(?:GenerateKey|Sign|SignASN1|Verify|VerifyASN1) ECDSA signing size=0,/P(\d{3})/
go call elliptic\.P(224|256|384|521) ECDSA signing size=$1
go call ecdh\.P(256|384|521) ECDH key_exchange size=$1
go call ecdh\.X25519 X25519 key_exchange
go call ed25519\.(?:GenerateKey|Sign|Verify|NewKeyFromSeed) Ed25519 signing
go call dsa\.(?:GenerateKey|GenerateParameters|Sign|Verify) DSA signing
go call (md5|sha1)\.(?:New|Sum) $1 hashing
go call sha256\.(?:New|Sum256) SHA-256 hashing
go call des\.NewTripleDESCipher 3DES encryption
go call (des|rc4|aes|blowfish)\.NewCipher $1 encryption
go call chacha20poly1305\.NewX? ChaCha20 encryption
go call mlkem\.GenerateKey(768|1024) ML-KEM-$1 key_exchange
go reference tls\.Version(SSL30|TLS10|TLS11) - encryption protocol=$1
go reference tls\.X25519MLKEM768 X25519MLKEM768 key_exchange
go reference tls\.Curve(?:P256|P384|P521) ECDH key_exchange
go reference tls\.X25519 X25519 key_exchange
go reference x509\.(?:SHA1|MD5|SHA256)WithRSA(?:PSS)? RSA signing
go reference x509\.ECDSAWith(?:SHA1|SHA256|SHA384) ECDSA signing
go reference tls\.(TLS_\w+) - encryption suite=$1
go import crypto/(md5|sha1) $1 hashing
go import crypto/(des|rc4) $1 encryption
go import crypto/(rsa|ecdsa|dsa) $1 signing
go import crypto/mlkem ML-KEM-768 key_exchange
c call RSA_generate_key_ex RSA signing size=1
c call RSA_generate_key RSA signing size=0
c call RSA_(?:public_encrypt|private_decrypt|private_encrypt|public_decrypt|sign|verify|new) RSA signing
c call EC_KEY_new_by_curve_name ECDSA signing size=0,/(?:prime|secp)(\d{3})/
c call ECDSA_(?:do_)?(?:sign|verify) ECDSA signing
c call ECDH_compute_key ECDH key_exchange
c call DH_(?:new|generate_key|compute_key|generate_parameters_ex) DH key_exchange
c call DSA_(?:new|sign|verify|generate_key|generate_parameters_ex) DSA signing
c call EVP_(md5|sha1) $1 hashing
c call (MD5|SHA1)(?:_Init|_Update|_Final)? $1 hashing
c call EVP_des_ede3\w* 3DES encryption
c call EVP_des_\w+ DES encryption
c call EVP_rc4\w* RC4 encryption
c call EVP_bf_\w+ Blowfish encryption
c call EVP_aes_(128|192|256)_(\w+) AES-$1 encryption mode=$2
c call EVP_chacha20\w* ChaCha20 encryption
c call DES_ede3_(?:cbc|ecb)_encrypt 3DES encryption
c call DES_(?:set_key|set_key_checked|ecb_encrypt|ncbc_encrypt) DES encryption
c call EVP_PKEY_Q_keygen - signing algorithm=2 size=3,/(\d{3,5})/
c call EVP_PKEY_CTX_new_from_name - signing algorithm=1
c call EVP_PKEY_CTX_new_id - signing algorithm=0,/EVP_PKEY_(\w+)/
c call EVP_PKEY_CTX_set_rsa_keygen_bits RSA signing size=1
c call SSL_CTX_set_min_proto_version - encryption protocol=1,/(SSL3|TLS1(?:_1)?)_VERSION/
c call SSL_CTX_set_cipher_list - encryption suite=1
c call OQS_KEM_new - key_exchange algorithm=0,/(ml_kem_\d+|ML-KEM-\d+|kyber_\d+)/
c call OQS_SIG_new - signing algorithm=0,/(ml_dsa_\d+|ML-DSA-\d+|dilithium_\d)/
c call mbedtls_rsa_gen_key RSA signing size=3
c call mbedtls_ecdsa_genkey ECDSA signing
c call mbedtls_(md5|sha1)\w* $1 hashing
c call mbedtls_(des3|des)_\w* $1 encryption
c call wc_MakeRsaKey RSA signing size=1
c call wc_ecc_make_key(?:_ex)? ECDSA signing
c call wc_InitMd5\w* MD5 hashing
c call crypto_(?:box|kx)_keypair X25519 key_exchange
c call crypto_sign_keypair Ed25519 signing
c call BCryptOpenAlgorithmProvider - encryption algorithm=1,/BCRYPT_(\w+?)_ALGORITHM/
c import #include<openssl/(md5)\.h> $1 hashing
c import #include<openssl/(des|rc4)\.h> $1 encryption
c import #include<openssl/rsa\.h> RSA signing
c import #include<openssl/(?:ec|ecdsa)\.h> ECDSA signing
c import #include<openssl/dh\.h> DH key_exchange
javascript call createHash - hashing algorithm=0
javascript call createHmac HMAC authentication
javascript call cipher\.create(?:C|Dec)ipher - encryption algorithm=0
javascript call create(?:C|Dec)ipher(?:iv)? - encryption algorithm=0
javascript call pki\.rsa\.generateKeyPair RSA signing size=0,.bits
javascript call generateKeyPair(?:Sync)? - signing algorithm=0 size=-,.modulusLength
javascript call create(?:Sign|Verify) - signing algorithm=0,signature
javascript call (?:createDiffieHellman(?:Group)?|getDiffieHellman) DH key_exchange
javascript call createECDH ECDH key_exchange size=0,/(\d{3})/
javascript call subtle\.(?:generateKey|sign|verify|encrypt|decrypt|deriveKey|deriveBits|wrapKey) - signing algorithm=0,.name size=-,.modulusLength
javascript call subtle\.importKey - signing algorithm=2,.name
javascript call jwt\.sign - signing algorithm=2,.algorithm
javascript call md\.(md5|sha1)\.create $1 hashing
javascript call CryptoJS\.(MD5|SHA1|SHA256|DES|TripleDES|RC4|AES)(?:\.(?:en|de)crypt)? $1 encryption
javascript call ml_kem(512|768|1024)\.(?:keygen|encapsulate) ML-KEM-$1 key_exchange
javascript call ml_dsa(44|65|87)\.(?:keygen|sign) ML-DSA-$1 signing
javascript new NodeRSA RSA signing size=-,.b
javascript new (?:EC|elliptic\.ec) ECDSA signing
rust call Rsa::generate RSA signing size=0
rust call RsaPrivateKey::new RSA signing size=1
rust call EcKey::generate ECDSA signing
rust call EcGroup::from_curve_name ECDSA signing size=0,/(?:PRIME|SECP)(\d{3})/
rust call (?:Md5::new|md5::compute) MD5 hashing
rust call Sha1::new SHA-1 hashing
rust call TdesEde3::new\w* 3DES encryption
rust call Des::new\w* DES encryption
rust call Aes(128|256)Gcm::new\w* AES-$1 encryption
rust call X?ChaCha20Poly1305::new\w* ChaCha20 encryption
rust call EcdsaKeyPair::(?:generate|from)_pkcs8 ECDSA signing size=0,/P(\d{3})/
rust call Ed25519KeyPair::(?:generate|from)_pkcs8 Ed25519 signing
rust call RsaKeyPair::from_(?:pkcs8|der) RSA signing
rust call EphemeralPrivateKey::generate - key_exchange algorithm=0,/(X25519|ECDH_P256|ECDH_P384)/
rust call SigningKey::generate Ed25519 signing confidence=0.5
rust call MlKem(512|768|1024)::generate ML-KEM-$1 key_exchange
rust import use\s(md5|sha1)(?:::.*)? $1 hashing
rust import use\srsa(?:::.*)? RSA signing
rust import use\sdes(?:::.*)? DES encryption
rust import use\sp256(?:::.*)? ECDSA signing
rust import use\s(x25519|ed25519)_dalek(?:::.*)? $1 key_exchange
rust import use\sml_kem(?:::.*)? ML-KEM-768 key_exchange
csharp call RSA\.Create RSA signing size=0
csharp call ECDsa\.Create ECDSA signing size=0,/nistP(\d{3})/
csharp call ECDiffieHellman\.Create ECDH key_exchange size=0,/nistP(\d{3})/
csharp call DSA\.Create DSA signing
csharp call (MD5|SHA1)\.(?:Create|HashData) $1 hashing
csharp call (DES|TripleDES|Aes)\.Create $1 encryption
csharp call MLKem\.GenerateKey ML-KEM-768 key_exchange
csharp call MLDsa\.GenerateKey ML-DSA-65 signing
csharp call SlhDsa\.GenerateKey SLH-DSA signing
csharp new RSACryptoServiceProvider RSA signing size=0
csharp new DSACryptoServiceProvider DSA signing
csharp new (MD5|SHA1)(?:CryptoServiceProvider|Managed) $1 hashing
csharp new (DES|TripleDES)CryptoServiceProvider $1 encryption
csharp new (?:RijndaelManaged|AesManaged|AesCryptoServiceProvider) AES encryption
csharp reference SslProtocols\.(Ssl2|Ssl3|Tls|Tls11) - encryption protocol=$1
csharp reference HashAlgorithmName\.(MD5|SHA1) $1 hashing
csharp reference SecurityAlgorithms\.Rsa(?:Sha|SsaPssSha)(?:256|384|512) RSA signing
csharp reference SecurityAlgorithms\.EcdsaSha(?:256|384|512) ECDSA signing
"""
# Confidence of a kind of site, of an algorithm that stands there as a literal, and of one that is chosen elsewhere. Fixed values.
CONFIDENCE = {"call": 0.7, "new": 0.7, "reference": 0.6, "import": 0.45}
LITERAL, UNRESOLVED = 0.75, 0.35

# Names of algorithms and key types as programs write them. Fixed values.
NAMES = {
    "md4": "MD4", "md5": "MD5", "sha1": "SHA-1", "sha-1": "SHA-1", "sha224": "SHA-224", "sha-224": "SHA-224", "sha256": "SHA-256", "sha-256": "SHA-256",
    "sha384": "SHA-384", "sha-384": "SHA-384", "sha512": "SHA-512", "sha-512": "SHA-512", "sha3-256": "SHA3-256",
    "rsa": "RSA", "rsa-oaep": "RSA", "rsa-oaep-256": "RSA", "rsassa-pkcs1-v1_5": "RSA", "rsa-pss": "RSA", "rsassa-pss": "RSA", "rsa1_5": "RSA",
    "ec": "ECDSA", "ecdsa": "ECDSA", "dsa": "DSA", "dh": "DH", "diffiehellman": "DH", "ecdh": "ECDH", "ecdh-es": "ECDH", "secp256r1": "ECDSA", "secp384r1": "ECDSA",
    "secp256k1": "ECDSA", "prime256v1": "ECDSA", "x9_62_prime256v1": "ECDSA", "p-256": "ECDSA", "p-384": "ECDSA", "p-521": "ECDSA",
    "ed25519": "Ed25519", "eddsa": "Ed25519", "ed448": "Ed448", "x25519": "X25519", "xdh": "X25519", "x448": "X448",
    "hmac": "HMAC", "hkdf": "HKDF", "pbkdf2": "HKDF", "des": "DES", "3des": "3DES", "desede": "3DES", "des-ede3": "3DES", "tripledes": "3DES", "des3": "3DES",
    "rc4": "RC4", "arc4": "RC4", "arcfour": "RC4", "blowfish": "Blowfish", "bf": "Blowfish", "aes": "AES", "chacha20": "ChaCha20", "chacha20-poly1305": "ChaCha20",
    "ml-kem": "ML-KEM-768", "kyber": "ML-KEM-768", "ml-dsa": "ML-DSA-65", "dilithium": "ML-DSA-65", "slh-dsa": "SLH-DSA", "sphincs+": "SLH-DSA",
    "dilithium2": "ML-DSA-44", "dilithium3": "ML-DSA-65", "dilithium5": "ML-DSA-87",
}
JOSE = {"rs": "RSA", "ps": "RSA", "es": "ECDSA", "hs": "HMAC"}
# Old protocol versions as programs write them, in lower case without _version. Fixed values.
OLD_PROTOCOLS = {
    "SSLv2": ("sslv2", "ssl2"), "SSLv3": ("sslv3", "ssl3", "ssl30"), "TLSv1.0": ("tlsv1", "tls1", "tls10", "tlsv1.0"), "TLSv1.1": ("tlsv1.1", "tlsv1_1", "tls1_1", "tls11"),
}
#: A word that stands for a version only in this spelling.
DOTNET_TLS10 = "Tls"

SOURCE = "struct<at:int,keyword:string,property:string,pattern:string,group:int,signature:boolean>"
FIELDS = f"place int, language string, kind string, rule string, pattern string, template string, usage string, confidence double, algorithm {SOURCE}, protocol {SOURCE}, suite {SOURCE}, size {SOURCE}, mode {SOURCE}"


def _source(text: str) -> tuple:
    at = keyword = prop = pattern = group = None
    first, *rest = re.split(r",(?=[=./s])", text, maxsplit=2)
    signature = "signature" in rest
    for part in (first, *rest):
        if part.isdigit():
            at = int(part)
        elif part[0] == "$":
            group = int(part[1:])
        elif part[0] == "=":
            keyword = part[1:]
        elif part[0] == ".":
            prop = part[1:]
        elif part[0] == "/":
            pattern = part[1:-1]
    return at, keyword, prop, pattern, group, signature


def parsed(rules: str) -> list[tuple]:
    """The table that a text of rules says: a rule a line, as above."""
    out = []
    for place, line in enumerate(x for x in rules.splitlines() if x.strip()):
        language, kind, pattern, template, usage, *rest = line.split(" ")
        given = dict(x.split("=", 1) for x in rest)
        named = pattern if kind in ("import", "new") or language == "c" else rf"(?:.*(?:\.|::))?(?:{pattern})"
        confidence = float(given.get("confidence", CONFIDENCE[kind]))
        sources = [_source(given[s]) if s in given else None for s in ("algorithm", "protocol", "suite", "size", "mode")]
        out.append((place, language, kind, f"{language}/{pattern}", f"^(?:{named})$", None if template == "-" else template, usage, confidence, *sources))
    return out


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


# Tokens. Every character is in one; strings and comments are whole.
_NAME = r"[A-Za-z_$][\w$]*+(?:(?:\s*(?:\.|::|->)\s*|::<[^<>()]*>::)[A-Za-z_$][\w$]*+)*+(?:(?:::)?<[\w\s,.:&?<>\[\]]*>(?=\s*\())?"
_REST = rf"\n|[ \t\r\f]++|{_NAME}|\d[\w.]*+|(?s:.)"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\(?s:.)|[^"\\\n])*+"?', r"'(?:\\(?s:.)|[^'\\\n])*+'?", r"`[^`]*+`?"
_SLASHES = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
TOKENS = {
    "python": rf"#[^\n]*+|[A-Za-z]{{0,2}}(?:\"\"\"(?s:.*?)(?:\"\"\"|\z)|'''(?s:.*?)(?:'''|\z)|{_DOUBLE}|{_SINGLE})|{_REST}",
    "go": rf"{_SLASHES}|{_DOUBLE}|{_BACK}|'(?:\\[^\n]|[^'\\\n])'|{_REST}",
    "javascript": rf"{_SLASHES}|{_DOUBLE}|{_SINGLE}|{_BACK}|{_REST}",
    "rust": rf"{_SLASHES}|b?r#*+\"(?s:.*?)\"#*+|b?{_DOUBLE}|'(?:\\[^\n]|[^'\\\n])'|{_REST}",
    "csharp": rf"{_SLASHES}|\"\"\"(?s:.*?)\"\"\"|[$@]{{0,2}}@[$@]{{0,1}}\"(?:\"\"|[^\"])*+\"|\$?{_DOUBLE}|'(?:\\[^\n]|[^'\\\n])+'|{_REST}",
    "c": rf"{_SLASHES}|R\"\((?s:.*?)\)\"|(?:L|u8?|U)?{_DOUBLE}|'(?:\\[^\n]|[^'\\\n])+'|{_REST}",
    "java": rf"{_SLASHES}|\"\"\"(?s:.*?)\"\"\"|{_DOUBLE}|'(?:\\[^\n]|[^'\\\n])+'|{_REST}",
}
_COMMENT = r"^(?:#|//|/\*)"
_STRING = r"^(?:[A-Za-z]{0,2}|[$@]{1,3}|b?r#*)(?:\"|'|`)"


def _by_language(language: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(language == name, F.lit(value)).otherwise(out)
    return out


def tokens(files: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """files: id, language, text. (files with their key and list of tokens, solid tokens: key, language, pos, line, token). Files in which no rule can match are left out."""
    hints = {}
    for _, language, _, _, pattern, *_ in rules:
        hints.setdefault(language, []).append(pattern.removeprefix("^").removesuffix("$").replace(r"\s.*", r"\s[^\n]*").replace(r"\s", r"\s+").replace("#include<", r"#\s*include\s*<").replace(r"\.", r"\s*\.\s*").replace("(?:.*(?:\\s*\\.\\s*|::))?", ""))
    may = F.lit(False)
    for language, patterns in hints.items():
        may = may | ((F.col("language") == language) & F.col("text").rlike("|".join(patterns)))
    cut = F.regexp_extract_all("text", _by_language(F.col("language"), TOKENS), F.lit(0))
    kept = written(files.where(may).select("id", "language", F.monotonically_increasing_id().alias("key"), cut.alias("tokens")), "tokens")
    rows = kept.select("key", "language", F.posexplode("tokens").alias("pos", "token"))
    in_file = Window.partitionBy("key").orderBy("pos")
    newlines = F.length("token") - F.length(F.replace(F.col("token"), F.lit("\n"), F.lit("")))
    lined = rows.withColumn("line", 1 + F.sum(newlines).over(in_file) - newlines)
    comment = F.when(F.col("language") == "python", F.col("token").startswith("#")).otherwise(F.col("token").rlike("^(?://|/\\*)"))
    return kept, lined.where(~comment & ~F.col("token").rlike(r"^[ \t\r\f]+$"))


def arguments(solid: DataFrame) -> DataFrame:
    """key, open, edges: for every round bracket its place, and the places of the commas of its own depth and of its closing bracket, in order."""
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    marks = solid.where(opens | closes | (F.col("token") == ",")).select("key", "pos", "token", opens.alias("opens"), closes.alias("closes"))
    depth = F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(Window.partitionBy("key").orderBy("pos"))
    level = marks.withColumn("level", depth + F.col("closes").cast("int"))
    same = level.withColumn("group", F.count_if("opens").over(Window.partitionBy("key", "level").orderBy("pos")))
    found = same.groupBy("key", "level", "group").agg(F.min_by("token", "pos").alias("first"), F.min("pos").alias("open"), F.sort_array(F.collect_list("pos")).alias("edges"))
    return found.where("first = '('").select("key", "open", F.expr("slice(edges, 2, size(edges))").alias("edges"))


def sites(solid: DataFrame) -> DataFrame:
    """key, language, line, kind, callee, open: names that are called, made with new or referred to, and what is imported."""
    text = solid.where("token != '\n'")
    order = Window.partitionBy("key").orderBy("pos")
    around = text.withColumns({"before": F.lag("token").over(order), "after": F.lead("token").over(order), "open": F.lead("pos").over(order)})
    called = F.col("after") == "("
    kind = F.when(F.coalesce(called, F.lit(False)), F.when(F.col("before") == "new", "new").otherwise("call")).otherwise("reference")
    plain = F.regexp_replace(F.regexp_replace("token", r"\s+", ""), r"::<[^<>]*>|<.*>$", "")
    names = around.where(F.col("token").rlike(r"^[A-Za-z_$]") & ~F.col("token").rlike(_STRING))
    named = names.select("key", "language", "line", "pos", kind.alias("kind"), F.regexp_replace(plain, "->", ".").alias("callee"), F.when(called, F.col("open")).alias("open"))
    # Statements that import stand alone in a line, but for Go, where they are strings behind the word.
    first = F.lag("token").over(order)
    lines = text.where(F.col("language").isin("python", "rust", "c")).groupBy("key", "language", "line").agg(F.min("pos").alias("pos"), F.min_by("token", "pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("all"))
    said = F.array_join(F.col("all.token"), " ")
    said = F.when(F.col("language") == "c", F.regexp_replace(said, " ", "")).when(F.col("language") == "rust", F.regexp_replace(F.regexp_replace(said, r"\s*(::|;)\s*", "$1"), r";.*$|\{.*$", "")).otherwise(said)
    lines = lines.where("first in ('from', 'import', 'use', '#')").select("key", "language", "line", "pos", F.lit("import").alias("kind"), said.alias("callee"), F.lit(None).cast("int").alias("open"))
    go = text.where("language = 'go'").withColumn("part", F.last(F.when(F.col("token").isin("import", "func", "type", "var", "const"), F.col("token")), ignorenulls=True).over(order))
    go = go.where("part = 'import' and token like '\"%'").select("key", "language", "line", "pos", F.lit("import").alias("kind"), F.replace(F.col("token"), F.lit('"'), F.lit("")).alias("callee"), F.lit(None).cast("int").alias("open"))
    return named.unionByName(lines).unionByName(go)


def matched(found: DataFrame, rules: list[tuple]) -> DataFrame:
    """Each site with the first rule of its language and kind that its name matches; sites without one are dropped before any join."""
    groups = {}
    for _, language, kind, _, pattern, *_ in rules:
        groups.setdefault((language, kind), []).append(pattern)
    may = F.lit(False)
    for (language, kind), patterns in groups.items():
        may = may | ((F.col("language") == language) & (F.col("kind") == kind) & F.col("callee").rlike("|".join(patterns)))
    table = found.sparkSession.createDataFrame(rules, FIELDS).alias("r")  # some hundred rows, a parameter
    some = found.where(may).alias("s")
    both = some.join(F.broadcast(table), [F.col("s.language") == F.col("r.language"), F.col("s.kind") == F.col("r.kind"), F.expr("s.callee rlike r.pattern")])
    told = F.struct(*[F.col(f"r.{c}") for c in table.columns if c not in ("place", "language", "kind")])
    return both.groupBy("key", "pos", "s.language", "line", "s.kind", "callee", "open").agg(F.min_by(told, "r.place").alias("r"))


def literal(text: Column) -> Column:
    """The value of a plain string literal; null for anything else, and for one with values filled in."""
    body = r"^(?:[A-Za-z]{0,2}|@)(?:\"\"\"(?s:(.*))\"\"\"|\"(?s:([^\"]*))\"|'(?s:([^']*))'|`(?s:([^`$]*))`)$"
    parts = [F.regexp_extract(text, body, n) for n in (1, 2, 3, 4)]
    filled = text.rlike(r"^(?:[fF]|[rR][fF]|[fF][rR]|\$)[\"']")
    return F.when(text.rlike(body) & ~filled, F.concat(*parts))


def _extract(text: Column, pattern: Column, group: Column) -> Column:
    """regexp_extract by a pattern that comes from a rule."""
    return F.call_function("regexp_extract", text, pattern, group)


def _value(source: Column, args: Column, callee: Column, pattern: Column) -> Column:
    """The text that a source points to, before its own pattern is applied."""
    keyed = F.concat(F.lit("^"), source["keyword"], F.lit(r"\s*[=:](?!=)\s*"))
    by_word = F.get(F.filter(args, lambda a: F.coalesce(F.regexp_like(a, keyed), F.lit(False))), F.lit(0))
    by_word = F.regexp_replace(by_word, keyed, F.lit(""))
    placed = F.get(F.filter(args, lambda a: ~a.rlike(r"^[A-Za-z_]\w*\s*(?:=(?![=>])|:(?!:)\s)")), source["at"])
    node = F.coalesce(by_word, placed)
    prop = F.concat(F.lit(r"(?s)[{,]\s*[\"']?"), source["property"], F.lit(r"[\"']?\s*:\s*(\"[^\"]*\"|'[^']*'|[^,}]*)"))
    holder = F.coalesce(node, F.get(F.filter(args, lambda a: F.coalesce(F.regexp_like(a, prop), F.lit(False))), F.lit(0)))
    inner = F.nullif(F.trim(_extract(holder, prop, F.lit(1))), F.lit(""))
    whole = F.when(source["property"].isNull() | literal(node).isNotNull(), node).otherwise(inner)
    return F.when(source["group"].isNotNull(), _extract(callee, pattern, source["group"])).otherwise(whole)


def algorithm_name(text: Column, signature: Column) -> Column:
    """algorithm, key_size, mode, padding, digest, jose of an algorithm as it is written in code; an unknown name stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    jose = F.create_map(*[F.lit(x) for pair in JOSE.items() for x in pair])
    trimmed = F.trim(text)
    jca = r"^([A-Za-z0-9-]+)/([A-Za-z0-9]+)/([A-Za-z0-9]+)$"
    base = F.when(trimmed.rlike(jca), F.regexp_extract(trimmed, jca, 1)).otherwise(trimmed)
    low = F.lower(base)
    group = lambda pattern, n: F.nullif(F.regexp_extract(low, pattern, n), F.lit(""))
    signed, reverse, token = r"^(md5|sha-?\d+)with(rsa|ecdsa|dsa)(?:andmgf1)?$", r"^(rsa|ecdsa|dsa)-(sha-?\d+|md5)$", r"^(rs|ps|es|hs)(?:256|384|512)$"
    sized, short, bare = r"^aes-?(128|192|256)(?:-?([a-z0-9]+))?$", r"^a(128|192|256)((?:gcm|cbc|kw|ctr)[a-z0-9]*)$", r"^aes-(gcm|cbc|ctr|kw|ecb)$"
    block, lattice, curve = r"^(des-ede3|des3|3des|tripledes|desede|des|bf|blowfish|rc4)-([a-z0-9]+)$", r"^(?:(ml[-_]?kem|kyber)[-_]?(512|768|1024)|ml[-_]?dsa[-_]?(44|65|87))$", r"^(ecdsa|ecdh)_p(256|384|521)$"
    name = lambda c: F.try_element_at(known, c)
    bits = F.coalesce(group(sized, 1), group(short, 1))
    only_digest = signature & low.rlike(r"^(?:md[45]|sha-?\d+|sha3-256)$")
    algorithm = (
        F.when(low.rlike(signed), name(group(signed, 2))).when(low.rlike(reverse), name(group(reverse, 1))).when(low.rlike(token), F.try_element_at(jose, F.substring(low, 1, 2)))
        .when(bits.isNotNull(), F.concat(F.lit("AES-"), bits)).when(low.rlike(bare), "AES").when(low.rlike(block), name(group(block, 1)))
        .when(group(lattice, 2).isNotNull(), F.concat(F.lit("ML-KEM-"), group(lattice, 2))).when(group(lattice, 3).isNotNull(), F.concat(F.lit("ML-DSA-"), group(lattice, 3)))
        .when(low.rlike(curve), name(group(curve, 1))).when(only_digest | (low == "sha1prng"), F.lit(None)).otherwise(F.coalesce(name(low), base))
    )
    mode = F.coalesce(F.when(trimmed.rlike(jca), F.regexp_extract(trimmed, jca, 2)), group(sized, 2), group(short, 2), group(bare, 1), group(block, 2))
    digest = F.coalesce(group(signed, 1), group(reverse, 2), F.when(only_digest, low))
    return F.struct(
        algorithm.alias("algorithm"), group(curve, 2).cast("int").alias("key_size"), F.upper(mode).alias("mode"), F.when(trimmed.rlike(jca), F.regexp_extract(trimmed, jca, 3)).alias("padding"),
        F.coalesce(name(digest), F.upper(digest)).alias("digest"), F.when(low.rlike(token), F.upper(base)).alias("jose"),
    )


def protocol_name(text: Column) -> Column:
    """The version of a protocol that is out of date; null for current ones and for the name of the family."""
    word = F.regexp_replace(F.trim(text), "^[\"']|[\"']$", "")
    spelled = F.create_map(*[F.lit(x) for name, words in OLD_PROTOCOLS.items() for w in words for x in (w, name)])
    return F.when(word == DOTNET_TLS10, "TLSv1.0").otherwise(F.try_element_at(spelled, F.regexp_replace(F.lower(word), "_version$", "")))


def scan(files: DataFrame, rules: str = RULES) -> DataFrame:
    """files: id, language (or null: not scanned), text. A row for each site: id, line, language, rule, kind, callee, algorithm,
    key_size, protocol, cipher_suite, mode, padding, digest, usage, confidence, unresolved, argument, literal.

    argument is the expression (its first 80 characters) that chooses an algorithm elsewhere; no other text of the file is kept. Rows that
    repeat an id are scanned one by one; null and empty texts have no sites; of a bracket that is never closed the arguments before its last comma count.
    """
    table = parsed(rules)
    kept, solid = tokens(files, table)
    solid = written(solid, "solid")
    hits = matched(sites(solid), table)
    edged = hits.join(arguments(solid), ["key", "open"], "left").join(kept.select("id", "key", "tokens"), "key")
    starts = F.concat(F.array("open"), F.expr("slice(edges, 1, size(edges) - 1)"))
    inner = F.transform(F.arrays_zip(starts.alias("a"), F.col("edges").alias("b")), lambda e: F.filter(F.slice("tokens", e["a"] + 2, e["b"] - e["a"] - 1), lambda t: ~t.rlike(_COMMENT) | ((F.col("language") != "python") & t.startswith("#"))))
    args = F.filter(F.transform(inner, lambda ts: F.trim(F.regexp_replace(F.array_join(ts, ""), r"^\s+|\s+$", ""))), lambda a: a != "")
    one = written(edged.select("id", "key", "pos", "language", "line", "kind", "callee", "r.*", F.coalesce(args, F.array().cast("array<string>")).alias("args")), "sites")

    filled = lambda template: F.replace(F.col(template), F.lit("$1"), _extract(F.col("callee"), F.col("pattern"), F.lit(1)))
    value = lambda s: _value(F.col(s), F.col("args"), F.col("callee"), F.col("pattern"))
    inside = lambda s, text: F.nullif(_extract(text, F.concat(F.lit("(?i)"), F.col(s)["pattern"]), F.lit(1)), F.lit(""))
    read = lambda s, text: F.when(F.col(s)["pattern"].isNotNull(), inside(s, text)).when(F.col(s)["group"].isNotNull(), text).otherwise(literal(text))
    one = one.withColumns({f"{s}_text": value(s) for s in ("algorithm", "protocol", "suite", "size", "mode")})
    one = one.withColumns({"said": F.when(F.col("algorithm").isNotNull(), read("algorithm", F.col("algorithm_text"))), "made": F.when(F.col("template").isNotNull() & F.col("template").contains("$"), filled("template")).otherwise(F.col("template"))})
    one = one.withColumn("n", algorithm_name(F.coalesce("made", "said"), F.coalesce(F.col("algorithm")["signature"], F.lit(False))))
    plain = F.when(F.col("template").isNotNull() & ~F.col("template").contains("$"), F.col("template")).otherwise(F.col("n.algorithm"))
    number = F.when(F.col("size")["group"].isNotNull(), F.col("size_text")).when(F.col("size")["pattern"].isNotNull(), inside("size", F.col("size_text"))).otherwise(F.nullif(F.regexp_extract("size_text", r"\b(\d{3,5})\b", 1), F.lit("")))
    mode = F.when(F.col("mode")["group"].isNotNull(), F.col("mode_text")).otherwise(inside("mode", F.col("mode_text")))
    protocol = F.when(F.col("protocol").isNotNull(), protocol_name(read("protocol", F.col("protocol_text"))))
    suite = F.when(F.col("suite").isNotNull(), read("suite", F.col("suite_text")))
    chosen = (F.col("algorithm").isNotNull() & plain.isNull()) | (F.col("suite").isNotNull() & suite.isNull())
    written_down = F.col("said").isNotNull() & F.col("algorithm")["pattern"].isNull()
    out = one.withColumns({"protocol_name": protocol, "suite_name": suite, "plain": plain, "unresolved": chosen}).where("protocol is null or protocol_name is not null").select(
        "id", "key", "line", "language", "rule", "kind", "callee", F.when(~F.col("unresolved"), F.col("plain")).alias("algorithm"), F.coalesce(number.cast("int"), F.col("n.key_size")).alias("key_size"),
        F.col("protocol_name").alias("protocol"), F.col("suite_name").alias("cipher_suite"), F.upper(F.coalesce(mode, F.col("n.mode"))).alias("mode"), "n.padding", "n.digest", "n.jose", "usage",
        F.when(F.col("unresolved"), UNRESOLVED).when(written_down & (F.col("kind") == "call"), LITERAL).otherwise(F.col("confidence")).alias("confidence"), "unresolved",
        F.when(F.col("unresolved"), F.coalesce(F.substring(F.coalesce("algorithm_text", "suite_text"), 1, 80), F.lit("(absent)"))).alias("argument"), F.when(written_down, F.col("said")).alias("literal"),
    )
    out = written(out, "found")
    family = F.when(F.col("algorithm") == "3DES", "DES").otherwise(F.col("algorithm"))  # one package has both
    used = out.where("kind != 'import'").select("key", family.alias("family")).distinct()
    imports = out.where("kind = 'import'").withColumn("family", family).join(used, ["key", "family"], "left_anti").select(out.columns)
    return out.where("kind != 'import'").unionByName(imports).drop("key")
