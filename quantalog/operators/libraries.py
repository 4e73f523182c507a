"""Cryptographic libraries by packages, linked files and banners, and which of their versions can do without classical public keys.

What is known of a library is laid out as intervals of versions; a sighting meets them by its library and line of versions
(equality) and the place of its version in them. A version is an array of numbers that sorts as versions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators.numbering import BROADCAST_ROWS

# Libraries: id; name; role; first release with native post-quantum algorithms (any: all, never: only classical ones, ?: not known,
# ecosystem=release where lines differ); what comes instead; packages as ecosystem:name; stems of linked files; banner. Fixed values.
LIBRARIES = r"""
openssl; OpenSSL; tls+primitives; 3.5.0; OpenSSL 3.5 LTS; conan:openssl vcpkg:openssl deb:openssl deb:libssl3 deb:libssl3t64 deb:libssl1.1 apk:openssl apk:libssl3 apk:libcrypto3 apk:libssl1.1 apk:libcrypto1.1; libssl libcrypto ssleay32 libeay32; OpenSSL (\d+\.\d+\.\d+[a-z]?)
boringssl; BoringSSL; tls+primitives; ?; ; ; ; BoringSSL
libressl; LibreSSL; tls+primitives; ?; ; ; ; LibreSSL (\d+\.\d+\.\d+)
aws-lc; AWS-LC; tls+primitives; ?; ; cargo:aws-lc-rs cargo:aws-lc-sys; ; AWS-LC
wolfssl; wolfSSL; tls+primitives; ?; ; conan:wolfssl vcpkg:wolfssl apk:wolfssl; libwolfssl wolfssl; wolfSSL (\d+\.\d+\.\d+)
mbedtls; Mbed TLS; tls+primitives; ?; ; conan:mbedtls vcpkg:mbedtls; libmbedcrypto libmbedtls libmbedx509; [Mm]bed ?TLS (\d+\.\d+\.\d+)
gnutls; GnuTLS; tls+primitives; ?; ; conan:gnutls vcpkg:gnutls deb:libgnutls30 deb:libgnutls30t64 apk:gnutls; libgnutls; GnuTLS (\d+\.\d+\.\d+)
libsodium; libsodium; primitives; ?; ; pypi:pynacl npm:libsodium-wrappers npm:sodium-native gem:rbnacl composer:paragonie/sodium_compat conan:libsodium vcpkg:libsodium; libsodium;
windows-cng; Windows CNG; primitives; ?; ; ; bcrypt.dll ncrypt.dll;
windows-capi; Windows CryptoAPI (legacy); primitives; never; Port to CNG (bcrypt.dll / ncrypt.dll); ; advapi32.dll crypt32.dll;
apple-security; Apple Security / CommonCrypto; primitives; ?; ; ; security.framework commoncrypto libcommoncrypto;
go-stdlib; Go standard library; tls+primitives; 1.24; Go 1.24 or later; ; ; \bgo(1\.\d{1,2}(?:\.\d{1,2})?)\b
openjdk; OpenJDK; tls+primitives; 24; JDK 24 or later (25 LTS); deb:openjdk-11-jre-headless deb:openjdk-17-jre-headless deb:openjdk-21-jre-headless deb:openjdk-25-jre-headless deb:openjdk-17-jdk-headless deb:openjdk-21-jdk-headless apk:openjdk11-jre apk:openjdk17-jre apk:openjdk21-jre apk:openjdk17-jre-headless apk:openjdk21-jre-headless; ;
dotnet; .NET runtime; tls+primitives; 10; .NET 10; ; ;
bouncycastle; Bouncy Castle; primitives+pki; maven=1.79; bcprov 1.79 or later; maven:org.bouncycastle:bcprov-jdk18on maven:org.bouncycastle:bcprov-jdk15on maven:org.bouncycastle:bcprov-jdk15to18 maven:org.bouncycastle:bcpkix-jdk18on nuget:BouncyCastle.Cryptography nuget:Portable.BouncyCastle; ;
python-cryptography; pyca/cryptography; primitives+pki; ?; ; pypi:cryptography pypi:pyopenssl; ;
pycryptodome; PyCryptodome; primitives; ?; ; pypi:pycryptodome pypi:pycryptodomex pypi:pycrypto; ;
python-rsa; python-rsa; primitives; never; Replace with a PQC-capable library (liboqs-python, or cryptography over OpenSSL 3.5); pypi:rsa; ;
python-ecdsa; python-ecdsa; primitives; never; Replace with a PQC-capable library; pypi:ecdsa; ;
ruby-openssl; Ruby openssl gem; binding; ?; ; gem:openssl; ;
jwt-libraries; JWT / JOSE library; token-signing; ?; ; pypi:pyjwt pypi:python-jose pypi:jwcrypto pypi:authlib npm:jsonwebtoken npm:jose npm:node-jose maven:io.jsonwebtoken:jjwt maven:io.jsonwebtoken:jjwt-api maven:com.nimbusds:nimbus-jose-jwt maven:com.auth0:java-jwt composer:firebase/php-jwt composer:lcobucci/jwt gem:jwt nuget:System.IdentityModel.Tokens.Jwt nuget:jose-jwt go:github.com/golang-jwt/jwt/v5 go:github.com/golang-jwt/jwt/v4 go:github.com/lestrrat-go/jwx/v2 cargo:jsonwebtoken; ;
node-forge; node-forge; primitives+pki; ?; ; npm:node-forge; ;
classical-only-js; Classical-only JS crypto; primitives; never; Add @noble/post-quantum or a liboqs binding; npm:node-rsa npm:elliptic npm:tweetnacl npm:@noble/curves npm:secp256k1; ;
classical-only-rust; Classical-only Rust crypto; primitives; never; Add the RustCrypto ml-kem / ml-dsa crates; cargo:rsa cargo:p256 cargo:p384 cargo:k256 cargo:ed25519-dalek cargo:x25519-dalek; ;
ring; ring; primitives; ?; ; cargo:ring; ;
rustls; rustls; tls; ?; ; cargo:rustls; ;
golang-x-crypto; golang.org/x/crypto; primitives+ssh; ?; ; go:golang.org/x/crypto; ;
circl; Cloudflare CIRCL; pqc; ?; ; go:github.com/cloudflare/circl; ;
tink; Google Tink; primitives; ?; ; maven:com.google.crypto.tink:tink pypi:tink go:github.com/tink-crypto/tink-go/v2; ;
phpseclib; phpseclib; primitives+ssh; ?; ; composer:phpseclib/phpseclib; ;
ssh-libraries; SSH library; ssh; ?; ; pypi:paramiko pypi:asyncssh npm:ssh2 maven:com.jcraft:jsch maven:com.github.mwiede:jsch maven:org.apache.sshd:sshd-core gem:net-ssh; ;
openpgp; OpenPGP library; pgp; ?; ; npm:openpgp pypi:pgpy pypi:python-gnupg go:github.com/ProtonMail/go-crypto; ;
liboqs; Open Quantum Safe (liboqs); pqc; any; ; pypi:liboqs-python pypi:oqs maven:org.openquantumsafe:liboqs-java go:github.com/open-quantum-safe/liboqs-go cargo:oqs cargo:oqs-sys conan:liboqs vcpkg:liboqs; liboqs oqsprovider;
pqc-native; Post-quantum implementation; pqc; any; ; npm:@noble/post-quantum npm:crystals-kyber npm:mlkem pypi:kyber-py pypi:dilithium-py pypi:pqcrypto cargo:ml-kem cargo:ml-dsa cargo:slh-dsa cargo:pqcrypto cargo:pqcrypto-mlkem; ;
symmetric-only; Symmetric / hashing library; symmetric; symmetric; ; npm:crypto-js npm:bcrypt npm:bcryptjs npm:argon2 npm:scrypt-js pypi:bcrypt pypi:argon2-cffi pypi:passlib gem:bcrypt composer:defuse/php-encryption maven:org.mindrot:jbcrypt; ;
"""
# Confidence in a version that is pinned, and in one that is only a range. Fixed values.
EXACT, RANGE = 0.75, 0.6
#: Numbers of a version that count.
WIDTH = 4


def version_key(version: Column) -> Column:
    """[3, 0, 18, 0] of 3.0.18-1~deb12u2 or of v3.0.18: the first numbers, filled up with 0, so arrays sort as versions do. Null without a number."""
    head = F.substring_index(F.regexp_replace(F.regexp_replace(F.trim(version), r"^[^0-9]*", ""), r"[\s+~-]", " "), " ", 1)
    numbers = F.slice(F.regexp_extract_all(head, F.lit(r"[0-9]+"), F.lit(0)), 1, WIDTH)
    filled = F.slice(F.concat(F.transform(numbers, lambda n: n.try_cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), WIDTH)), 1, WIDTH)
    return F.when(F.size(numbers) > 0, filled)


def package_key(ecosystem: Column, name: Column) -> Column:
    """How an ecosystem tells names apart: one of Python's by lower case and one kind of separator, others by lower case."""
    low = F.lower(F.trim(name))
    return F.when(ecosystem == "pypi", F.regexp_replace(low, r"[-_.]+", "-")).otherwise(low)


class KnowledgeBase:
    """Libraries as tables: `libraries` (library, name, role, upgrade), `packages` (ecosystem, package, library), `files` (stem, place,
    library), `versions` (library, line, low, high, capable, since), and the banners. text: a library a line, as above."""

    def __init__(self, spark: SparkSession, text: str = LIBRARIES):
        rows = [[part.strip() for part in line.split(";")] for line in text.strip().splitlines()]
        self.banners = [(r[0], r[7]) for r in rows if r[7]]
        self.libraries = spark.createDataFrame([(r[0], r[1], r[2], r[4] or None) for r in rows], "library string, library_name string, role string, upgrade string")
        packages = spark.createDataFrame([(*p.split(":", 1), r[0]) for r in rows for p in r[5].split()], "ecosystem string, package string, library string")
        self.packages = packages.withColumn("package", package_key(F.col("ecosystem"), F.col("package")))
        stems = [(s.lower(), r[0]) for r in rows for s in r[6].split()]
        self.files = spark.createDataFrame([(s, n, i) for n, (s, i) in enumerate(stems)], "stem string, place int, library string")
        lines = []
        for r in rows:
            for given in r[3].split():
                line, _, since = given.rpartition("=")
                lines.append((r[0], line or None, since))
        said = spark.createDataFrame(lines, "library string, line string, since string")
        border, end = version_key(F.col("since")), F.array_repeat(F.lit((1 << 63) - 1), WIDTH)
        start = F.array_repeat(F.lit(0).cast("bigint"), WIDTH)
        every = lambda capable: F.array(F.struct(start.alias("low"), end.alias("high"), F.lit(capable).alias("capable")))
        halves = F.array(F.struct(start.alias("low"), border.alias("high"), F.lit(False).alias("capable")), F.struct(border.alias("low"), end.alias("high"), F.lit(True).alias("capable")))
        cut = F.when(F.col("since").isin("any", "symmetric"), every(True)).when(F.col("since") == "never", every(False)).when(border.isNotNull(), halves)
        self.versions = said.select("library", "line", "since", F.explode(cut).alias("v")).select("library", "line", "since", "v.*")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_library(packages: DataFrame, base: KnowledgeBase) -> DataFrame:
    """packages: ecosystem, name, and others. Those that are a known library, with its id; a runtime goes by the id itself."""
    runtime = base.libraries.select(F.lit("runtime").alias("ecosystem"), F.col("library").alias("package"), "library")
    known = base.packages.unionByName(runtime)
    keyed = packages.withColumn("package", package_key(F.col("ecosystem"), F.col("name")))
    return keyed.join(_small(known), ["ecosystem", "package"]).drop("package")


def linked_files(files: DataFrame, base: KnowledgeBase) -> DataFrame:
    """files: file, and others. The library of a linked file: its name is a stem, or one followed by a dot, hyphen or underscore."""
    base_name = F.element_at(F.split(F.lower("file"), "/"), -1)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length("_name"), F.lit(1))), lambda n: (n == F.length("_name")) | F.substring(F.col("_name"), n + 1, F.lit(1)).isin(".", "-", "_"))
    stems = F.transform(ends, lambda n: F.substring(F.col("_name"), F.lit(1), n))
    rows = files.withColumn("_row", F.monotonically_increasing_id()).withColumn("_name", base_name)
    met = rows.select("_row", *files.columns, F.explode(stems).alias("stem")).join(_small(base.files), "stem")
    return met.groupBy("_row", *files.columns).agg(F.min_by("library", "place").alias("library")).drop("_row")


def banners(texts: DataFrame, base: KnowledgeBase) -> DataFrame:
    """texts: id, text. Each banner in a text: id, library, version (null if the banner has none), said. A text without any is never exploded."""

    def of(library: str, pattern: str) -> Column:
        grouped = "(" in pattern.replace("(?:", "")
        numbers = F.regexp_extract_all("text", F.lit(pattern if grouped else f"({pattern})()"), F.lit(1 if grouped else 2))
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("said"), numbers.alias("version"))
        return F.transform(both, lambda z: F.struct(F.lit(library).alias("library"), F.nullif(z["version"], F.lit("")).alias("version"), z["said"].alias("said")))

    found = [of(*b) for b in base.banners]
    may = texts.where(F.col("text").rlike("|".join(p for _, p in base.banners)))
    return may.select("id", F.explode(F.concat(*found)).alias("b")).select("id", "b.*")


def with_readiness(sightings: DataFrame, base: KnowledgeBase) -> DataFrame:
    """sightings: library, ecosystem (may be null), version, and others. Adds capable (null: not known), since and reason.

    A library whose lines of versions differ is judged by the line of the ecosystem. An unknown version is judged only where all
    versions are alike.
    """
    key, line = F.col("_key"), F.col("line")
    known = base.versions
    whole = known.groupBy("library", "line").agg(F.min("since").alias("since"), F.count("*").alias("parts"), F.min("capable").alias("alike"))
    fits = (F.col("s.library") == F.col("v.library")) & F.coalesce(line == F.col("s.ecosystem"), line.isNull())
    rows = sightings.withColumns({"_key": version_key(F.col("version")), "_row": F.monotonically_increasing_id()}).alias("s")
    told = rows.join(_small(whole).alias("v"), fits, "left").select("s.*", "line", "since", "parts", "alike").alias("s")
    placed = told.join(_small(known.drop("since")).alias("v"), (F.col("s.library") == F.col("v.library")) & F.col("s.line").eqNullSafe(F.col("v.line")) & (key >= F.col("low")) & (key < F.col("high")), "left")
    capable = F.when(F.col("parts") == 1, F.col("alike")).otherwise(F.col("capable"))
    reason = (
        F.when(F.col("since").isNull(), "no release is known").when(F.col("since") == "symmetric", "no public keys").when(F.col("since") == "any", "post-quantum").when(F.col("since") == "never", "only classical")
        .when(capable.isNull(), "version not known").when(capable, "from this release on").otherwise("before that release")
    )
    out = placed.select(*[F.col(f"s.{c}") for c in sightings.columns], capable.alias("capable"), F.when(F.col("since") == "symmetric", "any").otherwise(F.col("since")).alias("since"), reason.alias("reason"))
    return out.join(_small(base.libraries), "library")


def library_findings(packages: DataFrame, base: KnowledgeBase) -> DataFrame:
    """packages: path, ecosystem, name, version, spec, exact, direct, pos. A finding for each project (folder), ecosystem, package and library.

    Of several sightings the exact one stands for all, then the direct one, then the first. verdict: pqc, shor or unknown.
    """
    found = with_library(packages, base).withColumn("project", F.regexp_replace("path", r"/?[^/]*$", ""))
    found = found.withColumn("package", package_key(F.col("ecosystem"), F.col("name")))
    rank = F.struct(F.col("exact").cast("int"), F.col("direct").cast("int"), -F.col("pos"))
    keys = ["project", "ecosystem", "package", "library"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct("path", "name", "version", "spec", "exact"), rank).alias("b"), F.count_distinct("path").alias("manifests")).select(*keys, "manifests", "b.*")
    judged = with_readiness(best, base)
    label = F.coalesce("version", F.concat("spec", F.lit(" (range)")), F.lit("(version unknown)"))
    where = F.when(F.col("ecosystem") == "runtime", F.concat(F.col("library_name"), F.lit(" "), label, F.lit(" (runtime)"))).otherwise(F.concat("name", F.lit(" "), label, F.lit(" ("), "ecosystem", F.lit(")")))
    upgrade = F.coalesce("upgrade", F.when(~F.col("since").isin("any", "never"), F.concat("library_name", F.lit(" "), "since", F.lit(" or later"))))
    return judged.select(
        *keys, "version", "manifests", "capable", "since", "reason", F.when(F.col("exact"), EXACT).otherwise(RANGE).alias("confidence"), where.alias("display"),
        F.when(F.col("capable"), "pqc").when(~F.col("capable"), "shor").otherwise("unknown").alias("verdict"), F.coalesce(~F.col("capable"), F.lit(False)).alias("quantum_vulnerable"),
        F.when(F.col("capable"), None).when(~F.col("capable"), F.coalesce(upgrade, F.lit("Replace with a PQC-capable library"))).otherwise(upgrade).alias("replacement"),
    )
