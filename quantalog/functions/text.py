"""String, date and hash functions of the inventory as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_only(value: Column) -> Column:
    """Hexadecimal digits in lower case; null for none."""
    return F.nullif(F.lower(F.regexp_replace(value, "[^0-9A-Fa-f]", "")), F.lit(""))


def serial(value: Column) -> Column:
    """A serial number in hexadecimal without leading zeros. Plain digits are a decimal number of any length; all else is hexadecimal.

    A decimal of more than 18 digits is turned nine digits at a time: high * 10^9 + low in base 2^28, limb by limb.
    """
    plain = F.trim(value)
    hexed = F.ltrim(F.lower(F.regexp_replace(plain, "[^0-9A-Fa-f]", "")), F.lit("0"))
    digits = F.ltrim(plain, F.lit("0"))
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 9) * 9).cast("int"), F.lit("0"))
    parts = F.transform(F.sequence(F.lit(0), (F.length(padded) / 9).cast("int") - 1), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)).cast("bigint"))
    none = F.array().cast("array<bigint>")

    def add(limbs: Column, low: Column) -> Column:
        """limbs * 10^9 + low; limbs from the least on."""
        step = F.aggregate(
            limbs,
            F.struct(none.alias("out"), low.alias("carry")),
            lambda a, x: F.struct(F.array_append(a["out"], (x * 1_000_000_000 + a["carry"]).bitwiseAND(F.lit((1 << 28) - 1))).alias("out"), F.shiftright(x * 1_000_000_000 + a["carry"], 28).alias("carry")),
            lambda a: F.concat(a["out"], F.array(a["carry"].bitwiseAND(F.lit((1 << 28) - 1)), F.shiftright(a["carry"], 28))),
        )
        return F.filter(step, lambda x, i: (x != 0) | (i < F.size(step) - 2))

    big = F.aggregate(parts, none, add)
    long = F.ltrim(F.array_join(F.transform(F.reverse(big), lambda x: F.lpad(F.lower(F.hex(x)), 7, F.lit("0"))), ""), F.lit("0"))
    short = F.ltrim(F.lower(F.conv(plain, 10, 16)), F.lit("0"))
    number = F.when(F.length(digits) == 0, F.lit("")).when(F.length(digits) <= 18, short).otherwise(long)
    found = F.when(plain.rlike("^[0-9]+$"), number).when(plain.rlike("[0-9A-Fa-f]"), hexed)
    return F.when(found == "", F.lit("0")).otherwise(found)


def distinguished_name(value: Column) -> Column:
    """Parts in lower case, without outer spaces, sorted. A part begins at a comma before 'key='."""
    marked = F.regexp_replace(F.regexp_replace(value, r"\s*=\s*", "="), r"\s*,\s*([A-Za-z0-9.]+)=", "\n$1=")
    return F.array_join(F.sort_array(F.transform(F.split(marked, "\n"), lambda p: F.lower(F.trim(p)))), ",")


def common_name(subject: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(subject, r"(?i)CN\s*=\s*([^,]+)", 1)), F.lit(""))


def endpoint(location: Column) -> Column:
    """host:port in lower case from a URL or an address."""
    return F.lower(F.regexp_extract(F.regexp_replace(location, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^([^/?#]*)", 1))


def without_line(location: Column) -> Column:
    return F.regexp_replace(location, ":[0-9]+$", "")


def line_of(location: Column) -> Column:
    return F.nullif(F.regexp_extract(location, r":([0-9]+)$", 1), F.lit("")).cast("int")


def version_parts(version: Column) -> Column:
    """Numbers of a version, comparable as an array; null where there are none."""
    found = F.regexp_extract_all(F.regexp_extract(version, r"^v?([0-9]+(?:\.[0-9]+)*)", 1), F.lit("([0-9]+)"), 1)
    return F.when(F.size(found) > 0, F.transform(found, lambda x: x.cast("int")))


def algorithm_key(name: Column) -> Column:
    """A spelling of an algorithm reduced to its taxonomy key."""
    key = F.upper(F.regexp_replace(F.trim(name), r"[\s_]+", "-"))
    key = F.when(key.rlike(r"^(SHA-?\d+|MD5)-?WITH-?(RSA|ECDSA|DSA)"), F.regexp_extract(key, r"WITH-?(RSA|ECDSA|DSA)", 1)).otherwise(key)
    key = F.when(key.rlike(r"^(ECDSA|RSASSA-PSS|RSA)-WITH-SHA-?\d+$"), F.regexp_extract(key, r"^(ECDSA|RSASSA-PSS|RSA)", 1)).otherwise(key)
    return F.nullif(key, F.lit(""))


# Words of registered suite names and what they stand for. Fixed values.
KEY_EXCHANGES = {"ECDHE": "ECDHE", "EECDH": "ECDHE", "DHE": "DHE", "EDH": "DHE", "ECDH": "ECDH", "PSK": "PSK"}
AUTHENTICATIONS = {"ECDSA": "ECDSA", "RSA": "RSA", "DSS": "DSA", "DSA": "DSA"}
BLOCK_MODES = {"GCM": "gcm", "CCM": "ccm", "CCM8": "ccm", "CBC": "cbc"}
SUITE_HASHES = {"SHA384": "SHA-384", "SHA256": "SHA-256", "POLY1305": "HMAC", "SHA": "SHA-1", "MD5": "MD5"}


def _named(words: Column, names: dict[str, str]) -> Column:
    """What the first of the words that has a meaning stands for."""
    meaning = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.get(F.filter(F.transform(words, lambda w: meaning[w]), lambda m: m.isNotNull()), F.lit(0))


def cipher_suite(suite: Column) -> Column:
    """Key exchange, authentication, bulk cipher with bits and mode, and MAC, by the words of a suite's registered name.

    A registered name is key exchange and authentication, WITH, cipher with size and mode, hash; OpenSSL leaves out TLS and WITH
    and joins cipher and size. TLS 1.3 names begin with the cipher: there is no key exchange in them. A suite that names none is
    RSA key transport. The size of triple DES is its strength, 112. ChaCha20's tag counts as the MAC of a suite unless a hash is named.
    """
    text = F.regexp_replace(F.regexp_replace(F.upper(suite), "[-_]+", " "), r"\b(AES|CAMELLIA|ARIA) ?(128|256)\b", "$1 $2")
    words = F.filter(F.split(F.trim(text), " "), lambda w: ~w.isin("TLS", "SSL", ""))
    first = F.get(words, F.lit(0))
    modern = F.startswith(F.upper(suite), F.lit("TLS")) & first.isin("AES", "CHACHA20") & ~F.array_contains(words, "WITH")
    border = F.array_position(words, "WITH").cast("int")
    agreed = F.when(border > 0, F.slice(words, 1, F.greatest(border - 1, F.lit(0)))).otherwise(words)
    transport = F.when((first == "RSA") & (border > 0) | first.isin("AES", "DES", "RC4", "3DES"), "RSA")
    has = lambda w: F.array_contains(words, w)
    size = F.get(F.filter(words, lambda w: w.isin("128", "256")), F.lit(0)).cast("int")
    cipher = F.when(has("AES"), F.when(size.isNotNull(), "AES")).when(has("CHACHA20"), "CHACHA20").when(has("3DES") | has("CBC3") | (has("DES") & has("EDE3")), "3DES").when(has("RC4"), "RC4")
    bits = F.when(cipher == "AES", size).when(cipher == "CHACHA20", 256).when(cipher == "3DES", 112).when(cipher == "RC4", 128)
    mode = F.when(cipher == "AES", _named(words, BLOCK_MODES)).when(cipher == "3DES", "cbc")
    ends = F.reverse(words)
    hashed = F.coalesce(_named(ends, {k: v for k, v in SUITE_HASHES.items() if k not in ("POLY1305",)}), _named(ends, {"POLY1305": SUITE_HASHES["POLY1305"]}))
    return F.struct(
        F.when(~modern, F.coalesce(transport, _named(agreed, KEY_EXCHANGES))).alias("key_exchange"),
        F.when(~modern, _named(agreed, AUTHENTICATIONS)).alias("authentication"),
        cipher.alias("bulk_cipher"),
        bits.alias("bulk_key_bits"),
        mode.alias("mode"),
        hashed.alias("mac"),
    )


def grover_bits(bits: Column, is_hash: Column) -> Column:
    """Bits that remain against Grover's search: half of a cipher's; a hash keeps its own."""
    return F.when(is_hash, bits).otherwise(F.floor(bits / 2))


def stable_id(*parts: Column) -> Column:
    """An identifier made of the parts, in the shape of a UUID."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def instant(text: Column) -> Column:
    """A timestamp of an ISO text; without a zone it is UTC, and what can't be parsed is null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"Z$", "+00:00"))


def days_left(end: Column, as_of: Column) -> Column:
    """Whole days, rounded down, so an hour ago is -1."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(as_of)) / 86400)


def fractional_year(day: Column) -> Column:
    """Year + (day of year - 1) / 365.25."""
    return F.year(day) + (F.dayofyear(day) - 1) / 365.25


def elapsed_year(moment: Column) -> Column:
    """Year + the elapsed share of its actual length."""
    start, end = F.make_date(F.year(moment), F.lit(1), F.lit(1)), F.make_date(F.year(moment) + 1, F.lit(1), F.lit(1))
    return F.year(moment) + (F.unix_timestamp(moment) - F.unix_timestamp(start)) / (F.unix_timestamp(end) - F.unix_timestamp(start))


def entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts, in bits."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
