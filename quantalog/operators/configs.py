"""What configuration files of servers enable, and what they declare for hosts, by lines of a file as rows.

A file's format is told by its name, else by what stands in it. Its lines become settings (protocols, ciphers, groups, lists of
SSH, what Java disables) whatever the format, and settings become findings token by token. Blocks are found by the running depth of
brackets, and a server takes from the level above what it doesn't say itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.operators.checkpoints import written

# Names of files, and what tells a format from the text of others. Fixed values.
FILE_NAMES = {
    "sshd_config": "ssh", "ssh_config": "ssh", "nginx.conf": "nginx", "haproxy.cfg": "haproxy", "openssl.cnf": "openssl", "java.security": "java", "ipsec.conf": "ipsec",
    "swanctl.conf": "swanctl", "httpd.conf": "apache", "apache2.conf": "apache", "ssl.conf": "apache",
}
MARKS = [
    ("ssh", r"(?mi)^\s*(?:KexAlgorithms|HostKeyAlgorithms|Ciphers|MACs)\s"), ("nginx", r"(?m)^\s*ssl_(?:protocols|ciphers|ecdh_curve)\s"), ("apache", r"(?mi)^\s*SSL(?:Protocol|CipherSuite|OpenSSLConfCmd)\s"),
    ("haproxy", r"(?m)^\s*ssl-default-bind-"), ("ipsec", r"(?m)^\s*(?:ike|esp)\s*="), ("swanctl", r"(?m)^\s*(?:esp_)?proposals\s*="), ("openssl", r"(?m)^\s*(?:MinProtocol|CipherString)\s*="), ("java", r"jdk\.tls\.disabledAlgorithms"),
]
# Lists of an SSH server or client: what they name, and what for. Fixed values.
SSH_LISTS = {
    "kexalgorithms": ("kex", "key_exchange"), "hostkeyalgorithms": ("host_key", "signing"), "pubkeyacceptedalgorithms": ("host_key", "signing"), "pubkeyacceptedkeytypes": ("host_key", "signing"),
    "casignaturealgorithms": ("host_key", "signing"), "ciphers": ("cipher", "encryption"), "macs": ("mac", "authentication"),
}
# Names of SSH key exchanges and host keys, and of groups of TLS, with algorithm and size. Fixed values.
SSH_KEX = {
    "curve25519-sha256": ("X25519", None), "curve25519-sha256@libssh.org": ("X25519", None), "curve448-sha512": ("X448", None), "ecdh-sha2-nistp256": ("ECDH", 256), "ecdh-sha2-nistp384": ("ECDH", 384), "ecdh-sha2-nistp521": ("ECDH", 521),
    "diffie-hellman-group1-sha1": ("DH", 1024), "diffie-hellman-group14-sha1": ("DH", 2048), "diffie-hellman-group14-sha256": ("DH", 2048), "diffie-hellman-group15-sha512": ("DH", 3072), "diffie-hellman-group16-sha512": ("DH", 4096),
    "diffie-hellman-group17-sha512": ("DH", 6144), "diffie-hellman-group18-sha512": ("DH", 8192), "diffie-hellman-group-exchange-sha1": ("DH", None), "diffie-hellman-group-exchange-sha256": ("DH", None),
    "sntrup761x25519-sha512": ("SNTRUP761X25519", None), "sntrup761x25519-sha512@openssh.com": ("SNTRUP761X25519", None), "mlkem768x25519-sha256": ("X25519MLKEM768", None), "mlkem768nistp256-sha256": ("SECP256R1MLKEM768", None), "mlkem1024nistp384-sha384": ("SECP384R1MLKEM1024", None),
}
SSH_HOST_KEYS = {
    "ssh-rsa": ("RSA", None), "rsa-sha2-256": ("RSA", None), "rsa-sha2-512": ("RSA", None), "ssh-dss": ("DSA", 1024), "ecdsa-sha2-nistp256": ("ECDSA", 256), "ecdsa-sha2-nistp384": ("ECDSA", 384), "ecdsa-sha2-nistp521": ("ECDSA", 521),
    "ssh-ed25519": ("Ed25519", None), "ssh-ed448": ("Ed448", None), "sk-ssh-ed25519@openssh.com": ("Ed25519", None), "sk-ecdsa-sha2-nistp256@openssh.com": ("ECDSA", 256),
}
SSH_CIPHERS = {"3des-cbc": ("3DES", None), "blowfish-cbc": ("Blowfish", None), "cast128-cbc": ("CAST-128", None), "arcfour": ("RC4", None), "arcfour128": ("RC4", None), "arcfour256": ("RC4", None), "chacha20-poly1305@openssh.com": ("ChaCha20", None)}
TLS_GROUPS = {
    "x25519": ("X25519", None), "x448": ("X448", None), "p-256": ("ECDH", 256), "prime256v1": ("ECDH", 256), "secp256r1": ("ECDH", 256), "p-384": ("ECDH", 384), "secp384r1": ("ECDH", 384), "p-521": ("ECDH", 521), "secp521r1": ("ECDH", 521),
    "ffdhe2048": ("DH", 2048), "ffdhe3072": ("DH", 3072), "ffdhe4096": ("DH", 4096), "ffdhe6144": ("DH", 6144), "ffdhe8192": ("DH", 8192), "x25519mlkem768": ("X25519MLKEM768", None), "secp256r1mlkem768": ("SECP256R1MLKEM768", None),
    "secp384r1mlkem1024": ("SECP384R1MLKEM1024", None), "mlkem512": ("ML-KEM-512", None), "mlkem768": ("ML-KEM-768", None), "mlkem1024": ("ML-KEM-1024", None), "x25519kyber768draft00": ("X25519MLKEM768", None),
}
# Words of cipher strings that stand for groups of suites, and words that enable something weak. Fixed values.
GROUP_WORDS = (
    "DEFAULT ALL HIGH MEDIUM COMPLEMENTOFDEFAULT COMPLEMENTOFALL FIPS SUITEB128 SUITEB128ONLY SUITEB192 PROFILE=SYSTEM ECDHE EECDH EDH DHE AESGCM AES AES128 AES256 CHACHA20 SHA256 SHA384 SHA "
    "TLSV1.2 TLSV1 SSLV3 KEECDH KEDH AECDSA ARSA KRSA RSA ECDSA CAMELLIA ARIA PSK SRP KECDHE"
).split()
WEAK_ALGORITHMS, WEAK_GROUPS = ("RC4", "DES", "3DES", "MD5"), ("EXPORT", "EXP", "NULL", "ENULL", "ANULL", "LOW", "IDEA", "SEED")
WEAK_PARTS = ("3DES", "DES-CBC3", "RC4", "DES-CBC-", "NULL", "EXPORT")
# What Java must disable, and what it is. Fixed values.
JAVA_MUST_DISABLE = {"SSLv3": ("SSLv3", None), "TLSv1": ("TLSv1.0", None), "TLSv1.1": ("TLSv1.1", None), "RC4": (None, "RC4"), "DES": (None, "DES"), "3DES_EDE_CBC": (None, "3DES"), "MD5withRSA": (None, "MD5")}
OLD, VERSIONS = ("SSLv2", "SSLv3", "TLSv1.0", "TLSv1.1"), ("TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3")
CONFIDENCE = 0.7

NAMED = "struct<algorithm:string,key_size:int>"


def _known(name: Column, table: dict) -> Column:
    items = F.create_map(*[x for k, (a, n) in table.items() for x in (F.lit(k), F.struct(F.lit(a).alias("algorithm"), F.lit(n).cast("int").alias("key_size")))])
    return F.try_element_at(items, name)


def _pair(algorithm: Column, size: Column | None = None) -> Column:
    return F.struct(algorithm.alias("algorithm"), (F.lit(None) if size is None else size).cast("int").alias("key_size"))


def ssh_name(name: Column, role: Column) -> Column:
    """algorithm and key_size of a name in a list of SSH; a name that isn't known stays as it is, pseudo names and 'none' are null."""
    plain = F.trim(name)
    pseudo = plain.rlike(r"^(?:|ext-info-[cs]|kex-strict-[cs](?:-v00@openssh\.com)?)$") | ((plain == "none") & role.isin("cipher", "mac"))
    aes = F.nullif(F.regexp_extract(plain, r"^aes(128|192|256)-(?:ctr|cbc|gcm@openssh\.com)$", 1), F.lit(""))
    mac = F.when(plain.rlike(r"^hmac-(?:md5|sha1|sha2-256|sha2-512|ripemd160)(?:-96)?(?:-etm@openssh\.com)?$"), "HMAC").otherwise(F.upper(F.substring_index(plain, "@", 1)))
    found = (
        F.when(role == "kex", _known(plain, SSH_KEX)).when(role == "host_key", _known(F.replace(plain, F.lit("-cert-v01@openssh.com"), F.lit("")), SSH_HOST_KEYS))
        .when(role == "mac", _pair(mac)).when(aes.isNotNull(), _pair(F.concat(F.lit("AES-"), aes), aes)).otherwise(_known(plain, SSH_CIPHERS))
    )
    return F.when(~pseudo, F.coalesce(found, _pair(plain)))


def tls_group(name: Column) -> Column:
    """algorithm and key_size of a named group as OpenSSL, nginx, Apache, HAProxy and Java spell it; null for what is excluded or left to defaults."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"^[?*]+", "")
    return F.when(~key.rlike(r"^(?:$|!|-|default)"), F.coalesce(_known(key, TLS_GROUPS), _pair(F.trim(name))))


def format_of(path: Column, text: Column) -> Column:
    """The format of a configuration file: by its name first, then by the first mark that its text holds; null for others."""
    name = F.lower(F.substring_index(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), ":", 1))
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for pair in FILE_NAMES.items() for x in pair]), name)
    by_text = reduce(lambda rest, m: F.when(text.rlike(m[1]), m[0]).otherwise(rest), reversed(MARKS), F.lit(None).cast("string"))
    return F.coalesce(by_name, F.when(name.endswith(".tf"), "terraform"), by_text)


def protocol(token: Column) -> Column:
    """A protocol version as the other files spell it."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(token), r"^[\";]+|[\";]+$", ""), r"^\++", "")
    return F.when(plain == "TLSv1", "TLSv1.0").otherwise(plain)


def enabled(value: Column) -> Column:
    """What a line like 'all -TLSv1 +TLSv1.1' leaves enabled, token by token from the left."""

    def step(on: Column, token: Column) -> Column:
        name = F.regexp_replace(token, r"^[+-]", "")
        names = F.when(F.lower(name) == "all", F.array(*map(F.lit, VERSIONS))).otherwise(F.array(protocol(name)))
        return F.when(token.startswith("-"), F.array_except(on, names)).otherwise(F.array_union(on, names))

    return F.aggregate(_words(value, r"\s+"), F.array().cast("array<string>"), step)


def _words(value: Column, between: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.trim(value), r"^[\"';]+|[\"';]+$", ""), between), lambda t: t != "")


def lines(texts: DataFrame) -> DataFrame:
    """texts: path, text. key (of the file), path, format, line, raw: lines of files whose format is known, comments and empty ones left out."""
    known = texts.withColumn("format", format_of(F.col("path"), F.col("text"))).where("format is not null")
    keyed = written(known.select("path", "format", "text", F.monotonically_increasing_id().alias("key")), "configs")
    # Java joins lines that end in a backslash; spaces stand for the line's end so that later lines keep their numbers.
    text = F.when(F.col("format") == "java", F.regexp_replace("text", r"\\[ \t\r]*\n[ \t]*", " ")).otherwise(F.col("text"))
    rows = keyed.select("key", "path", "format", F.posexplode(F.split(text, "\r?\n")).alias("n", "raw"))
    return rows.where(~F.trim("raw").rlike(r"^(?:$|#|;|//)")).select("key", "path", "format", (F.col("n") + 1).alias("line"), "raw")


def settings(rows: DataFrame) -> DataFrame:
    """key, path, format, line, kind, directive, value. kind: protocols, enabled, minimum, ciphers, groups, disabled, or a list of SSH."""
    said = F.trim("raw")
    take = lambda pattern, n: F.regexp_extract(said, pattern, n)
    one = lambda kind, directive, value: F.struct(kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"), directive.alias("directive"), value.alias("value"))
    none = F.array().cast("array<struct<kind:string,directive:string,value:string>>")
    by_word = lambda word, table: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(word))
    commands = {"groups": "groups", "curves": "groups", "minprotocol": "minimum", "cipherstring": "ciphers", "ciphersuites": "ciphers"}

    pair = r"^(\S+)\s+(.+)$"
    ssh = F.array(one(by_word(take(pair, 1), {k: v[0] for k, v in SSH_LISTS.items()}), take(pair, 1), take(pair, 2)))
    plain, command = r"^(ssl_protocols|ssl_ciphers|ssl_ecdh_curve|proxy_ssl_protocols|proxy_ssl_ciphers)\s+([^;]+);?", r"^ssl_conf_command\s+((?i:Groups|Curves|MinProtocol))\s+([^;]+);?"
    kinds = {"ssl_protocols": "protocols", "proxy_ssl_protocols": "protocols", "ssl_ciphers": "ciphers", "proxy_ssl_ciphers": "ciphers", "ssl_ecdh_curve": "groups"}
    nginx = F.array(one(by_word(take(plain, 1), kinds), take(plain, 1), take(plain, 2)), one(by_word(take(command, 1), commands), F.concat(F.lit("ssl_conf_command "), take(command, 1)), take(command, 2)))
    inner = r"^\S+\s+\"?(\S+)\s+(.+)$"
    suites = F.regexp_replace(F.regexp_replace(take(pair, 2), r"^\"|\"$", ""), r"^(?:SSL|TLSv1\.3)\s+(?=\S)", "")
    word = F.lower(take(pair, 1))
    apache = F.array(
        F.when(word.isin("sslprotocol", "sslproxyprotocol"), one("enabled", take(pair, 1), F.regexp_replace(take(pair, 2), '"', ""))).when(word.isin("sslciphersuite", "sslproxyciphersuite"), one("ciphers", take(pair, 1), suites))
        .when(word == "sslopensslconfcmd", one(by_word(take(inner, 1), commands), F.concat(F.lit("SSLOpenSSLConfCmd "), take(inner, 1)), take(inner, 2)))
    )
    default = r"^(ssl-default-(?:bind|server)-ciphers(?:uites)?)\s+(\S+)"
    each = lambda kind, directive, pattern: F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(1)), lambda v: one(kind, F.lit(directive), v))
    haproxy = F.concat(F.array(F.when(said.rlike(default), one("ciphers", take(default, 1), take(default, 2)))), each("minimum", "ssl-min-ver", r"\bssl-min-ver\s+(\S+)"), each("groups", "curves", r"\bcurves\s+(\S+)"))
    equals = r"^((?i:MinProtocol|CipherString|Ciphersuites|Groups|Curves))\s*=\s*(.+)"
    openssl = F.array(one(by_word(take(equals, 1), commands), take(equals, 1), take(equals, 2)))
    prop = r"^jdk\.tls\.disabledAlgorithms\s*=\s*(.+)$"
    java = F.array(F.when(said.rlike(prop), one("disabled", F.lit("jdk.tls.disabledAlgorithms"), take(prop, 1))))
    by_format = reduce(lambda rest, x: F.when(F.col("format") == x[0], x[1]).otherwise(rest), [("ssh", ssh), ("nginx", nginx), ("apache", apache), ("haproxy", haproxy), ("openssl", openssl), ("java", java)], none)
    return rows.select("key", "path", "format", "line", F.explode(by_format).alias("s")).where("s.kind is not null").select("key", "path", "format", "line", "s.*")


FOUND = "struct<token:string,position:int,algorithm:string,key_size:int,protocol:string,cipher_suite:string,usage:string>"


def findings(rows: DataFrame) -> DataFrame:
    """rows: settings. path, format, line, directive, token, position, algorithm, key_size, protocol, cipher_suite, usage, confidence: each
    thing that a setting names or lets through. Of protocols those that are out of date; a line says a thing once."""
    kind, value = F.col("kind"), F.col("value")
    nothing = F.lit(None).cast("string")

    def found(token, position, name=None, protocol=nothing, suite=nothing, usage="encryption"):
        name = _pair(nothing) if name is None else name
        return F.struct(token, position, name["algorithm"], name["key_size"], protocol, suite, usage if isinstance(usage, Column) else F.lit(usage)).cast(FOUND)

    def version(v: Column, n: Column) -> Column:
        return F.when(v.isin(*OLD), found(v, F.lit(None), protocol=v))

    def cipher(token: Column, n: Column) -> Column:
        upper = F.upper(token)
        named = F.when(upper.isin(*WEAK_ALGORITHMS), found(token, n, _pair(upper))).when(upper.isin(*WEAK_GROUPS), found(token, n, suite=token))
        group = upper.isin(*GROUP_WORDS) | upper.startswith("SECLEVEL") | upper.contains("=")
        return F.when(~token.rlike(r"^[!@+-]"), named.when(~group & (token.contains("-") | upper.startswith("TLS_")), found(token, n, suite=token)))

    ssh_usage = F.try_element_at(F.create_map(*[F.lit(x) for role, usage in dict(SSH_LISTS.values()).items() for x in (role, usage)]), kind)
    ssh = F.transform(F.filter(F.split(value, ","), lambda t: t != ""), lambda t, n: found(F.regexp_replace(t, r"^[-^]?\+?", ""), n, ssh_name(F.regexp_replace(t, r"^[-^]?\+?", ""), kind), usage=ssh_usage))
    disabled = F.transform(_words(value, r"\s*,\s*"), lambda t: F.substring_index(F.trim(t), " ", 1))
    kept = F.array(*[F.when(~F.array_contains(disabled, F.lit(k)), found(F.lit(k if p is None else p), F.lit(None), _pair(F.lit(a).cast("string")), F.lit(p).cast("string"))) for k, (p, a) in JAVA_MUST_DISABLE.items()])
    small = F.filter(F.regexp_extract_all(value, F.lit(r"RSA keySize\s*<\s*(\d+)"), F.lit(1)), lambda n: n.try_cast("int") < 2048)
    java = F.concat(kept, F.transform(small, lambda n: found(F.concat(F.lit("RSA keySize < "), n), F.lit(None), _pair(F.lit("RSA"), n.try_cast("int")), usage="signing")))
    least = protocol(value)
    groups = F.transform(_words(value, r"[,:\s]+"), lambda t, n: F.when(tls_group(t).isNotNull(), found(t, n, tls_group(t), usage="key_exchange")))
    every = (
        F.when(kind == "protocols", F.transform(_words(value, r"\s+"), lambda t, n: version(protocol(t), n))).when(kind == "enabled", F.transform(enabled(value), version)).when(kind == "minimum", F.array(F.when(least != "SSLv2", version(least, F.lit(0)))))
        .when(kind == "ciphers", F.transform(_words(value, r"[:,\s]+"), cipher)).when(kind == "groups", groups).when(kind == "disabled", java).otherwise(ssh)
    )
    out = rows.select("key", "path", "format", "line", "directive", F.explode(F.array_compact(every)).alias("f")).select("key", "path", "format", "line", "directive", "f.*")
    named = out.where("algorithm is not null or protocol is not null or cipher_suite is not null")
    by = ["key", "line", "directive", "token", "algorithm", "protocol", "cipher_suite"]
    rest = [c for c in named.columns if c not in by]
    once = named.groupBy(*by).agg(F.min_by(F.struct(*rest), F.coalesce("position", F.lit(0))).alias("r"))
    return once.select("r.path", "r.format", "line", "directive", "token", "r.position", "algorithm", "r.key_size", "protocol", "cipher_suite", "r.usage", F.lit(CONFIDENCE).alias("confidence"))


def _weak(ciphers: Column) -> Column:
    on = F.filter(_words(ciphers, r"[:,\s]+"), lambda t: ~t.rlike(r"^[!@+-]"))
    return F.exists(on, lambda t: reduce(lambda a, b: a | b, [F.upper(t).contains(w) for w in WEAK_PARTS]))


def declarations(rows: DataFrame, inherit: bool = True) -> DataFrame:
    """rows: lines. path, line, kind (tls_policy, ssh_policy), format, hosts, protocols, ciphers, weak_enabled, kex: what files declare for hosts.

    One row for each server block of nginx and each virtual host of Apache that says something of protocols or ciphers (a file
    without virtual hosts is one), and for an SSH file that lists key exchanges. A server of nginx takes from the level above what
    it doesn't say itself, if `inherit`. hosts is empty where a file names none.
    """
    no_list = F.array().cast("array<string>")
    order = Window.partitionBy("key").orderBy("line")
    matches = lambda column, pattern, n=1: F.nullif(F.regexp_extract(column, pattern, n), F.lit(""))

    # Depth of brackets after each line; a server's block lasts until the depth is back where it began.
    nginx = rows.where("format = 'nginx'").withColumn("code", F.regexp_replace("raw", r"#.*$", ""))
    count = lambda c: F.length("code") - F.length(F.replace(F.col("code"), F.lit(c), F.lit("")))
    deep = nginx.withColumn("opened", count("{") - count("}")).withColumn("depth", F.sum("opened").over(order))
    begins = F.col("code").rlike(r"\bserver\s*\{")
    blocks = deep.withColumn("begins", begins).withColumn("block", F.count_if("begins").over(order))
    within = Window.partitionBy("key", "block").orderBy("line")
    base = F.first(F.col("depth") - F.col("opened")).over(within)
    lowest = F.min("depth").over(within.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("inside", (F.col("block") > 0) & F.coalesce(lowest > base, F.lit(True)))
    own = F.when(F.col("begins"), F.regexp_replace("code", r"^.*?\bserver\s*\{", "")).otherwise(F.col("code"))
    told = blocks.withColumn("own", own)
    value = lambda name: matches("own", rf"^\s*{name}\s+([^;]+);")
    port = matches("own", r"^\s*listen\s+(?:[\w.\[\]:]*:)?(\d+)[^;]*ssl")
    told = told.select("key", "path", "line", "block", "inside", value("server_name").alias("names"), port.alias("port"), value("ssl_protocols").alias("protocols"), value("ssl_ciphers").alias("ciphers"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c)
    names = F.filter(F.flatten(F.transform(F.collect_list("names"), lambda n: F.split(F.trim(n), r"\s+"))), lambda n: ~n.isin("_", "localhost"))
    servers = told.where("inside").groupBy("key", "path", "block").agg(F.min("line").alias("line"), names.alias("names"), F.collect_list("port").alias("ports"), first("protocols"), first("ciphers"))
    if inherit:
        above = told.where("not inside").groupBy("key").agg(first("protocols"), first("ciphers")).select("key", F.col("protocols").alias("p"), F.col("ciphers").alias("c"))
        servers = servers.join(above, "key", "left").withColumns({"protocols": F.coalesce("protocols", "p"), "ciphers": F.coalesce("ciphers", "c")})
    ports = F.when(F.size("ports") > 0, F.col("ports")).otherwise(F.array(F.lit("443")))
    hosts = F.flatten(F.transform("names", lambda n: F.transform(ports, lambda p: F.concat_ws(":", n, p))))
    versions = F.transform(_words(F.col("protocols"), r"\s+"), protocol)
    of_nginx = servers.select("path", "line", F.lit("nginx").alias("format"), hosts.alias("hosts"), versions.alias("protocols"), F.trim("ciphers").alias("ciphers"))

    apache = rows.where("format = 'apache'").withColumn("begins", F.col("raw").rlike(r"(?i)<VirtualHost")).withColumn("block", F.count_if("begins").over(order))
    ended = F.max(F.col("raw").rlike(r"(?i)</VirtualHost>")).over(Window.partitionBy("key", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    some = F.max("block").over(Window.partitionBy("key"))
    apache = apache.withColumn("inside", F.when(some == 0, True).otherwise((F.col("block") > 0) & ~F.coalesce(ended, F.lit(False))))
    word = lambda name, rest=r"(.+)$": matches("raw", rf"(?i)^\s*{name}\s+{rest}")
    said = apache.where("inside").select("key", "path", "line", "block", word("ServerName", r"(\S+)").alias("name"), matches("raw", r"(?i)<VirtualHost\s+[^:>]*:(\d+)").alias("port"), word("SSLProtocol").alias("protocols"), word("SSLCipherSuite").alias("ciphers"))
    hosts_of = said.groupBy("key", "path", "block").agg(F.min("line").alias("line"), first("name"), first("port"), first("protocols"), first("ciphers"))
    start = F.when(F.col("block") == 0, 1).otherwise(F.col("line"))
    one_host = F.when(F.col("name").isNotNull(), F.array(F.concat_ws(":", "name", F.coalesce("port", F.lit("443"))))).otherwise(no_list)
    of_apache = hosts_of.select("path", start.alias("line"), F.lit("apache").alias("format"), one_host.alias("hosts"), enabled(F.col("protocols")).alias("protocols"), F.trim("ciphers").alias("ciphers"))

    tls = of_nginx.unionByName(of_apache).where("protocols is not null or ciphers is not null")
    tls = tls.select("path", "line", F.lit("tls_policy").alias("kind"), "format", "hosts", "protocols", "ciphers", F.coalesce(_weak(F.col("ciphers")), F.lit(False)).alias("weak_enabled"), F.lit(None).cast("array<string>").alias("kex"))
    ssh = rows.where("format = 'ssh'").select("key", "path", "line", word("KexAlgorithms", r"(\S+)").alias("kex"), word("Port", r"(\d+)").alias("port"), word("ListenAddress", r"(\S+)").alias("address"))
    lists = ssh.groupBy("key", "path").agg(F.min(F.when(F.col("kex").isNotNull(), F.col("line"))).alias("line"), first("kex"), first("port"), F.array_sort(F.collect_list(F.when(F.col("address").isNotNull(), F.struct("line", "address")))).alias("at"))
    place = lambda a: F.when(a["address"].rlike(r"^[^:]*:\d+$"), a["address"]).otherwise(F.concat_ws(":", a["address"], F.coalesce("port", F.lit("22"))))
    wanted = F.transform(F.filter(F.split("kex", ","), lambda t: t != ""), lambda t: F.regexp_replace(t, r"^[+^-]+", ""))
    shells = lists.where("kex is not null").select("path", "line", F.lit("ssh_policy").alias("kind"), F.lit("ssh").alias("format"), F.transform("at", place).alias("hosts"), F.lit(None).cast("array<string>").alias("protocols"), F.lit(None).cast("string").alias("ciphers"), F.lit(False).alias("weak_enabled"), wanted.alias("kex"))
    return tls.unionByName(shells)
