"""Configuration files and the library knowledge base: cases that the queries' files don't hold."""

import itertools

import pytest
from pyspark.sql import functions as F

from quantalog.operators import configs, libraries


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


@pytest.mark.parametrize(
    ("path", "text", "expected"),
    [
        ("/etc/ssh/SSHD_CONFIG", "", "ssh"), ("C:\\x\\nginx.conf:3", "", "nginx"), ("a.tf", "KexAlgorithms x", "terraform"), ("x", "  kexalgorithms a", "ssh"), ("x", "a\n ssl_ciphers b", "nginx"), ("x", "sslprotocol all", "apache"),
        ("x", "  ssl-default-bind-options a", "haproxy"), ("x", "ike=aes", "ipsec"), ("x", " esp_proposals = a", "swanctl"), ("x", "MinProtocol=a", "openssl"), ("x", "#jdk.tls.disabledAlgorithms", "java"), ("x", "plain", None), ("x", "ssh_ciphersx", None), (None, None, None),
    ],
)
def test_formats(spark, path, text, expected):
    assert texts(spark, (path, text)).select(configs.format_of(F.col("path"), F.col("text")).alias("f")).first().f == expected


def declared(spark, text, path="nginx.conf", **options):
    rows = configs.declarations(configs.lines(texts(spark, (path, text))), **options).orderBy("line").collect()
    return [(r.line, r.hosts, r.protocols, r.ciphers) for r in rows]


NGINX = """ssl_protocols TLSv1.3;
http {
  ssl_ciphers "RC4:AES";
  server { listen 443;
    listen [::]:9443 ssl http2;
    server_name a.x; if ($x) { return 1; }
    # } server { server_name no.x;
    location / {
      ssl_protocols TLSv1; }
  }
  upstream u { server 10.0.0.1:80; }
  server
  { listen 1 ssl; }
  server {
    server_name localhost _;
    ssl_protocols SSLv3; }
  ssl_ecdh_curve x25519;
}
"""


def test_nginx_blocks(spark):
    """A block ends with its own bracket; what stands above counts where the server says nothing. The first directive that begins a line of the block counts, nested or not."""
    assert declared(spark, NGINX) == [(4, ["a.x:9443"], ["TLSv1.0"], '"RC4:AES"'), (14, [], ["SSLv3"], '"RC4:AES"')]
    assert declared(spark, NGINX, inherit=False) == [(4, ["a.x:9443"], ["TLSv1.0"], None), (14, [], ["SSLv3"], None)]


def test_apache_and_ssh_hosts(spark):
    text = "SSLProtocol all -SSLv3\nServerName top\n"
    assert declared(spark, text, "httpd.conf") == [(1, ["top:443"], ["TLSv1.0", "TLSv1.1", "TLSv1.2", "TLSv1.3"], None)]
    two = "<VirtualHost *:8443>\nServerName a\nSSLProtocol +TLSv1.2\n</VirtualHost>\nSSLProtocol all\n<virtualhost 1.2.3.4>\nSSLCipherSuite NULL\n</VirtualHost>"
    assert declared(spark, two, "httpd.conf") == [(1, ["a:8443"], ["TLSv1.2"], None), (6, [], None, "NULL")]
    ssh = "KexAlgorithms ^a,+b,c\nListenAddress 1.1.1.1:99\nListenAddress ::1\nListenAddress h\n"
    (row,) = configs.declarations(configs.lines(texts(spark, ("sshd_config", ssh)))).collect()
    assert (row.hosts, row.kex, row.kind) == (["1.1.1.1:99", "::1:22", "h:22"], ["a", "b", "c"], "ssh_policy")


def test_nothing_and_repeats(spark):
    rows = texts(spark, ("nginx.conf", None), ("nginx.conf", ""), (None, "ssl_protocols TLSv1 TLSv1;"), ("nginx.conf", "ssl_protocols TLSv1;"), ("nginx.conf", "ssl_protocols TLSv1;"))
    found = configs.findings(configs.settings(configs.lines(rows))).collect()
    assert sorted((r.path or "", r.protocol) for r in found) == [("", "TLSv1.0"), ("nginx.conf", "TLSv1.0"), ("nginx.conf", "TLSv1.0")]
    assert configs.findings(configs.settings(configs.lines(rows.limit(0)))).count() == 0
    assert configs.declarations(configs.lines(rows)).count() == 0


def test_cipher_words(spark):
    text = 'ssl_ciphers "kEECDH+AES:!RC4:-DES:+3DES:@STRENGTH:exp:rc4:TLS_X:A-B:seclevel=0:aNULL";'
    found = configs.findings(configs.settings(configs.lines(texts(spark, ("nginx.conf", text))))).collect()
    assert sorted((r.token, r.position, r.algorithm, r.cipher_suite) for r in found) == [("A-B", 8, None, "A-B"), ("TLS_X", 7, None, "TLS_X"), ("aNULL", 10, None, "aNULL"), ("exp", 5, None, "exp"), ("rc4", 6, "RC4", None)]


def test_ssh_names(spark):
    cases = {
        ("kex", "mlkem1024nistp384-sha384"): ("SECP384R1MLKEM1024", None), ("kex", "new"): ("new", None), ("kex", "kex-strict-s-v00@openssh.com"): None, ("host_key", "ssh-rsa-cert-v01@openssh.com"): ("RSA", None), ("cipher", "aes128-ctr"): ("AES-128", 128),
        ("cipher", "none"): None, ("mac", "hmac-sha2-256-etm@openssh.com"): ("HMAC", None), ("mac", "umac-64@openssh.com"): ("UMAC-64", None), ("cipher", ""): None,
    }
    rows = spark.createDataFrame(list(cases), "role string, name string").select("role", "name", configs.ssh_name(F.col("name"), F.col("role")).alias("n")).collect()
    assert {(r.role, r["name"]): r.n and tuple(r.n) for r in rows} == cases


def test_versions_sort(spark):
    order = ["0.9", "1.2", "1.10~rc1", "1.24", "v1.24.1", "go1.25", "2", "3.0.18-1~deb12", "3.5.0", "3.5.0.1", "10", "20240101123456789.1"]
    rows = spark.createDataFrame([(v, n) for n, v in enumerate(order)], "v string, n int").withColumn("k", libraries.version_key(F.col("v"))).collect()
    keys = [r.k for r in sorted(rows, key=lambda r: r.n)]
    assert all(a < b for a, b in itertools.pairwise(keys)) and keys[7] == [3, 0, 18, 0]
    odd = spark.createDataFrame([("",), (None,), ("x",), ("1.1.1w",)], "v string").select(libraries.version_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in odd] == [None, None, None, [1, 1, 1, 0]]


def test_borders_of_lines(spark):
    base = libraries.KnowledgeBase(spark)
    cases = [
        ("openssl", "deb", "3.4.9", False), ("openssl", "deb", "3.5", True), ("openssl", None, "3.5.0-1", True), ("openssl", "deb", None, None), ("bouncycastle", "maven", "1.79", True), ("bouncycastle", "maven", "1.78.1", False),
        ("bouncycastle", "nuget", "9", None), ("bouncycastle", None, "9", None), ("python-rsa", "pypi", None, False), ("liboqs", "pypi", None, True), ("symmetric-only", "npm", None, True), ("boringssl", None, "1", None),
    ]
    rows = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, library string, ecosystem string, version string")
    assert {r.n: r.capable for r in libraries.with_readiness(rows, base).collect()} == {n: c[3] for n, c in enumerate(cases)}


def test_packages(spark):
    rows = [("a/lock", "pypi", "PyJWT", "2.8", None, True, False, 1), ("a/list", "pypi", "pyjwt", None, ">=2", False, True, 0), ("b", "pypi", "PyNaCl", None, None, False, False, 0), ("b", "npm", "PyNaCl", "1", None, True, True, 0), (None, "cargo", "ring", "1", None, True, True, 0), ("c", None, None, None, None, False, False, 0)]
    df = spark.createDataFrame(rows, "path string, ecosystem string, name string, version string, spec string, exact boolean, direct boolean, pos long")
    found = {(r.project, r.package): (r.version, r.manifests, r.verdict, r.display) for r in libraries.library_findings(df, libraries.KnowledgeBase(spark)).collect()}
    assert found == {("a", "pyjwt"): ("2.8", 2, "unknown", "PyJWT 2.8 (pypi)"), ("", "pynacl"): (None, 1, "unknown", "PyNaCl (version unknown) (pypi)"), (None, "ring"): ("1", 0, "unknown", "ring 1 (cargo)")}
    assert libraries.library_findings(df.limit(0), libraries.KnowledgeBase(spark)).count() == 0
