"""Verdicts on findings."""

from quantalog.operators import taxonomy


def test_findings_are_not_moved(spark):
    """names and suites are sent to the findings; only findings that share an id are gathered, and told over all that they name."""
    rows = [(1, "RSA-2048", 2048, None, None, "TLSv1.2"), (1, "AES-256", 256, None, None, "SSLv3"), (2, "AES-256", 256, None, None, "TLSv1.2"), (3, None, None, "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "X25519", None), (4, "", None, "", None, "TLSv1.3"), (None, "MD5", None, None, None, None)]
    fields = "id long, algorithm string, key_size int, cipher_suite string, key_exchange string, protocol string"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = taxonomy.classified(spark.createDataFrame(rows[1:], fields))
        assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
        got = sorted((str(r.id), r.verdict, r.driver, r.components) for r in taxonomy.classified(spark.createDataFrame(rows, fields)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("1", "classical", "SSLv3", 2), ("1", "shor", "RSA-2048", 2), ("2", "pqc", "AES-256", 1), ("3", "shor", "X25519", 5), ("4", "unknown", None, 0), ("None", "unknown", None, 0)]
