"""Queries on functions, sensitivity, intake, coverage and exports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.functions import text
from quantalog.functions.curve import survival_sql
from quantalog.operators import intake, sensitivity, threats
from quantalog.plans.risk import ASSETS_SQL, scored
from quantalog.sources import estate, exports

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _family_sql(t: str) -> dict[str, str]:
    late = f"greatest({t}, 0.0)"
    return {
        "median": survival_sql(t, "median"), "optimistic": survival_sql(t, "optimistic"), "pessimistic": survival_sql(t, "pessimistic"),
        "exponential": f"exp(-0.0385 * {late})", "weibull_steep": f"exp(-pow({late} / 20.0, 3.5))",
        "gompertz": f"exp(-(0.012 / 0.115) * (exp(0.115 * {late}) - 1.0))", "log_logistic": f"1.0 / (1.0 + pow({late} / 16.0, 2.2))",
    }


_H, _T = _family_sql("(x_c + y)"), _family_sql("least(x_i, y)")


@query(f"WITH {ASSETS_SQL} SELECT family, CAST(count(*) AS BIGINT) AS n, round(CAST(avg(CAST(score AS DECIMAL(38, 10))) AS DOUBLE), 5) AS mean, max(score) AS most FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS family, round(0.5 * s * e * (1 - {_H[f]}) + 0.5 * c * (1 - {_T[f]}), 6) AS score FROM assets WHERE quantum_vulnerable" for f in _H) + ") GROUP BY family")
def curve_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under curves of other shapes."""
    rows = sensitivity.by_family(scored(spark, sf_dir).where("quantum_vulnerable"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("decimal(38,10)")).cast("double"), 5).alias("mean"), F.max("score").alias("most"))


@query(f"WITH {ASSETS_SQL}, v AS (SELECT id || '/' || system AS id, h_score, t_score FROM assets WHERE quantum_vulnerable), w AS (SELECT i / 10 AS w, id, round(i / 10 * h_score + (1 - i / 10) * t_score, 6) AS score FROM v, range(11) r(i)) SELECT * FROM (SELECT w, id, score, row_number() OVER (PARTITION BY w ORDER BY score DESC, id) AS rank FROM w) WHERE rank <= 10")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("quantum_vulnerable").withColumn("id", F.concat_ws("/", "id", "system"))
    return sensitivity.weight_sweep(rows)


@query("WITH c AS (SELECT c_custkey AS a, c_acctbal AS b FROM customer) SELECT CAST((SELECT count(*) FROM c x JOIN c y ON x.a < y.a AND x.b > y.b) AS BIGINT) AS inversions, CAST((SELECT count(*) * (count(*) - 1) // 2 FROM c) AS BIGINT) AS pairs")
def inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers that two measures order otherwise."""
    return sensitivity.inversions(estate.table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


INTAKE_SQL = """i AS (SELECT CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id, o_orderkey AS seq, o_totalprice / 400000 AS value FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM i), q AS (SELECT seq, id, CASE WHEN id IS NULL THEN 'missing id' WHEN r > 1 THEN 'duplicate id' WHEN value < 0 OR value > 1 THEN 'value out of range' END AS reason FROM n)"""


@query(f"WITH {INTAKE_SQL} SELECT * FROM q WHERE reason IS NOT NULL")
def intake_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not taken in, and why."""
    k = F.col("o_orderkey")
    rows = estate.table(spark, sf_dir, "orders").select(F.when(k % 41 == 0, None).when(k % 29 == 0, k - 1).otherwise(k).alias("id"), k.alias("seq"), (F.col("o_totalprice") / 400000).alias("value"))
    return intake.judged(rows, ["value"]).where("reason is not null").select("seq", "id", "reason")


@query("""WITH r(ref) AS (SELECT UNNEST(['Customer#000000007', 'customer#000000012', '#000000019', '0000001', 'nobody'])),
t AS (SELECT ref, c_custkey AS id, CASE WHEN c_name = ref THEN 1 WHEN lower(c_name) = lower(ref) THEN 2 WHEN contains(lower(c_name), lower(ref)) THEN 3 END AS tier FROM r JOIN customer ON contains(lower(c_name), lower(ref))),
b AS (SELECT ref, tier, count(*) AS n, min(id) AS id FROM t GROUP BY ref, tier), m AS (SELECT *, min(tier) OVER (PARTITION BY ref) AS best FROM b)
SELECT ref, CASE WHEN tier < 3 OR n = 1 THEN id END AS id, CAST(tier AS INTEGER) AS tier FROM m WHERE tier = best""")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By exact name, by name, else by a part if only one has it."""
    refs = spark.createDataFrame([(r,) for r in ("Customer#000000007", "customer#000000012", "#000000019", "0000001", "nobody")], "ref string")
    names = estate.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return intake.tiered_lookup(refs, names)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, year(d) + (dayofyear(d) - 1) / 365.25 AS fractional, date_diff('day', d, DATE '1997-01-01') AS days, CASE WHEN date_diff('day', d, DATE '1997-01-01') % 7 = 0 THEN upper(o_orderstatus) ELSE lower(o_orderstatus) END AS mark
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fractional_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    days = F.datediff(F.lit("1997-01-01").cast("date"), d)
    rows = estate.table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), text.fractional_year(d).alias("fractional"), days.cast("bigint").alias("days"), F.when(days % 7 == 0, F.upper("o_orderstatus")).otherwise(F.lower("o_orderstatus")).alias("mark"))


#: Registered names in full, and what the registry says about them (key exchange, authentication, cipher, strength, mode, hash).
SUITES = [
    ("TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", "ECDHE", "RSA", "AES", 256, "gcm", "SHA-384"),
    ("ECDHE-ECDSA-AES128-SHA256", "ECDHE", "ECDSA", "AES", 128, None, "SHA-256"),
    ("TLS_AES_128_GCM_SHA256", None, None, "AES", 128, "gcm", "SHA-256"),
    ("TLS_RSA_WITH_3DES_EDE_CBC_SHA", "RSA", "RSA", "3DES", 112, "cbc", "SHA-1"),
    ("DHE-RSA-CHACHA20-POLY1305", "DHE", "RSA", "CHACHA20", 256, None, "HMAC"),
    ("RC4-MD5", "RSA", None, "RC4", 128, None, "MD5"),
    ("TLS_CHACHA20_POLY1305_SHA256", None, None, "CHACHA20", 256, None, "SHA-256"),
    ("TLS_RSA_WITH_AES_128_CBC_SHA256", "RSA", "RSA", "AES", 128, "cbc", "SHA-256"),
    ("TLS_ECDH_ECDSA_WITH_AES_256_CCM", "ECDH", "ECDSA", "AES", 256, "ccm", None),
    ("TLS_PSK_WITH_AES_128_GCM_SHA256", "PSK", None, "AES", 128, "gcm", "SHA-256"),
    ("DES-CBC3-SHA", "RSA", None, "3DES", 112, "cbc", "SHA-1"),
    ("TLS_DHE_DSS_WITH_AES_256_CBC_SHA256", "DHE", "DSA", "AES", 256, "cbc", "SHA-256"),
]


@query("WITH r(suite, key_exchange, authentication, bulk_cipher, bulk_key_bits, mode, mac) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in SUITES)
  + f") SELECT p_partkey AS id, r.* EXCLUDE (suite) FROM part JOIN r ON suite = {estate.pick_sql([r[0] for r in SUITES], f'p_partkey % {len(SUITES)}')}")
def cipher_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites taken apart."""
    suite = estate.pick([r[0] for r in SUITES], F.col("p_partkey") % len(SUITES))
    return estate.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.cipher_suite(suite).alias("s")).select("id", "s.*")


@query(f"WITH {ASSETS_SQL}, c AS (SELECT 'asset/' || id AS ref, name, 'cryptographic-asset' AS type, asset_class AS detail FROM assets UNION ALL SELECT 'algorithm/' || lower(algorithm), algorithm, 'algorithm', primitive FROM assets) SELECT ref, arg_min(name, struct_pack(a := name, b := type, c := detail)) AS name, min(type) AS type, arg_min(detail, struct_pack(a := name, b := type, c := detail)) AS detail FROM c GROUP BY ref")
def export_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the exported document, one for each reference."""
    return exports.components(scored(spark, sf_dir))


@query(f"WITH {ASSETS_SQL} SELECT need AS rule, CASE WHEN risk_level IN ('critical', 'high') THEN 'error' WHEN risk_level = 'medium' THEN 'warning' ELSE 'note' END AS level, id, regexp_replace(host, ':[0-9]+$', '') AS uri FROM assets WHERE need IS NOT NULL")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.report_rows(scored(spark, sf_dir))


@query(f"""WITH {ASSETS_SQL}, e AS (SELECT system, count(*) AS assets, CAST(count_if(quantum_vulnerable) AS BIGINT) AS vulnerable, CAST(count_if(behind) AS BIGINT) AS behind, max(qirs) AS worst FROM assets GROUP BY system)
SELECT coalesce(e.system, d.system) AS system, coalesce(assets, 0) AS assets, coalesce(vulnerable, 0) AS vulnerable, coalesce(behind, 0) AS behind, coalesce(worst, 0.0) AS worst, d.system IS NOT NULL AS declared
FROM e FULL JOIN (SELECT 'sys' || CAST(s_suppkey AS VARCHAR) AS system FROM supplier WHERE s_suppkey % 10 <> 0) d ON e.system = d.system""")
def exposure_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure of systems, those that nobody declared and those that nobody saw included."""
    found = scored(spark, sf_dir).groupBy("system").agg(F.count("*").alias("assets"), F.count_if("quantum_vulnerable").alias("vulnerable"), F.count_if("behind").alias("behind"), F.max("qirs").alias("worst"))
    s = F.col("s_suppkey")
    said = estate.table(spark, sf_dir, "supplier").where(s % 10 != 0).select(F.concat(F.lit("sys"), s.cast("string")).alias("system"), F.lit(True).alias("declared"))
    return found.join(said, "system", "full_outer").na.fill({"assets": 0, "vulnerable": 0, "behind": 0, "worst": 0.0, "declared": False})


_AGILITY_SQL = "CASE asset_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.AGILITY.items()) + " ELSE 'coordinated' END"


@query(f"""WITH {ASSETS_SQL}, r(threat, title, status, place) AS (VALUES {", ".join(f"('{k}', '{t}', '{st}', {K.THREAT_STATUSES.index(st)})" for k, (t, st) in K.THREATS.items())}),
c AS (SELECT 'pqc_side_channel' AS threat, count(*) AS n, 1 AS least FROM assets WHERE NOT quantum_vulnerable AND verdict = 'pqc'
  UNION ALL SELECT 'lattice_cryptanalysis_immaturity', count(*), 1 FROM assets WHERE NOT quantum_vulnerable AND verdict = 'pqc'
  UNION ALL SELECT 'pqc_side_channel', count(*), 1 FROM assets WHERE asset_class IN {K.HARDWARE_CLASSES}
  UNION ALL SELECT 'retroactive_hndl', count(*), 1 FROM assets WHERE x_c >= 8
  UNION ALL SELECT 'agility_debt', count(*), 1 FROM assets WHERE asset_class IN ('issuing_ca', 'code_signing', 'root_ca')
  UNION ALL SELECT 'threat_model_drift', count(*), 0 FROM assets WHERE quantum_vulnerable)
SELECT threat, title, status, CAST(max(n) AS BIGINT) AS exposed, CAST(row_number() OVER (ORDER BY min(place), max(n) DESC, threat) AS INTEGER) AS place FROM c JOIN r USING (threat) WHERE n >= least GROUP BY threat, title, status""")
def threat_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threats that apply after migration, on what is counted in the estate, in one pass."""
    return threats.assessment(scored(spark, sf_dir))


@query(f"WITH {ASSETS_SQL}, b AS (SELECT {_AGILITY_SQL} AS band, count(*) AS n FROM assets GROUP BY 1) SELECT l.band, l.now AS actionable_now, CAST(coalesce(n, 0) AS BIGINT) AS n, round(100.0 * sum(CASE WHEN l.now THEN coalesce(n, 0) ELSE 0 END) OVER () / sum(coalesce(n, 0)) OVER (), 1) AS actionable_pct FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {str(v).lower()})' for k, v in K.AGILITY_BANDS.items())}) l(band, now) LEFT JOIN b USING (band)")
def agility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the estate can be changed now, band by band."""
    return threats.agility(scored(spark, sf_dir))


@query("""WITH h AS (SELECT p_brand AS pack, p_type AS item, p_partkey AS seq, p_size % 5 AS precedence, p_retailprice AS value FROM part)
SELECT item, arg_min(pack, struct_pack(a := precedence, b := seq)) AS pack, arg_min(value, struct_pack(a := precedence, b := seq)) AS value FROM h GROUP BY item""")
def pack_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs in order of precedence; the first wins for each item."""
    rows = estate.table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), F.col("p_type").alias("item"), F.col("p_partkey").alias("seq"), (F.col("p_size") % 5).alias("precedence"), F.col("p_retailprice").alias("value"))
    return rows.groupBy("item").agg(F.min_by(F.struct("pack", "value"), F.struct("precedence", "seq")).alias("p")).select("item", "p.*")


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
