"""Queries on evidence, identity, snapshots, certification and graphs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.operators import certify, graph, joins
from quantalog.sources import estate
from quantalog.sources.estate import FINDINGS_SQL

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# Sensor readings: all findings about one part are about one asset.
READINGS_SQL = f"""{FINDINGS_SQL}, readings AS (
  SELECT 'p' || CAST(partkey AS VARCHAR) AS asset_id, source_type AS source, plane, confidence, provenance, CASE WHEN suppkey % 7 = 0 THEN 'safe' ELSE 'vulnerable' END AS claim FROM findings)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estate.findings(spark, sf_dir)
    claim = F.when(F.col("suppkey") % 7 == 0, "safe").otherwise("vulnerable")
    return rows.select(F.concat(F.lit("p"), F.col("partkey").cast("string")).alias("asset_id"), F.col("source_type").alias("source"), "plane", "confidence", "provenance", claim.alias("claim"))


@query(f"""WITH {READINGS_SQL},
l AS (SELECT asset_id, arg_max(claim, struct_pack(a := confidence, b := claim = 'vulnerable', c := claim)) AS lead, count(*) AS readings, count(DISTINCT claim) AS claims FROM readings GROUP BY asset_id),
p AS (SELECT r.asset_id, plane, max(confidence) AS best FROM readings r JOIN l USING (asset_id) WHERE claim = lead GROUP BY ALL),
f AS (SELECT asset_id, product(1 - least(greatest(best, 0.0), 1.0)) AS miss, count(*) AS planes, max(best) AS best FROM p GROUP BY asset_id)
SELECT asset_id, lead AS claim, round(least(1 - miss, 0.99), 4) AS confidence, readings, planes, claims > 1 AS disagreement,
  claims > 1 OR round(least(1 - miss, 0.99), 4) < 0.5 OR (planes = 1 AND best < 0.7) AS flagged FROM l JOIN f USING (asset_id)""")
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or confidence over evidence planes."""
    return joins.corroborated(readings(spark, sf_dir))


@query(f"""WITH {READINGS_SQL}, g AS (SELECT asset_id, max(confidence) AS best, count(DISTINCT provenance) AS methods FROM readings GROUP BY asset_id)
SELECT asset_id, methods, round(CASE WHEN methods = 1 THEN best ELSE least(best + 0.06 * (methods - 1), greatest(best, 0.95)) END, 4) AS confidence FROM g""")
def method_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.method_bonus(readings(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estate.findings(spark, sf_dir)
    return rows.select(F.concat_ws("/", "id", F.col("partkey").cast("string"), F.col("suppkey").cast("string")).alias("id"), "plane", "confidence", "system")


@query(f"""WITH {FINDINGS_SQL}, m AS (SELECT id || '/' || CAST(partkey AS VARCHAR) || '/' || CAST(suppkey AS VARCHAR) AS id, plane, confidence, system FROM findings)
SELECT system, arg_min(id, struct_pack(a := -confidence, b := -list_position(['declared', 'built', 'held', 'observed'], plane), c := id)) AS best_id, count(*) AS members FROM m GROUP BY system""")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-evidenced finding of each system."""
    return joins.best_member(_members(spark, sf_dir), "system")


@query("""WITH RECURSIVE k AS (SELECT o_orderkey AS id, 'c' || CAST(o_custkey // 3 AS VARCHAR) AS key FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT o_orderkey, 'd' || CAST(o_orderkey // 40 AS VARCHAR) FROM orders),
s AS (SELECT key, min(id) AS least FROM k GROUP BY key), w AS (SELECT id AS a, least AS b FROM k JOIN s USING (key) UNION SELECT least, id FROM k JOIN s USING (key)),
r(id, c) USING KEY (id) AS (SELECT DISTINCT o_orderkey, o_orderkey FROM orders UNION SELECT w.b, min(r.c) FROM r JOIN w ON r.id = w.a JOIN recurring.r AS now ON now.id = w.b WHERE r.c < now.c GROUP BY w.b)
SELECT id, c AS component FROM r""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a typed key, transitively; every order has both keys, and one without a partner is its own component."""
    orders = estate.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    key = lambda kind, c, n: orders.select("id", F.lit(kind).alias("kind"), F.floor(F.col(c) / n).cast("string").alias("value"))
    found = joins.identity_components(key("c", "o_custkey", 3).unionByName(key("d", "id", 40)))
    return orders.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("""WITH f AS (SELECT DISTINCT c_nationkey AS subject, c_custkey AS id FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS n FROM f), l AS (SELECT subject, list(id ORDER BY id) AS ids FROM r WHERE n <= 11 GROUP BY subject HAVING count(*) > 1)
SELECT f.subject, f.id, array_to_string(list_filter(ids, lambda x: x <> f.id)[1:10], ',') AS others FROM f JOIN l USING (subject)""")
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten other records with the same subject."""
    rows = estate.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("id"))
    out = joins.possible_duplicates(rows)
    return rows.distinct().join(out, "id").select("subject", "id", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS scope, p_brand AS library, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'v1' ELSE 'v' || CAST(p_partkey % 2 AS VARCHAR) END AS version FROM part)
SELECT id, coalesce(version, CASE WHEN min(version) OVER w = max(version) OVER w THEN min(version) OVER w END) AS version FROM r WINDOW w AS (PARTITION BY scope, library)""")
def library_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing version is adopted where its scope knows just one."""
    p = F.col("p_partkey")
    version = F.when(p % 3 == 0, None).when(F.col("p_size") % 2 == 0, "v1").otherwise(F.concat(F.lit("v"), (p % 2).cast("string")))
    rows = estate.table(spark, sf_dir, "part").select(p.alias("id"), F.col("p_size").alias("scope"), F.col("p_brand").alias("library"), version.alias("version"))
    return joins.only_version(rows).select("id", "version")


# Two snapshots of the orders, with an overlap of ids.
SNAPSHOT_SQL = """old AS (SELECT o_orderkey AS id, o_orderpriority AS level, o_orderstatus AS status, round(o_totalprice / 1e6, 4) AS band FROM orders WHERE o_orderkey % 10 < 8),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN '9-CHANGED' ELSE o_orderpriority END AS level, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status,
  round(o_totalprice / 1e6, 4) + CASE WHEN o_orderkey % 11 = 0 THEN 0.01 ELSE 0.001 END AS band FROM orders WHERE o_orderkey % 10 > 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = estate.table(spark, sf_dir, "orders")
    k, band = F.col("o_orderkey"), F.round(F.col("o_totalprice") / 1e6 * 1e4) / 1e4  # the product is rounded, as SQL does: a half in decimals may lie below one in binary
    old = rows.where(k % 10 < 8).select(k.alias("id"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("status"), band.alias("band"))
    new = rows.where(k % 10 > 1).select(
        k.alias("id"),
        F.when(k % 13 == 0, "9-CHANGED").otherwise(F.col("o_orderpriority")).alias("level"),
        F.when(k % 17 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"),
        (band + F.when(k % 11 == 0, 0.01).otherwise(0.001)).alias("band"),
    )
    return old, new


@query(f"""WITH {SNAPSHOT_SQL}, j AS (SELECT coalesce(n.id, o.id) AS id, o.id AS oid, n.id AS nid, o.level AS ol, n.level AS nl, o.status AS os, n.status AS ns, o.band AS ob, n.band AS nb FROM old o FULL JOIN new n ON o.id = n.id)
SELECT id, 'added' AS kind, NULL AS field, NULL AS old, NULL AS new FROM j WHERE oid IS NULL UNION ALL SELECT id, 'removed', NULL, NULL, NULL FROM j WHERE nid IS NULL
UNION ALL SELECT id, 'changed', 'level', ol, nl FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND ol IS DISTINCT FROM nl
UNION ALL SELECT id, 'changed', 'status', os, ns FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND os IS DISTINCT FROM ns
UNION ALL SELECT id, 'changed', 'band', NULL, NULL FROM j WHERE oid IS NOT NULL AND nid IS NOT NULL AND abs(ob - nb) > 0.005""")
def scan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added, removed and changed, field by field; small moves of a band don't count."""
    rows = joins.delta(*snapshots(spark, sf_dir), ["level", "status"], "band")
    text = lambda c: F.when(F.col("field") != "band", F.col(c))  # noqa: E731  numbers print differently elsewhere
    return rows.withColumns({"old": text("old"), "new": text("new")})


@query(f"""WITH {SNAPSHOT_SQL}, c AS (SELECT CAST(count_if(o.id IS NOT NULL AND n.id IS NOT NULL) AS BIGINT) AS common, CAST(count_if(n.id IS NULL) AS BIGINT) AS removed, CAST(count_if(o.id IS NULL) AS BIGINT) AS added FROM old o FULL JOIN new n ON o.id = n.id)
SELECT common, removed, added, round(common / nullif(common + removed + added, 0), 6) AS jaccard, common / nullif(common + removed + added, 0) < 0.1 AS warning FROM c""")
def snapshot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlap(*snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOT_SQL} SELECT id, level, status FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.id = old.id AND new.status IS NOT DISTINCT FROM old.status) UNION ALL SELECT id, level, status FROM new")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the new snapshot doesn't replace, and the new snapshot; keys may be null."""
    old, new = (s.drop("band") for s in snapshots(spark, sf_dir))
    return joins.merged(old, new, ["id", "status"])


@query(f"""WITH {SNAPSHOT_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY band DESC, id) AS r FROM old), b AS (SELECT id, row_number() OVER (ORDER BY band DESC, id) AS r FROM new)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'entered' WHEN b.id IS NULL THEN 'left' WHEN a.r <> b.r THEN 'moved' ELSE 'same' END AS kind, a.r - b.r AS places FROM a FULL JOIN b ON a.id = b.id""")
def rank_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ranking moved between two snapshots."""
    from quantalog.operators.scoring import ranked

    a, b = (ranked(s, [-F.col("band"), F.col("id")], "r").select(F.col("id").alias(f"{n}id"), F.col("r").alias(f"{n}r")) for n, s in zip("ab", snapshots(spark, sf_dir), strict=True))
    both = a.join(b, a.aid == b.bid, "full_outer")
    kind = F.when(F.col("aid").isNull(), "entered").when(F.col("bid").isNull(), "left").when(F.col("ar") != F.col("br"), "moved").otherwise("same")
    return both.select(F.coalesce("aid", "bid").alias("id"), kind.alias("kind"), (F.col("ar") - F.col("br")).alias("places"))


# Scores of embeddings: how far the first components lean, to nine places; even ids calibrate.
SCORES_SQL = """scores AS (SELECT vec_id AS id, label % 3 AS stratum, vec_id % 2 = 0 AS calibration, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 2) AS score FROM embeddings),
pv AS (SELECT s.*, (1 + above) / (1 + n0) AS p FROM (SELECT *, CAST(sum(CAST(calibration AS INTEGER)) OVER (PARTITION BY stratum ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS above,
  CAST(sum(CAST(calibration AS INTEGER)) OVER (PARTITION BY stratum) AS DOUBLE) AS n0 FROM scores) s WHERE NOT calibration AND n0 > 0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    score = F.round(e[0].cast("double") + e[1].cast("double"), 2)
    return estate.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("stratum"), (F.col("vec_id") % 2 == 0).alias("calibration"), score.alias("score"))


@query(f"WITH {SCORES_SQL} SELECT id, stratum, round(p, 9) AS p FROM pv")
def conformal_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.conformal_p(scores(spark, sf_dir)).select("id", "stratum", F.round("p", 9).alias("p"))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER o AS rank, count(*) OVER (PARTITION BY stratum) AS m FROM pv WINDOW o AS (PARTITION BY stratum ORDER BY p, id))
SELECT id, stratum, round(least(1.0, min(p * m / rank) OVER (PARTITION BY stratum ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.bh_q(certify.conformal_p(scores(spark, sf_dir)), "stratum").select("id", "stratum", F.round("q", 9).alias("q"))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, id) AS rank, count(*) OVER (PARTITION BY stratum) AS m FROM pv)
SELECT id, stratum, rank <= coalesce(max(rank) FILTER (WHERE p <= 0.4 * rank / m) OVER (PARTITION BY stratum), 0) AS selected FROM r""")
def bh_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.bh_selected(certify.conformal_p(scores(spark, sf_dir)), "stratum", 0.4).select("id", "stratum", "selected")


E_SQL = f"""{SCORES_SQL}, c AS (SELECT *, sum(CAST(calibration AS INTEGER)) OVER w AS nulls, sum(1 - CAST(calibration AS INTEGER)) OVER w AS tests, sum(CAST(calibration AS INTEGER)) OVER (PARTITION BY stratum) AS n0,
  sum(1 - CAST(calibration AS INTEGER)) OVER (PARTITION BY stratum) AS m FROM scores WINDOW w AS (PARTITION BY stratum ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, min(score) FILTER (WHERE (1 + nulls) / (1 + n0) * m / greatest(tests, 1) <= 0.9) OVER (PARTITION BY stratum) AS stop FROM c),
ev AS (SELECT *, CASE WHEN stop IS NOT NULL AND score >= stop THEN (1 + n0) / (1 + held) ELSE 0.0 END AS e FROM (SELECT *, sum(CASE WHEN score >= stop THEN CAST(calibration AS INTEGER) ELSE 0 END) OVER (PARTITION BY stratum) AS held FROM t) WHERE NOT calibration AND n0 > 0)"""


@query(f"WITH {E_SQL} SELECT id, stratum, round(e, 9) AS e FROM ev")
def conformal_evalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.e_values(scores(spark, sf_dir), 0.9).select("id", "stratum", F.round("e", 9).alias("e"))


@query(f"""WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY e DESC, id) AS k, count(*) OVER (PARTITION BY stratum) AS me FROM ev)
SELECT id, stratum, k <= coalesce(max(k) FILTER (WHERE e >= me / (0.9 * k)) OVER (PARTITION BY stratum), 0) AS selected FROM r""")
def ebh_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certify.ebh_selected(certify.e_values(scores(spark, sf_dir), 0.9), "stratum", 0.9).select("id", "stratum", "selected")


@query(f"""WITH {SCORES_SQL} SELECT id, round((CASE WHEN p <= 0.01 THEN 100.0 ELSE 0.0 END + CASE WHEN p <= 0.05 THEN 20.0 ELSE 0.0 END + CASE WHEN p <= 0.1 THEN 10.0 ELSE 0.0 END) / 3, 6) AS e FROM pv""")
def fused_evalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p-values turned into e-values by a mixture of step calibrators."""
    return certify.conformal_p(scores(spark, sf_dir)).select("id", F.round(certify.calibrator(F.col("p"), (0.01, 0.05, 0.1)), 6).alias("e"))


@query("""WITH r AS (SELECT o_orderpriority AS stratum, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2 AS rb FROM orders)
SELECT stratum, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY stratum HAVING count(*) >= 2""")
def stratified_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation with mean ranks for ties, in each stratum."""
    rows = estate.table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "stratum")
    return certify.spearman(rows, "o_custkey", "o_totalprice", ["stratum"])


# A supplier stands on the one of half its number; every ninth one also leans on its double, which closes cycles.
EDGES_SQL = """edges AS (SELECT s_suppkey AS source, s_suppkey // 2 AS target FROM supplier WHERE s_suppkey > 1
  UNION SELECT a.s_suppkey, a.s_suppkey * 2 FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey * 2 WHERE a.s_suppkey % 9 = 0)"""
PATHS_SQL = f"{EDGES_SQL}, paths(source, target) AS (SELECT source, target FROM edges UNION SELECT p.source, e.target FROM paths p JOIN edges e ON p.target = e.source)"
PARTS_SQL = f"""{PATHS_SQL}, nodes AS (SELECT DISTINCT n FROM (SELECT source AS n FROM edges UNION SELECT target FROM edges)),
comp AS (SELECT n AS node, least(n, coalesce((SELECT min(a.target) FROM paths a JOIN paths b ON a.source = b.target AND a.target = b.source WHERE a.source = n), n)) AS component FROM nodes)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = estate.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    up = s.where("source > 1").select("source", F.floor(F.col("source") / 2).alias("target"))
    down = s.where("source % 9 = 0").select("source", (F.col("source") * 2).alias("target")).join(s.select(F.col("source").alias("target")), "target", "left_semi")
    return up.unionByName(down.select("source", "target")).distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("node")).union(e.select("target")).distinct()


@query(f"WITH RECURSIVE {PATHS_SQL} SELECT target AS node, count(*) AS dependents FROM paths WHERE source <> target GROUP BY target")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other nodes stand on each, through cycles too."""
    return graph.dependents(graph.closure(edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT node, component FROM comp")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.strong_components(nodes(e), e)


@query(f"""WITH RECURSIVE {PARTS_SQL}, dag AS (SELECT DISTINCT a.component AS above, b.component AS below FROM edges e JOIN comp a ON a.node = e.source JOIN comp b ON b.node = e.target WHERE a.component <> b.component),
walk(c, d) AS (SELECT component, CAST(1 AS BIGINT) FROM comp UNION SELECT above, d + 1 FROM walk JOIN dag ON below = c),
s AS (SELECT component, count(*) AS size FROM comp GROUP BY component), dep AS (SELECT c AS component, max(d) AS depth FROM walk GROUP BY c)
SELECT component, size, depth, row_number() OVER (ORDER BY depth, size DESC, component) AS "order" FROM dep JOIN s USING (component)""")
def migration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of what must move together, after what they stand on."""
    e = edges(spark, sf_dir)
    return graph.depths(graph.strong_components(nodes(e), e), e).select("component", "size", "depth", "order")


@query(f"""WITH {EDGES_SQL} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY node""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
