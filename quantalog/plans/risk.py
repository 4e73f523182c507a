"""Queries over the scored inventory, each beside the SQL that says the same to another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.functions.curve import survival_sql
from quantalog.operators import scoring, views
from quantalog.operators.checkpoints import written
from quantalog.sources import estate
from quantalog.sources.estate import ALGORITHMS, AS_OF, AS_OF_YEAR, FINDINGS_SQL


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from findings to planned assets, lazily."""
    df = scoring.classified(estate.findings(spark, sf_dir), estate.algorithms(spark))
    df = scoring.scored(scoring.profiled(df))
    df = scoring.levelled(scoring.scheduled(df, estate.PERSONAS, AS_OF_YEAR))
    return scoring.planned(scoring.with_margins(df, AS_OF_YEAR))


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


def _case(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {_value(v)}" for k, v in values.items()) + " END"


_ELAPSED = max(AS_OF_YEAR - K.REPORT_YEAR, 0.0)
_BAND = " ".join(f"WHEN dominant >= {x} THEN '{name}'" for x, name in K.RISK_BANDS)


def _axis(reading: str) -> str:
    return f"0.5 * (s * e * (1 - {survival_sql('x_c + y', reading)})) + 0.5 * (c * (1 - {survival_sql('least(x_i, y)', reading)}))"


#: The scored inventory as a chain of common table expressions; `assets` is the last.
ASSETS_SQL = f"""{FINDINGS_SQL},
algorithms(algorithm, key_size, primitive, verdict, quantum_vulnerable, classically_broken, grover_weakened, logical_qubits) AS (VALUES {_rows(ALGORITHMS)}),
profiles(asset_class, p_c, x_i, y, p_s, e, c) AS (VALUES {_rows([(k, *map(float, v)) for k, v in K.PROFILES.items()])}),
p1 AS (SELECT f.*, a.* EXCLUDE (algorithm), p.* EXCLUDE (asset_class, p_c, p_s),
    coalesce({_case({k: float(v) for k, v in K.DATA_CLASS_YEARS.items()}, "data_class")}, p_c) AS x_c,
    greatest(p_s, coalesce({_case(K.CRITICALITY_FLOOR, "criticality")}, 0.0)) AS s
  FROM findings f LEFT JOIN algorithms a USING (algorithm) LEFT JOIN profiles p USING (asset_class)),
p2 AS (SELECT *, CASE WHEN quantum_vulnerable THEN round(s * e * (1 - {survival_sql("x_c + y")}), 6) ELSE 0.0 END AS h_score,
    CASE WHEN quantum_vulnerable THEN round(c * (1 - {survival_sql("least(x_i, y)")}), 6) ELSE 0.0 END AS t_score,
    CASE WHEN quantum_vulnerable THEN round({_axis("optimistic")}, 6) ELSE 0.0 END AS b1,
    CASE WHEN quantum_vulnerable THEN round({_axis("pessimistic")}, 6) ELSE 0.0 END AS b2,
    coalesce({_case(estate.PERSONAS, "owner")}, 'General Enterprise') AS persona, (c >= 0.7 OR e >= 0.8) AS high FROM p1),
p3 AS (SELECT * EXCLUDE (b1, b2, high), CAST(round(CAST(h_score AS DECIMAL(12, 6)) * CAST(0.5 AS DECIMAL(5, 4)) + CAST(t_score AS DECIMAL(12, 6)) * CAST(0.5 AS DECIMAL(5, 4)), 6) AS DOUBLE) AS qirs, least(b1, b2) AS qirs_low, greatest(b1, b2) AS qirs_high,
    CASE WHEN high THEN 'high_priority' ELSE 'full' END AS phase,
    CASE WHEN high THEN {_case({k: v[1] for k, v in K.DEADLINES.items()}, "persona")} ELSE {_case({k: v[2] for k, v in K.DEADLINES.items()}, "persona")} END AS deadline_year,
    greatest(h_score, t_score) AS dominant FROM p2),
p4 AS (SELECT *, round((deadline_year + 1 - {AS_OF_YEAR!r}) * 12 - y * 12, 1) AS slack_months, CASE WHEN t_score > h_score THEN 'TNFL' ELSE 'HNDL' END AS axis,
    y + CASE WHEN ownership IN ('vendor_firmware_gated', 'provider_gated') THEN {K.VENDOR_LEAD_YEARS} ELSE 0.0 END AS effort,
    coalesce({K.HORIZON_DOUBLING_YEARS} * log2(logical_qubits / {float(K.REFERENCE_QUBITS)!r}), 0.0) AS shift FROM p3),
p5 AS (SELECT *, greatest(effort, deadline_year + 1 - {AS_OF_YEAR!r}) AS plan,
    CASE WHEN NOT quantum_vulnerable THEN CASE WHEN classically_broken THEN 'informational' ELSE 'safe' END
      WHEN slack_months < 0 THEN CASE WHEN dominant >= 0.20 THEN 'critical' ELSE 'high' END
      ELSE CASE {_BAND} ELSE 'minimal' END END AS risk_level FROM p4),
p6 AS (SELECT *, {", ".join(f"CASE WHEN quantum_vulnerable THEN round(greatest(x_c + plan, least(x_i, plan)) - ({max(K.HALF_YEARS[r] - _ELAPSED, 0.0)!r} + shift), 3) END AS margin_{r}" for r in K.READINGS)},
    CASE WHEN asset_class = 'embedded_private_key' THEN 'secret_exposure'
      WHEN asset_class = 'crypto_library' THEN CASE WHEN pqc_capable THEN NULL WHEN NOT pqc_capable THEN 'library_upgrade' ELSE 'resolve_first' END WHEN verdict = 'unknown' THEN 'resolve_first' WHEN classically_broken THEN 'replace_now'
      WHEN quantum_vulnerable THEN CASE
        WHEN asset_class IN {K.KEX_CLASSES} OR primitive IN ('key-agree', 'kem') OR usage = 'key_exchange' THEN 'key_exchange'
        WHEN primitive = 'pke' AND usage IN ('encryption', 'key_wrap') THEN 'kem_at_rest'
        WHEN asset_class IN {K.LONG_LIVED} THEN 'signature_long_lived' ELSE 'signature_high_volume' END
      WHEN grover_weakened AND starts_with(algorithm, 'AES') THEN 'symmetric' END AS need FROM p5),
assets AS (SELECT *, CASE WHEN NOT quantum_vulnerable THEN 'not_applicable' WHEN margin_optimistic > 0 THEN 'certain' WHEN margin_median > 0 THEN 'likely'
      WHEN margin_pessimistic > 0 THEN 'possible' ELSE 'clear' END AS category,
    {_case({k: float(v) for k, v in K.EFFORT_DAYS.items()}, "need")} AS effort_days, (slack_months < 0 AND need IS NOT NULL) AS behind,
    ownership IN ('vendor_firmware_gated', 'provider_gated') AS gated,
    date_diff('day', DATE '{AS_OF}', not_after) AS expiry_days FROM p6)"""

#: Ascending order of priority, in SQL.
ORDER_SQL = f"""CASE WHEN quantum_vulnerable THEN 0 WHEN classically_broken THEN 1 WHEN verdict = 'unknown' THEN 2 ELSE 3 END,
  CASE WHEN quantum_vulnerable THEN list_position({list(K.CATEGORIES)}, category) ELSE 0 END,
  CASE WHEN quantum_vulnerable THEN -margin_median ELSE 0.0 END, CASE WHEN quantum_vulnerable THEN -qirs ELSE 0.0 END, name, id, system, asset_class"""

QUERIES: dict[str, tuple] = {}


def query(sql: str):
    """Registers a function of the scored assets under its name; sql follows the chain that ends in `assets`."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str, f=f) -> DataFrame:
            return f(scored(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = (run, f"WITH {ASSETS_SQL}\n{sql}")
        return f

    return add


@query(f"SELECT id, name, algorithm, asset_class, category, margin_median, qirs, row_number() OVER (ORDER BY {ORDER_SQL}) AS priority_rank FROM assets")
def priority_ranking(assets: DataFrame) -> DataFrame:
    """What to move first, over the whole estate."""
    narrow = assets.select("algorithm", *scoring.ORDER_COLUMNS)
    return scoring.ranked(narrow).select("id", "name", "algorithm", "asset_class", "category", "margin_median", "qirs", "priority_rank")


@query("SELECT id, algorithm, key_size, primitive, verdict, quantum_vulnerable, classically_broken, grover_weakened FROM assets")
def findings_classified(assets: DataFrame) -> DataFrame:
    return assets.select("id", "algorithm", "key_size", "primitive", "verdict", "quantum_vulnerable", "classically_broken", "grover_weakened")


@query("SELECT id, x_c, x_i, y, s, e, c, h_score, t_score, qirs, qirs_low, qirs_high FROM assets")
def scored_assets(assets: DataFrame) -> DataFrame:
    return assets.select("id", "x_c", "x_i", "y", "s", "e", "c", "h_score", "t_score", "qirs", "qirs_low", "qirs_high")


@query("SELECT id, persona, phase, deadline_year, slack_months, risk_level, axis FROM assets")
def risk_levels(assets: DataFrame) -> DataFrame:
    return assets.select("id", "persona", "phase", "deadline_year", "slack_months", "risk_level", "axis")


@query("SELECT id, category, margin_optimistic, margin_median, margin_pessimistic FROM assets")
def mosca_margins(assets: DataFrame) -> DataFrame:
    return assets.select("id", "category", "margin_optimistic", "margin_median", "margin_pessimistic")


@query("SELECT id, need, effort_days, behind, gated FROM assets")
def needs(assets: DataFrame) -> DataFrame:
    return assets.select("id", "need", "effort_days", "behind", "gated")


@query("""SELECT id, name, algorithm, owner, system, risk_level FROM assets WHERE risk_level IN ('critical', 'high') AND quantum_vulnerable
  AND contains(lower(concat_ws(' ', name, algorithm, owner, system)), 'rsa') AND environment = 'prod'""")
def assets_filtered(assets: DataFrame) -> DataFrame:
    """Conjunctive filters and a case-insensitive search over several columns."""
    found = views.filtered(assets, {"risk_level": ["critical", "high"], "quantum_vulnerable": [True], "environment": ["prod"]}, "RSA", ["name", "algorithm", "owner", "system"])
    return found.select("id", "name", "algorithm", "owner", "system", "risk_level")


@query("""SELECT id, qirs, h_score, t_score, slack_months, matched FROM (SELECT *, count(*) OVER () AS matched FROM assets WHERE quantum_vulnerable)
  ORDER BY qirs DESC, id LIMIT 40""")
def assets_top(assets: DataFrame) -> DataFrame:
    """The sort menu: the 40 greatest by one measure, with the number that matched."""
    return views.top_matches(assets.where("quantum_vulnerable"), "qirs", 40).select("id", "qirs", "h_score", "t_score", "slack_months", "matched")


@query("""SELECT 'HNDL' AS side, id, h_score AS score FROM (SELECT * FROM assets ORDER BY h_score DESC, id LIMIT 25)
  UNION ALL SELECT 'TNFL', id, t_score FROM (SELECT * FROM assets ORDER BY t_score DESC, id LIMIT 25)""")
def axis_extremes(assets: DataFrame) -> DataFrame:
    """The extremes of both axes."""
    top = lambda side, column: assets.orderBy(F.desc(column), "id").limit(25).select(F.lit(side).alias("side"), "id", F.col(column).alias("score"))
    return top("HNDL", "h_score").unionByName(top("TNFL", "t_score"))


@query("""SELECT count(*) AS total, CAST(count_if(quantum_vulnerable) AS BIGINT) AS vulnerable, CAST(count_if(classically_broken) AS BIGINT) AS broken, CAST(count_if(slack_months < 0) AS BIGINT) AS negative_slack,
  round(CAST(avg(CAST(qirs AS DECIMAL(38, 10))) AS DOUBLE), 6) AS avg_qirs, max(qirs) AS max_qirs, min(slack_months) AS worst_slack, count(DISTINCT system) AS systems,
  count(DISTINCT algorithm) AS algorithms, CAST(count_if(risk_level = 'critical') AS BIGINT) AS critical, CAST(count_if(behind) AS BIGINT) AS behind, arg_max(id, struct_pack(q := qirs, i := id)) AS worst_asset FROM assets""")
def dashboard(assets: DataFrame) -> DataFrame:
    """The estate at a glance: its measures are written once; counts, distinct names and the worst asset are read from there without sorting."""
    rows = written(assets.select("id", "quantum_vulnerable", "classically_broken", "slack_months", "qirs", "system", "algorithm", "risk_level", "behind"), "glance")
    measures = rows.agg(
        F.count("*").alias("total"),
        F.count_if("quantum_vulnerable").alias("vulnerable"),
        F.count_if("classically_broken").alias("broken"),
        F.count_if(F.col("slack_months") < 0).alias("negative_slack"),
        F.round(F.avg(F.col("qirs").cast("decimal(38,10)")).cast("double"), 6).alias("avg_qirs"),
        F.max("qirs").alias("max_qirs"),
        F.min("slack_months").alias("worst_slack"),
        F.count_if(F.col("risk_level") == "critical").alias("critical"),
        F.count_if("behind").alias("behind"),
    )
    systems, algorithms = (rows.select(c).distinct().agg(F.count(c).alias(f"{c}s")) for c in ("system", "algorithm"))
    worst = rows.orderBy(F.desc("qirs"), F.desc("id")).limit(1).select(F.col("id").alias("worst_asset"))
    found = measures.crossJoin(F.broadcast(systems)).crossJoin(F.broadcast(algorithms)).join(F.broadcast(worst), F.lit(True), "left")  # one row each
    return found.select("total", "vulnerable", "broken", "negative_slack", "avg_qirs", "max_qirs", "worst_slack", "systems", "algorithms", "critical", "behind", "worst_asset")


_FACETS = ("risk_level", "verdict", "source_type", "asset_class", "algorithm", "owner", "environment", "need", "category")


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, '') AS value, count(*) AS n, CAST(count_if(quantum_vulnerable) AS BIGINT) AS vulnerable, CAST(count_if(behind) AS BIGINT) AS behind FROM assets GROUP BY 2" for c in _FACETS)
    + ")"
)
def facets(assets: DataFrame) -> DataFrame:
    """Nine facets counted in one pass."""
    return views.facets(assets, list(_FACETS), {"vulnerable": F.col("quantum_vulnerable"), "behind": F.col("behind")})


@query("""SELECT b.h_bin, b.t_bin, count(id) AS n, round(CAST(avg(CAST(qirs AS DECIMAL(38, 10))) AS DOUBLE), 6) AS avg_qirs, arg_max(id, struct_pack(q := qirs, i := id)) AS worst
  FROM (SELECT h.i AS h_bin, t.i AS t_bin FROM range(10) h(i), range(10) t(i)) b
  LEFT JOIN (SELECT a.*, least(CAST(floor(h_score / (top / 10)) AS BIGINT), 9) AS h_bin, least(CAST(floor(t_score / (top / 10)) AS BIGINT), 9) AS t_bin
    FROM assets a, (SELECT greatest(max(h_score), max(t_score)) AS top FROM assets) WHERE quantum_vulnerable) x ON b.h_bin = x.h_bin AND b.t_bin = x.t_bin GROUP BY ALL""")
def heatmap_grid(assets: DataFrame) -> DataFrame:
    """Dense ten by ten grid of both axes, scaled by the greatest score there is."""
    return views.heatmap(assets.where("quantum_vulnerable"), 10)


@query("""SELECT bin, count(id) AS n FROM range(10) r(bin) LEFT JOIN (SELECT id, least(CAST(floor(qirs * 10) AS BIGINT), 9) AS b FROM assets) ON bin = b GROUP BY bin""")
def qirs_histogram(assets: DataFrame) -> DataFrame:
    return views.histogram(assets, F.col("qirs"), 10)


@query("""SELECT verdict, count(*) AS n, CAST(count_if(behind) AS BIGINT) AS behind, round(CAST(avg(CAST(qirs AS DECIMAL(38, 10))) AS DOUBLE), 6) AS avg_qirs FROM assets GROUP BY verdict""")
def verdict_breakdown(assets: DataFrame) -> DataFrame:
    return assets.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("behind").alias("behind"), F.round(F.avg(F.col("qirs").cast("decimal(38,10)")).cast("double"), 6).alias("avg_qirs"))


@query("""SELECT source_type, count(*) AS n, CAST(count_if(quantum_vulnerable) AS BIGINT) AS vulnerable, max(qirs) AS max_qirs FROM assets GROUP BY source_type""")
def source_risk(assets: DataFrame) -> DataFrame:
    return assets.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if("quantum_vulnerable").alias("vulnerable"), F.max("qirs").alias("max_qirs"))


@query("""SELECT CAST(key_size AS VARCHAR) || '-bit' AS size, count(*) AS n FROM assets WHERE key_size IS NOT NULL GROUP BY 1""")
def key_sizes(assets: DataFrame) -> DataFrame:
    return assets.where("key_size is not null").groupBy(F.format_string("%d-bit", "key_size").alias("size")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN y <= 0.5 THEN 'low' WHEN y <= 1.5 THEN 'medium' ELSE 'high' END AS effort, count(*) AS n FROM assets WHERE quantum_vulnerable GROUP BY 1""")
def effort_distribution(assets: DataFrame) -> DataFrame:
    effort = F.when(F.col("y") <= 0.5, "low").when(F.col("y") <= 1.5, "medium").otherwise("high")
    return assets.where("quantum_vulnerable").groupBy(effort.alias("effort")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(count_if(h_score > t_score) AS BIGINT) AS hndl, CAST(count_if(t_score > h_score) AS BIGINT) AS tnfl, CAST(count_if(abs(h_score - t_score) < 0.01) AS BIGINT) AS balanced, min(slack_months) AS least,
  round(CAST(avg(CAST(slack_months AS DECIMAL(38, 10))) AS DOUBLE), 6) AS mean FROM assets WHERE quantum_vulnerable""")
def axis_dominance(assets: DataFrame) -> DataFrame:
    """Counts that overlap on purpose: near ties are counted as balanced besides."""
    h, t = F.col("h_score"), F.col("t_score")
    return assets.where("quantum_vulnerable").agg(
        F.count_if(h > t).alias("hndl"), F.count_if(t > h).alias("tnfl"), F.count_if(F.abs(h - t) < 0.01).alias("balanced"), F.min("slack_months").alias("least"), F.round(F.avg(F.col("slack_months").cast("decimal(38,10)")).cast("double"), 6).alias("mean")
    )


@query("SELECT coalesce(system, '(all)') AS system, category, count(*) AS n FROM assets WHERE quantum_vulnerable GROUP BY GROUPING SETS ((system, category), (category))")
def mosca_by_system(assets: DataFrame) -> DataFrame:
    """Category counts for each system and overall."""
    return views.category_rollup(assets.where("quantum_vulnerable"))


@query("""SELECT persona, phase, count(*) AS assets, round(100.0 * count_if(need IS NULL) / count(*), 2) AS ready_pct,
  round(100.0 * count_if(behind) / nullif(count_if(need IS NOT NULL), 0), 2) AS behind_pct FROM assets GROUP BY persona, phase""")
def milestone_track(assets: DataFrame) -> DataFrame:
    """Readiness by milestone, each share over its own denominator."""
    share = lambda a, b: F.round(100.0 * a / F.nullif(b, F.lit(0)), 2)
    open_ = F.col("need").isNotNull()
    return assets.groupBy("persona", "phase").agg(F.count("*").alias("assets"), share(F.count_if(~open_), F.count("*")).alias("ready_pct"), share(F.count_if("behind"), F.count_if(open_)).alias("behind_pct"))


@query("""SELECT band, count(id) AS n FROM (VALUES ('expired'), ('30_days'), ('90_days'), ('ok')) b(band)
  LEFT JOIN (SELECT id, CASE WHEN expiry_days < 0 THEN 'expired' WHEN expiry_days <= 30 THEN '30_days' WHEN expiry_days <= 90 THEN '90_days' ELSE 'ok' END AS own FROM assets) ON band = own GROUP BY band""")
def expiry_bands(assets: DataFrame) -> DataFrame:
    return views.expiry_bands(assets, AS_OF)


@query("""SELECT CASE GROUPING_ID(owner, system, need) WHEN 3 THEN 'owner' WHEN 5 THEN 'system' WHEN 6 THEN 'need' ELSE 'all' END AS level,
    coalesce(owner, system, need, '') AS name, count(*) AS changes, CAST(sum(assets) AS BIGINT) AS assets, round(CAST(sum(CAST(days AS DECIMAL(20, 2))) AS DOUBLE), 2) AS days
  FROM (SELECT need, system, host, min(owner) AS owner, count(*) AS assets, max(effort_days) AS days FROM assets WHERE need IS NOT NULL AND NOT gated GROUP BY need, system, host)
  GROUP BY GROUPING SETS ((owner), (system), (need), ())""")
def change_cost(assets: DataFrame) -> DataFrame:
    """Days of work by owner, system and need at once. Assets of one need in one place are one change."""
    return views.change_cost(assets.where("need is not null and not gated"))


@query("""SELECT ownership AS kind, system AS who, count(*) AS assets, array_to_string(list_sort(list(DISTINCT need)), ',') AS needs, min(deadline_year) AS earliest
  FROM assets WHERE gated AND need IS NOT NULL GROUP BY 1, 2""")
def gated_register(assets: DataFrame) -> DataFrame:
    """What waits for vendors and providers."""
    rows = assets.where("gated and need is not null").groupBy(F.col("ownership").alias("kind"), F.col("system").alias("who"))
    return rows.agg(F.count("*").alias("assets"), F.array_join(F.sort_array(F.collect_set("need")), ",").alias("needs"), F.min("deadline_year").alias("earliest"))


@query("""SELECT id, need, deadline_year, round(deadline_year + 1 - y, 3) AS latest_start, deadline_year + 1 - y < 2026.665298 AS overrun FROM assets WHERE need IS NOT NULL
  ORDER BY slack_months, qirs DESC, id LIMIT 100""")
def roadmap(assets: DataFrame) -> DataFrame:
    """Latest starts, backwards from the deadline; the most pressing hundred."""
    start = F.col("deadline_year") + 1 - F.col("y")
    rows = assets.where("need is not null").orderBy("slack_months", F.desc("qirs"), "id").limit(100)
    return rows.select("id", "need", "deadline_year", F.round(start, 3).alias("latest_start"), (start < 2026.665298).alias("overrun"))


@query(f"""SELECT need, owner, best, n FROM (SELECT need, owner, min(r) AS best, count(*) AS n FROM (SELECT need, owner, row_number() OVER (ORDER BY {ORDER_SQL}) AS r FROM assets WHERE need IS NOT NULL)
  GROUP BY need, owner) ORDER BY best LIMIT 5""")
def do_next(assets: DataFrame) -> DataFrame:
    """The five groups of work whose best-ranked asset comes first."""
    rows = scoring.ranked(assets.where("need is not null").select("need", "owner", *scoring.ORDER_COLUMNS), name="r")
    return rows.groupBy("need", "owner").agg(F.min("r").alias("best"), F.count("*").alias("n")).orderBy("best").limit(5)


@query("""SELECT algorithm, CAST(sum(CASE WHEN category = 'certain' THEN 1 ELSE 0 END) AS BIGINT) AS certain, CAST(sum(CASE WHEN category = 'likely' THEN 1 ELSE 0 END) AS BIGINT) AS likely,
  CAST(sum(CASE WHEN category = 'possible' THEN 1 ELSE 0 END) AS BIGINT) AS possible, CAST(sum(CASE WHEN category = 'clear' THEN 1 ELSE 0 END) AS BIGINT) AS clear,
  round(median(margin_median), 3) AS median_margin FROM assets WHERE quantum_vulnerable GROUP BY algorithm""")
def risk_view(assets: DataFrame) -> DataFrame:
    """Categories across, primitives down, with the median margin."""
    rows = assets.where("quantum_vulnerable")
    wide = rows.groupBy("algorithm").pivot("category", list(K.CATEGORIES)).count().na.fill(0, list(K.CATEGORIES))
    return wide.join(rows.groupBy("algorithm").agg(F.round(F.median("margin_median"), 3).alias("median_margin")), "algorithm")


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT algorithm || '|' || CAST(count(*) AS VARCHAR) || '|' || CAST(CAST(count_if(behind) AS BIGINT) AS VARCHAR) AS line FROM assets GROUP BY algorithm)")
def snapshot_digest(assets: DataFrame) -> DataFrame:
    """A digest of the estate that doesn't depend on the order of rows; rows are pre-aggregated, so one line for each algorithm meets."""
    lines = assets.groupBy("algorithm").agg(F.concat_ws("|", "algorithm", F.count("*"), F.count_if("behind")).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"), F.count("*").alias("n"))


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
