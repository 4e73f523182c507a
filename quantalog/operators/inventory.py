"""Rows of the inventory as they are shown, how exposed they are, folds by identity, and what follows for a migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.functions.text import common_name
from quantalog.operators.drift import is_internal
from quantalog.operators.numbering import placed
from quantalog.operators.scoring import lookup, scored
from quantalog.operators.taxonomy import algorithm_facts


def given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def status() -> Column:
    """One word: broken before vulnerable before weakened before unresolved before safe."""
    verdict = F.col("verdict")
    return F.when(F.col("classically_broken"), "broken").when(F.col("quantum_vulnerable"), "vulnerable").when(verdict == "grover", "weakened").when(verdict == "unknown", "unresolved").otherwise("safe")


def rows(assets: DataFrame, needs: DataFrame, drifting: DataFrame) -> DataFrame:
    """The list of assets with what is recommended for each and whether any drift record names it. needs: id, target; drifting: asset_id."""
    drift = drifting.select(F.col("asset_id").alias("id"), F.lit(True).alias("drifts")).distinct()
    out = assets.join(needs.select("id", "target"), "id", "left").join(drift, "id", "left")
    return out.select("id", "name", "algorithm", "system", status().alias("status"), F.round("slack_months", 1).alias("slack_months"), F.round("qirs", 4).alias("qirs"), "behind", "target", F.coalesce("drifts", F.lit(False)).alias("drifts"))


def host_of(endpoint: Column) -> Column:
    """The host of scheme://host:port/path, lower-cased. An IPv6 address may stand in brackets, or bare without a port."""
    place = F.lower(F.regexp_replace(F.regexp_replace(endpoint, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"/.*$", ""))
    bracketed = F.regexp_extract(place, r"^\[([^\]]*)\]", 1)
    return F.when(place.startswith("["), bracketed).when(F.size(F.split(place, ":")) == 2, F.substring_index(place, ":", 1)).otherwise(place)


def exposure(endpoint: Column, peer: Column, declared: Column, system: Column) -> Column:
    """exposure and basis: an address is a fact, else what is declared, else a hint in the name, else unknown."""
    host = F.coalesce(peer, host_of(endpoint))
    inside, said = is_internal(host), declared.isin("internet", "internal")
    register = F.concat(F.lit("declared "), declared, F.lit(" in the register for "), F.coalesce(system, F.lit("its system")))
    inner = F.lit(False)
    for suffix in K.INTERNAL_SUFFIXES:
        inner = inner | host.endswith(suffix)
    pair = lambda a, b: F.struct(a.alias("exposure"), b.alias("basis"))
    return (
        F.when(endpoint.isNull(), F.when(said, pair(declared, register)).otherwise(pair(F.lit("unknown"), F.lit("not a network endpoint"))))
        .when(inside, pair(F.lit("internal"), F.concat(host, F.lit(" is a private address"))))
        .when(~inside, pair(F.lit("internet"), F.concat(host, F.lit(" is a public address"))))
        .when(said, pair(declared, register))
        .when(inner | ~host.contains("."), pair(F.lit("internal"), F.concat(host, F.lit(" is an internal name"))))
        .otherwise(pair(F.lit("unknown"), F.concat(host, F.lit(" is a name"))))
    )


def identity(subject: Column, location: Column, asset_class: Column, *what: Column) -> Column:
    """A certificate is its common name, or its subject without one; anything else is where it is, of its class and of the
    first of `what` that is given (algorithm, key exchange, cipher suite): one endpoint has several assets."""
    named = F.coalesce(common_name(subject), F.nullif(subject, F.lit("")))
    place = F.concat_ws("|", F.lit("at"), F.coalesce(location, F.lit("")), F.coalesce(asset_class, F.lit("")), F.coalesce(given(*what), F.lit("")))
    return F.when(named.isNotNull(), F.concat(F.lit("cn|"), F.lower(named))).otherwise(F.lower(place))


def folded(findings: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """One row for each identity: the best-evidenced finding, its gaps filled by the next best, confidence raised for further methods.

    findings: key, id, confidence, provenance, sensor and the columns to fill. Only the best value of each column meets in a group.
    """
    best = lambda c: F.max_by(c, F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.struct("confidence", F.col("id")))).alias(c)
    methods = F.count_distinct("provenance")
    raised = F.greatest(F.max("confidence"), F.least(F.lit(K.BONUS_CEILING), F.max("confidence") + K.BONUS * (methods - 1)))
    return findings.groupBy(key).agg(F.max_by("id", F.struct("confidence", "id")).alias("id"), *[best(c) for c in fill], F.round(raised, 4).alias("confidence"), F.count_distinct("sensor").alias("sensors"), F.count("*").alias("findings"))


def with_system(findings: DataFrame, systems: DataFrame) -> DataFrame:
    """Findings without a system take that of their host. systems: name, hosts array<string>; of several systems with a host the least name."""
    of_host = systems.select("name", F.explode("hosts").alias("h")).groupBy(F.lower("h").alias("_host")).agg(F.min("name").alias("_system"))
    return findings.join(of_host, F.lower(findings.host) == F.col("_host"), "left").withColumn("system", F.coalesce("system", "_system")).drop("_host", "_system")


def linked(assets: DataFrame, records: DataFrame) -> DataFrame:
    """id, records: the drift records that name an asset or one merged into it. assets: id, merged_ids; records: record_id, asset_ids."""
    names = assets.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("merged_ids", F.array().cast("array<string>")))).alias("member"))
    named = records.select("record_id", F.explode("asset_ids").alias("member"))
    return names.join(named, "member").groupBy("id").agg(F.count_distinct("record_id").alias("records"))


def progress(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: id, vulnerable. What was migrated, removed, or has become vulnerable between two snapshots, and the progress in percent."""
    both = old.select("id", F.col("vulnerable").alias("was")).join(new.select("id", F.col("vulnerable").alias("now")), "id", "full_outer")
    was, now = F.coalesce("was", F.lit(False)), F.col("now")
    out = both.agg(
        F.count_if(was & (now == F.lit(False))).alias("migrated"), F.count_if(was & now.isNull()).alias("removed_vulnerable"), F.count_if(F.coalesce(now, F.lit(False)) & ~was).alias("newly_vulnerable"), F.count_if(was).alias("before")
    )
    return out.withColumn("progress_pct", F.round(100.0 * (F.col("migrated") + F.col("removed_vulnerable")) / F.nullif(F.col("before"), F.lit(0)), 1))


def simulated(assets: DataFrame, target: str = "", classes: list[str] | None = None, pqc_only: bool = False) -> DataFrame:
    """What a migration of the selected assets would change: id, need, replacement, scores before and after, what stays vulnerable and behind.

    assets: scored ones, with what the scores are made of. An asset with a replacement is classified again by that name and scored
    by the same operator as before. Needs that no algorithm meets aren't simulated: these assets keep their scores.
    """
    chosen = assets.where("quantum_vulnerable").where(F.lower("host").contains(target.lower()))
    chosen = chosen.where(F.col("asset_class").isin(*classes)) if classes else chosen
    swap = F.when(F.col("need").isin(*K.MIGRATION_NEEDS, "replace_now"), lookup({k: v[0] for k, v in K.TARGETS.items()}, F.col("need")))
    half = F.when(F.lit(pqc_only) & swap.endswith("MLKEM768") & ~swap.startswith("ML"), "ML-KEM-768").otherwise(swap)
    names = sorted({v[0] for v in K.TARGETS.values() if v[0]} | {"ML-KEM-768"})
    facts = algorithm_facts(F.col("replacement"), F.lit(None).cast("int"))
    known = assets.sparkSession.createDataFrame([(n,) for n in names], "replacement string").select("replacement", facts["verdict"].alias("new_verdict"))
    kept = ["h_score", "t_score", "qirs", "behind"]
    before = chosen.withColumn("replacement", half).join(F.broadcast(known), "replacement", "left").withColumnsRenamed({c: f"{c}_before" for c in kept})
    moved = F.col("replacement").isNotNull()
    again = scored(before.withColumn("quantum_vulnerable", ~moved | (F.col("new_verdict") == "shor")))
    return again.select(
        "id", "need", "replacement", F.col("qirs_before").alias("before"), F.col("qirs").alias("after"), "h_score_before", F.col("h_score").alias("h_score_after"), "t_score_before", F.col("t_score").alias("t_score_after"),
        F.col("quantum_vulnerable").alias("still_vulnerable"), "behind_before", (F.col("behind_before") & F.col("quantum_vulnerable")).alias("behind_after"),
    )


def effect(changes: DataFrame) -> DataFrame:
    """One row: how many assets were selected, moved and skipped, and means, maxima and counts before and after, with the reduction in percent."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(38,10)")).cast("double"), 6)
    out = changes.agg(
        F.count("*").alias("selected"), F.count("replacement").alias("moved"), F.count_if(F.col("replacement").isNull()).alias("skipped"), mean("before").alias("qirs_before"), mean("after").alias("qirs_after"), mean("h_score_before").alias("h_before"), mean("h_score_after").alias("h_after"),
        mean("t_score_before").alias("t_before"), mean("t_score_after").alias("t_after"), F.max("before").alias("most_before"), F.max("after").alias("most_after"), F.count_if("still_vulnerable").alias("vulnerable_after"), F.count_if("behind_before").alias("behind_before"), F.count_if("behind_after").alias("behind_after"),
    )
    return out.withColumn("reduction_pct", F.when(F.col("qirs_before") > 0, F.round((F.col("qirs_before") - F.col("qirs_after")) / F.col("qirs_before") * 100, 1)).otherwise(0.0))


def notifications(assets: DataFrame, not_run: DataFrame) -> DataFrame:
    """Alerts that the state of the estate gives rise to, the critical ones first. assets: expiry_days, slack_months; not_run: sensors without a run."""
    days = F.col("expiry_days")
    one = assets.agg(F.count_if(days < 0).alias("expired"), F.count_if(days.between(0, 30)).alias("critical"), F.count_if(days.between(31, 90)).alias("warning"), F.count_if(F.col("slack_months") < 0).alias("behind"), F.min("slack_months").alias("worst"))
    both = one.crossJoin(not_run.agg(F.count("*").alias("blind")))  # one row each
    crossing = F.col("expired") + F.col("critical") + F.col("warning")
    item = lambda when, kind, severity, n, body: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), n.cast("bigint").alias("n"), body.alias("body")))
    items = F.array_compact(
        F.array(
            item(crossing > 0, "expiry", F.when(F.col("expired") + F.col("critical") > 0, "critical").otherwise("warning"), crossing, F.format_string("%d expired, %d critical, %d warning", "expired", "critical", "warning")),
            item(F.col("behind") > 0, "negative-slack", F.lit("critical"), F.col("behind"), F.format_string("worst slack %.1f months", "worst")),
            item(F.col("blind") > 0, "blind-spots", F.lit("warning"), F.col("blind"), F.format_string("%d sensors never ran", "blind")),
        )
    )
    return both.select(F.explode(items).alias("i")).select("i.*")


#: Of alerts, the most urgent first.
ALERT_ORDER = ("critical", "warning", "info")


def _named_alert(rows: DataFrame, kind: str, severity: str, most: int, text: str) -> DataFrame:
    """One alert that counts rows (name) and names the first few, or none if there are no rows."""
    first = rows.orderBy("name").limit(most).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    both = rows.agg(F.count("*").alias("n")).crossJoin(first).where("n > 0")  # one row each
    more = F.when(F.col("n") > most, F.format_string(" and %d more", F.col("n") - most)).otherwise("")
    return both.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "n", F.concat(F.lit(text), F.lit(": "), "names", more).alias("body"))


def alerts(assets: DataFrame, not_run: DataFrame, checks: DataFrame, required: DataFrame, models: DataFrame, announcements: DataFrame) -> DataFrame:
    """All that the state of the estate has to say, the most urgent first: place, kind, severity, n, body.

    assets and not_run as in `notifications` (not_run: name); checks: name, passed (of the last run); required: name, active (sensors that
    the profile needs); models: name, available; announcements: name, severity, body (those that weren't dismissed). An unknown severity counts
    as info. Nulls of passed, active and available count as false.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    parts = [
        notifications(assets, not_run.limit(0)), _named_alert(checks.where(no("passed")), "failed-checks", "critical", 3, "output checks failed"), _named_alert(not_run, "blind-spots", "warning", 3, "sensors never ran"),
        _named_alert(required.where(no("active")), "inactive-sensors", "warning", 5, "required sensors are inactive"), _named_alert(models.where(no("available")), "retired-models", "warning", 3, "models are out of rotation"),
        announcements.select(F.concat(F.lit("announcement-"), "name").alias("kind"), F.when(F.col("severity").isin(*ALERT_ORDER), F.col("severity")).otherwise("info").alias("severity"), F.lit(1).cast("bigint").alias("n"), "body"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    urgency = F.array_position(F.array(*map(F.lit, ALERT_ORDER)), F.col("severity"))
    return placed(every, [urgency, F.col("kind")]).select("place", "kind", "severity", "n", "body")


def coverage(sensors: DataFrame, runs: DataFrame) -> DataFrame:
    """Every registered sensor with its runs, findings and failures; those without a run are told."""
    ran = runs.groupBy("sensor").agg(F.count("*").alias("runs"), F.sum("findings").alias("findings"), F.count_if("failed").alias("failed"))
    return sensors.join(ran, "sensor", "left").na.fill(0, ["runs", "findings", "failed"]).withColumn("not_run", F.col("runs") == 0)


def fit(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """expected: asset_class, share; observed: asset_class. Shares side by side, and how far each is off; classes of either side are told."""
    total = observed.agg(F.count("*").alias("total"))
    have = observed.groupBy("asset_class").agg(F.count("*").alias("n")).crossJoin(total)  # one row
    both = expected.join(have.select("asset_class", (F.col("n") / F.col("total")).alias("have")), "asset_class", "full_outer").na.fill(0.0, ["share", "have"])
    return both.select("asset_class", F.col("share").alias("expected"), F.round("have", 6).alias("observed"), F.round(F.col("have") - F.col("share"), 6).alias("off"))


def reliability(calls: DataFrame, last: int = 20) -> DataFrame:
    """calls: model, at, ok, latency. A smoothed rate of success, (1 + ok) / (2 + n), and the median of the last latencies; the best first."""
    counts = calls.groupBy("model").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"))
    # The latest few of each part, then of all: ranks in a window that drops the rest early, so no model's calls meet in one list.
    latest = [F.desc("at"), F.desc("latency")]
    place = lambda *by: F.row_number().over(Window.partitionBy("model", *by).orderBy(*latest))
    salted = calls.select("model", "at", "latency", F.pmod(F.xxhash64("at"), F.lit(64)).alias("salt"))
    some = salted.withColumn("n", place("salt")).where(F.col("n") <= last)
    recent = some.withColumn("n", place()).where(F.col("n") <= last).groupBy("model").agg(F.collect_list("latency").alias("l"))  # `last` of each model
    n = F.size("m")
    median = (F.get("m", F.floor((n - 1) / 2).cast("int")) + F.get("m", F.floor(n / 2).cast("int"))) / 2
    rated = counts.join(recent.select("model", F.sort_array("l").alias("m")), "model")
    return rated.select("model", "calls", F.round((1 + F.col("ok")) / (2 + F.col("calls")), 6).alias("reliability"), F.round(median, 6).alias("median_latency"))


def intervals(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """points: id, at; ranges: name, low, high (exclusive). Each point with the ranges that it falls into.

    Both sides are laid out over buckets of `width`, so they meet by equality; the bounds are checked there.
    """
    laid = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    return points.withColumn("bucket", F.floor(F.col("at") / width)).join(laid, "bucket").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("id", "name")


def reference_candidates(reference: str, names: DataFrame) -> DataFrame:
    """names: id, name. Names that share parts with a reference, those that share most first; none is picked."""
    parts = F.array_distinct(F.filter(F.split(F.lower(F.lit(reference)), r"[^a-z0-9]+"), lambda t: t != ""))
    own = F.array_distinct(F.filter(F.split(F.lower("name"), r"[^a-z0-9]+"), lambda t: t != ""))
    return names.select("id", F.size(F.array_intersect(parts, own)).alias("shared")).where("shared > 0")

