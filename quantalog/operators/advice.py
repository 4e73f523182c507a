"""Who can change an asset, what it becomes, and what has to come first. Details are plain columns; null where a sensor doesn't tell.

assets: id, system, asset_class, need, quantum_vulnerable, source_type, discovered_by, resource, key_usage, recorded, owner_name,
change_blocked, hsm_model, deadline_year, language, ecosystem, runtime, linkage, library, library_version, upgrade_path, pqc_capable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.functions import constants as K
from quantalog.operators.checkpoints import sent, written
from quantalog.operators.numbering import BROADCAST_ROWS
from quantalog.operators.scoring import lookup

#: Hashes of ids that are sent to every task (some 40 bytes each); beyond, the ids are joined by a shuffle.
HASHES_SENT = 2_000_000
RECORDED = ("self_managed", "vendor_firmware_gated", "provider_gated", "third_party")


def plane_of(sensor: Column, source_type: Column) -> Column:
    """The evidence plane by the first known part of the sensor's name, else by the source type, else declared."""
    plane = F.coalesce(lookup(K.SOURCE_PLANES, F.lower(source_type)), F.lit("declared"))
    for part, name, _ in reversed(K.SENSORS):
        plane = F.when(F.lower(sensor).contains(part), name).otherwise(plane)
    return plane


def grade_of(sensor: Column) -> Column:
    grade = F.lit(None).cast("string")
    for part, _, name in reversed(K.SENSORS):
        grade = F.when(F.lower(sensor).contains(part), name).otherwise(grade)
    return grade


def provider_of(resource: Column) -> Column:
    """The key manager in the cloud that a resource's name belongs to."""
    low = F.lower(resource)
    return F.when(resource.contains("arn:aws:kms"), "aws").when(low.contains("azure"), "azure").when(resource.contains("cryptoKeys") | low.contains("gcp") | resource.contains("googleapis"), "gcp")


def usage_of(usage: Column) -> Column:
    up = F.upper(F.coalesce(usage, F.lit("")))
    return F.when(up.contains("SIGN"), "signing").when(up.contains("AGREE"), "key_agreement").otherwise("encryption")


def with_ownership(assets: DataFrame) -> DataFrame:
    """Adds fixer (who can change it) and fixer_name: as recorded, else blocked by a token (or one that isn't ready), else lacking at the provider, else outside the register."""
    blocked = F.coalesce(F.col("change_blocked"), F.lit(False)) | F.coalesce(~F.col("hsm_pqc_ready"), F.lit(False))
    provider = F.when(F.col("discovered_by").contains("cloud_kms"), provider_of(F.col("resource")))
    named = F.coalesce(*[F.when(F.col("_provider") == k, name) for k, (name, _) in K.PROVIDERS.items()])
    offers = F.coalesce(*[F.when(F.col("_provider") == k, F.col("_usage").isin(*usages) if usages else F.lit(False)) for k, (_, usages) in K.PROVIDERS.items()])
    asks = F.col("_provider").isNotNull() & F.col("quantum_vulnerable")
    seen = plane_of(F.coalesce("discovered_by", "source_type"), F.col("source_type")) == "observed"
    rows = assets.withColumns({"_provider": provider, "_usage": usage_of(F.col("key_usage"))})
    fixer = (
        F.when(F.col("recorded").isin(*RECORDED), F.col("recorded"))
        .when(blocked, "vendor_firmware_gated")
        .when(asks, F.when(offers, "self_managed").otherwise("provider_gated"))
        .when(seen & F.col("system").isNull(), "third_party")
        .otherwise("self_managed")
    )
    name = (
        F.when(F.col("recorded").isin(*RECORDED), F.coalesce("owner_name", F.lit("")))
        .when(blocked, F.coalesce("hsm_model", "hsm_token", F.lit("HSM vendor")))
        .when(asks, F.when(offers, F.coalesce("owner_name", F.lit("Key owner"))).otherwise(named))
        .when(seen & F.col("system").isNull(), F.col("resource"))
        .otherwise(F.coalesce("system", "owner_name", F.lit("Owning team")))
    )
    return rows.withColumns({"fixer": fixer, "fixer_name": name}).drop("_provider", "_usage")


def library_stack() -> Column:
    """The code that a library gates: a language, or native for those that are linked."""
    runtime = F.coalesce(lookup(K.RUNTIME_STACKS, F.col("library")), F.lit("native"))
    return F.when(F.col("runtime").isNotNull(), runtime).when(F.col("linkage") == "bundled", "java").otherwise(F.coalesce(lookup(K.ECOSYSTEM_STACKS, F.col("ecosystem")), F.lit("native")))


def asset_stack() -> Column:
    return F.when(F.col("language").isNotNull() & (F.col("language") != ""), F.when(F.col("language") == "c", "native").otherwise(F.col("language"))).otherwise("native")


def prerequisites(assets: DataFrame) -> DataFrame:
    """system, stack, steps: distinct upgrades of libraries that can't do post-quantum algorithms, for each stack of a system."""
    blocked = assets.where("asset_class = 'crypto_library' and pqc_capable = false and system is not null")
    step = F.coalesce("upgrade_path", F.concat(F.lit("Upgrade "), "library"))
    return blocked.groupBy("system", library_stack().alias("stack")).agg(F.sort_array(F.collect_set(step)).alias("steps"))  # distinct steps only


def changes(assets: DataFrame, profile: str = "commercial") -> DataFrame:
    """One row for each asset with a need: target, effort label and who can fix it, made row by row."""
    nth = ("commercial", "cnsa").index(profile)
    target = lookup({k: v[nth] for k, v in K.TARGETS.items()}, F.col("need"))
    effort = F.when(F.coalesce("y", F.lit(0.0)) <= 0.5, "configuration change").when(F.col("y") <= 1.5, "one release cycle").otherwise("multi-release programme")
    return with_ownership(assets.where("need is not null")).withColumns({"target": F.when(F.col("need") == "library_upgrade", F.coalesce("upgrade_path", F.concat(F.lit("Upgrade "), "library"))).otherwise(target), "effort": effort, "stack": asset_stack()})


def recommended(assets: DataFrame, profile: str = "commercial") -> DataFrame:
    """One row for each asset with a need: target, effort label, who can fix it, and the steps that must come first.

    assets are read twice, once for the libraries only. The steps are a row for each stack of a system and go to the assets while they are few.
    """
    out = changes(assets, profile).join(sent(prerequisites(assets), "prerequisites", BROADCAST_ROWS), ["system", "stack"], "left")
    steps = F.when(F.col("need").isin(*K.MIGRATION_NEEDS), F.array_join("steps", "; "))
    return out.select("id", "need", "target", "effort", "fixer", "fixer_name", "stack", steps.alias("first_steps"), "quantum_vulnerable", "deadline_year")


def uncovered(assets: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Vulnerable assets that no recommendation speaks of. While they are few, only recommendations with the hash of one's id are moved to be compared."""
    rest, key = written(assets.where("quantum_vulnerable").select("id"), "vulnerable"), F.xxhash64("id").alias("_key")
    named = recommendations.select("id")
    if rest.count() <= HASHES_SENT:
        named = written(named.select("id", key).join(F.broadcast(rest.select(key).distinct()), "_key", "left_semi").select("id"), "named")
    return rest.join(named, "id", "left_anti")


def tallies(recommendations: DataFrame) -> DataFrame:
    """Counts by need and by who can fix it, in one pass."""
    n, f = F.col("need"), F.col("fixer")
    out = recommendations.groupingSets([[n], [f]], "need", "fixer").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return out.select(F.when(F.col("g") == 1, "need").otherwise("fixer").alias("level"), F.coalesce("need", "fixer").alias("name"), "n")


def clauses(recommendations: DataFrame, organisation: str = "the Customer") -> DataFrame:
    """A clause for each supplier whose hardware or service holds a change up: what it must support, and by when."""
    held = recommendations.where(F.col("quantum_vulnerable") & F.col("fixer").isin("vendor_firmware_gated", "provider_gated"))
    by = held.groupBy("fixer", "fixer_name").agg(F.count("*").alias("affects"), F.sort_array(F.collect_set("target")).alias("targets"), F.min("deadline_year").alias("earliest"))
    named = F.array_join(F.filter("targets", lambda t: t.rlike("ML-|SLH|LMS|X25519MLKEM")), ", ")
    what = F.coalesce(F.nullif(named, F.lit("")), F.lit("NIST-standardised post-quantum algorithms (FIPS 203, 204, 205)"))
    when = F.coalesce(F.concat(F.lit("31 December "), (F.col("earliest") - 1).cast("string")), F.lit("a date agreed in writing"))
    product = F.when(F.col("fixer") == "vendor_firmware_gated", "the hardware security modules").otherwise("the key management service")
    demand = F.concat(F.col("fixer_name"), F.lit(" shall support "), what, F.lit(" in "), product, F.lit(f" supplied to {organisation} by "), when)
    return by.select(F.col("fixer").alias("kind"), F.col("fixer_name").alias("supplier"), "affects", F.array_join("targets", ", ").alias("capabilities"), "earliest", demand.alias("clause"))
