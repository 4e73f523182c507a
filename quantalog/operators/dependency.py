"""Edges between assets, and what they say about single assets. assets: id, location, asset_class, cert_subject, cert_issuer, public_key, scope, library, via_library, tags array<string>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalog.functions import constants as K


def _to_anchor(assets: DataFrame, key: Column, kind: str) -> DataFrame:
    """Every member of a group depends on its anchor: the first with a certificate, else the first. A star, so no pairs of members."""
    keyed = assets.select("id", "cert_subject", key.alias("key")).where("key is not null")
    anchor = keyed.groupBy("key").agg(F.min(F.struct(F.col("cert_subject").isNull().alias("bare"), "id")).alias("a"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(anchor.select("key", F.col("a.id").alias("target")), "key").select(F.col("id").alias("source"), "target", F.lit(kind).alias("kind"))


def edges(assets: DataFrame, most_tagged: int = K.MOST_TAGGED) -> DataFrame:
    """source depends on target; kind tells why: chain of certificates, shared endpoint, same key pair, library, trust anchor of a tag.

    A tag that more than most_tagged assets carry says nothing, so no tag makes more than the square of that many edges.
    """
    subjects = assets.where("cert_subject is not null").groupBy(F.col("cert_subject").alias("cert_issuer")).agg(F.min("id").alias("target"))
    chain = assets.where("cert_issuer is not null").join(subjects, "cert_issuer").select(F.col("id").alias("source"), "target", F.lit("certificate-chain").alias("kind"))
    hexed = F.lower(F.regexp_replace("public_key", "[^0-9A-Fa-f]", ""))
    libraries = assets.where("asset_class = 'crypto_library' and library is not null").groupBy("scope", F.col("library").alias("via_library")).agg(F.min("id").alias("target"))
    uses = assets.where("via_library is not null").select("id", "scope", "via_library").join(libraries, ["scope", "via_library"]).select(F.col("id").alias("source"), "target", F.lit("uses-library").alias("kind"))
    tagged = assets.select("id", "asset_class", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag")).where(~F.col("tag").isin(*K.GENERIC_TAGS))
    telling = tagged.groupBy("tag").count().where(F.col("count") <= most_tagged).select("tag")
    tagged = tagged.join(telling, "tag")
    anchors = tagged.where(F.col("asset_class").isin(*K.ANCHOR_CLASSES)).select("tag", F.col("id").alias("target"))
    members = tagged.where(~F.col("asset_class").isin(*K.ANCHOR_CLASSES)).select("tag", F.col("id").alias("source"))
    trust = members.join(anchors, "tag").select("source", "target", F.lit("trust-anchor").alias("kind"))
    parts = [chain, _to_anchor(assets, F.col("location"), "shared-endpoint"), _to_anchor(assets, F.when(F.length(hexed) >= 32, F.substring(hexed, 1, 32)), "same-key-pair"), uses, trust]
    return reduce(DataFrame.unionByName, parts).where("source != target").distinct()


def degrees(edges_: DataFrame) -> DataFrame:
    """node, direct_dependents, depends_on: edges that lead to a node and from it."""
    both = edges_.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges_.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("direct_dependents"), F.sum("o").alias("depends_on"))


def listing(edges_: DataFrame) -> DataFrame:
    """id, other, kind, direction: every edge seen from both of its ends."""
    out = edges_.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", F.lit("depends on").alias("direction"))
    return out.unionByName(edges_.select(F.col("target").alias("id"), F.col("source").alias("other"), "kind", F.lit("needed by").alias("direction")))


def weakly_seen(nodes: DataFrame, least: int = 3, below: float = 0.60, most: int = 10) -> DataFrame:
    """nodes: id, dependents, confidence. What much depends on and little is known about."""
    return nodes.where((F.col("dependents") >= least) & (F.col("confidence") < below)).orderBy(F.desc("dependents"), "confidence", "id").limit(most)


def flagged(clusters: DataFrame) -> DataFrame:
    """clusters: component, size, depth. Whether a cluster can be migrated now (it depends on nothing), and whether its members wait for each other."""
    return clusters.withColumns({"migratable_now": F.col("depth") == 1, "entangled": F.col("size") > 1})
