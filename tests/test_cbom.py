"""Documents of components: what validation catches, what stays the same, and what is empty."""

import json

import pytest
from pyspark.sql import functions as F

from quantalog.operators import cbom
from quantalog.plans import cbom as plan

GOOD = {
    "bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": "urn:uuid:12345678-1234-1234-1234-1234567890ab", "version": 1, "metadata": {"timestamp": "2026-01-01T00:00:00+02:00", "tools": [{"name": "t"}], "component": {"name": "e"}},
    "components": [
        {"type": "cryptographic-asset", "name": "AES", "bom-ref": "a", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "ae", "nistQuantumSecurityLevel": 6, "certificationLevel": ["cc-eal4+"]}}},
        {"type": "cryptographic-asset", "name": "k", "bom-ref": "k", "cryptoProperties": {"assetType": "related-crypto-material", "relatedCryptoMaterialProperties": {"type": "key", "algorithmRef": "a", "creationDate": "2026-01-01"}}},
        {"type": "cryptographic-asset", "name": "p", "bom-ref": "p", "cryptoProperties": {"assetType": "protocol", "protocolProperties": {"type": "tls", "cryptoRefArray": ["a"], "cipherSuites": [{"name": "s", "algorithms": ["a", "k"]}]}}},
        {"type": "library", "name": "l", "bom-ref": "l"},
    ],
    "dependencies": [{"ref": "k", "dependsOn": ["a"]}],
}


def changed(path, value):
    document = json.loads(json.dumps(GOOD))
    *places, last = path
    inner = document
    for place in places:
        inner = inner[place]
    inner[last] = value
    return json.dumps(document)


ALGORITHM = ("components", 0, "cryptoProperties", "algorithmProperties")
CASES = [
    (json.dumps(GOOD), {}), (None, {"envelope": 4, "metadata": 3, "components": 1}), ("[]", {"envelope": 4, "metadata": 3, "components": 1}), ("{}", {"envelope": 4, "metadata": 3, "components": 1}), (changed(("version",), 0), {"envelope": 1}), (changed(("serialNumber",), ""), {"envelope": 1}),
    (changed(("metadata", "timestamp"), "yesterday"), {"metadata": 1}), (changed(("metadata", "timestamp"), "2026-02-30T00:00:00Z"), {"metadata": 1}), (changed(("metadata", "tools"), []), {"metadata": 1}), (changed(("components",), []), {"ref_integrity": 2}),
    (changed(("components", 0, "bom-ref"), "k"), {"bomref_unique": 1, "ref_integrity": 4}), (changed(("components", 0, "bom-ref"), None), {"component_required": 1, "ref_integrity": 4}), (changed(("components", 3, "name"), ""), {"component_required": 1}), (changed(("components", 3, "type"), "file"), {"component_required": 1, "asset_type": 1}),
    (changed((*ALGORITHM, "primitive"), "cipher"), {"primitive": 1}), (changed((*ALGORITHM, "mode"), "xts"), {"mode_padding": 1}), (changed((*ALGORITHM, "padding"), "none"), {"mode_padding": 1}), (changed((*ALGORITHM, "nistQuantumSecurityLevel"), 7), {"nist_level": 1}), (changed((*ALGORITHM, "cryptoFunctions"), ["sign", "sing", "x"]), {"crypto_functions": 2}),
    (changed((*ALGORITHM, "executionEnvironment"), "cloud"), {"execution_env": 1}), (changed((*ALGORITHM, "implementationPlatform"), "z80"), {"execution_env": 1}), (changed((*ALGORITHM, "certificationLevel"), ["fips140-4-l1"]), {"certification_level": 1}), (changed(("components", 0, "cryptoProperties", "assetType"), "thing"), {"asset_type": 1}),
    (changed(("components", 0, "cryptoProperties", "protocolProperties"), {"type": "tls"}), {"property_object": 1}), (changed(("components", 2, "cryptoProperties"), {"assetType": "protocol"}), {"property_object": 1}), (changed(("components", 1, "cryptoProperties", "relatedCryptoMaterialProperties", "type"), "lock"), {"material_type": 1}),
    (changed(("components", 1, "cryptoProperties", "relatedCryptoMaterialProperties", "expirationDate"), "soon"), {"dates": 1}), (changed(("components", 2, "cryptoProperties", "protocolProperties", "type"), "smtp"), {"protocol_type": 1}), (changed(("components", 2, "cryptoProperties", "protocolProperties", "cryptoRefArray"), ["a", "z", "y"]), {"ref_integrity": 2}),
    (changed(("dependencies", 0, "dependsOn"), ["z"]), {"ref_integrity": 1}), (changed(("dependencies", 0, "ref"), "z"), {"ref_integrity": 1}),
]


def test_rules(spark):
    texts = spark.createDataFrame([(f"d{n:02}", t) for n, (t, _) in enumerate(CASES)], "document string, text string")
    found = {}
    for r in cbom.violations(texts).collect():
        found.setdefault(r.document, {}).setdefault(r.rule, 0)
        found[r.document][r.rule] += 1
    assert {f"d{n:02}": found.get(f"d{n:02}", {}) for n in range(len(CASES))} == {f"d{n:02}": faults for n, (_, faults) in enumerate(CASES)}
    report = {r.rule: r for r in cbom.validation(texts, examples=2).collect()}
    assert report["envelope"].documents == 5 and report["envelope"].violations == 14 and report["envelope"].examples == ["d01: bomFormat", "d01: serialNumber"]


def test_nothing(spark):
    none = plan.assets(spark, "/root/testdata/sf0.001").limit(0)
    made = cbom.components(none, plan.AT)
    assert made.count() == 0 and cbom.documents(made, "e", plan.AT).count() == 0
    texts = spark.createDataFrame([], "document string, text string")
    assert all(r.passed and not r.violations for r in cbom.validation(texts).collect())
    assert cbom.conformance(texts).count() == cbom.assets(texts).count() == 0
    with pytest.raises(ValueError):
        cbom.documents(made, "e", plan.AT, spec="1.4")


def test_same_bytes_whatever_the_order(spark):
    rows = plan.assets(spark, "/root/testdata/sf0.001").where("cast(substring(id, 2) as int) < 60")
    one, two = ([tuple(r) for r in cbom.documents(cbom.components(df, plan.AT), "e", plan.AT, most=50).orderBy("number").collect()] for df in (rows, rows.repartition(7).unionByName(rows)))
    assert one and one == two
    assert all(json.loads(text)["bomFormat"] == "CycloneDX" for _, text in one)


def test_assets_are_dealt_by_number(spark, tmp_path):
    """A file of keys is one task; what is made of them isn't."""
    spark.range(60_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = plan.assets(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 3 and max(r["count"] for r in dealt) <= plan.ASSETS and sum(r["count"] for r in dealt) == 60_000


def test_components_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(cbom, "TASK_COMPONENTS", 10)
    made = cbom.components(plan.assets(spark, "/root/testdata/sf0.001"), plan.AT)
    assert made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40
    docs = cbom.documents(made, "estate", plan.AT, by_asset=True)
    assert docs.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 40
