"""Readers of key managers' exports: documents (path, text: a JSON text each) in, findings out. Every reader names the fields that it
takes, so nothing that may be key material is ever read.

Findings: source, id, location, asset_class, algorithm, key_size, usage, starts, ends, owner, state, blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("source", "id", "location", "asset_class", "algorithm", "key_size", "usage", "starts", "ends", "owner", "state", "blocked")
KINDS = dict(zip(FIELDS, ("string", "string", "string", "string", "string", "int", "string", "string", "string", "string", "string", "boolean"), strict=True))
# Key types of tokens, and key specs of cloud services: algorithm, bits. Fixed values.
KEY_TYPES = {"CKK_RSA": "RSA", "CKK_EC": "ECDSA", "CKK_ECDSA": "ECDSA", "CKK_AES": "AES", "CKK_DES3": "3DES", "CKK_GENERIC_SECRET": "HMAC"}
KEY_SPECS = {
    "SYMMETRIC_DEFAULT": ("AES", 256),
    "RSA_2048": ("RSA", 2048),
    "RSA_3072": ("RSA", 3072),
    "RSA_4096": ("RSA", 4096),
    "ECC_NIST_P256": ("ECDSA", 256),
    "ECC_NIST_P384": ("ECDSA", 384),
    "EC_SIGN_P256_SHA256": ("ECDSA", 256),
    "EC_SIGN_P384_SHA384": ("ECDSA", 384),
    "RSA_SIGN_PKCS1_2048_SHA256": ("RSA", 2048),
    "RSA_SIGN_PKCS1_4096_SHA256": ("RSA", 4096),
    "GOOGLE_SYMMETRIC_ENCRYPTION": ("AES", 256),
}
CERTIFICATE_KEYS = {"RSA_1024": ("RSA", 1024), "RSA_2048": ("RSA", 2048), "RSA_3072": ("RSA", 3072), "RSA_4096": ("RSA", 4096), "EC_prime256v1": ("ECDSA", 256), "EC_secp384r1": ("ECDSA", 384), "EC_secp521r1": ("ECDSA", 521)}
CURVES = {"P-256": 256, "P-384": 384, "P-521": 521}


def _of(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in KINDS.items()])


def _parsed(documents: DataFrame, name: str, schema: str) -> DataFrame:
    """The documents called so, each parsed on its own: one that isn't JSON gives nulls and loses no other."""
    return documents.where(F.element_at(F.split("path", "/"), -1) == name).select("path", F.from_json("text", schema).alias("d"))


def _says(label: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [label.contains(w) for w in words])


def pkcs11(documents: DataFrame) -> DataFrame:
    """Objects on the tokens of hardware modules. A token without post-quantum mechanisms holds every change of its keys up."""
    obj = "struct<CKA_LABEL:string,CKA_KEY_TYPE:string,CKA_MODULUS_BITS:int,CKA_VALUE_LEN:int,CKA_EC_CURVE_NAME:string,CKA_SIGN:boolean,CKA_START_DATE:string,CKA_END_DATE:string,owner:string>"
    slots = _parsed(documents, "pkcs11.json", f"slots array<struct<slot_id:string,token_label:string,pqc_ready:boolean,objects:array<{obj}>>>").select(F.explode("d.slots").alias("s"))
    rows = slots.select(F.coalesce("s.token_label", F.lit("unknown-token")).alias("token"), "s.slot_id", F.coalesce("s.pqc_ready", F.lit(False)).alias("ready"), F.explode("s.objects").alias("o"))
    label, kind, signs = F.coalesce("o.CKA_LABEL", F.lit("")), F.coalesce("o.CKA_KEY_TYPE", F.lit("")), F.coalesce("o.CKA_SIGN", F.lit(False))
    low = F.lower(label)
    cls = (
        F.when(_says(low, "firmware"), "firmware_signing")
        .when(_says(low, "code", "release"), "code_signing")
        .when(_says(low, "device", "-ca", "issuing"), "issuing_ca")
        .when(_says(low, "pin", "card", "cvk", "issuer-master", "emv"), "payment_hsm")
        .when(_says(low, "token", "jwt"), "token_signing")
        .when(kind.isin("CKK_AES", "CKK_DES3"), "backup_encryption")
        .otherwise(F.when(signs, "code_signing").otherwise("generic_key"))
    )
    bits = F.when(F.col("o.CKA_EC_CURVE_NAME") == "secp256r1", 256).otherwise(F.coalesce(F.nullif("o.CKA_MODULUS_BITS", F.lit(0)), F.col("o.CKA_VALUE_LEN") * 8))
    return _rows(
        rows,
        source=F.lit("vault_pkcs11"), id=F.regexp_replace(F.lower(F.concat(F.lit("vault-hsm-"), "token", F.lit("-"), label)), " ", "-"), location=F.concat(F.lit("pkcs11://"), "token", F.lit("/slot"), F.coalesce("slot_id", F.lit("")), F.lit("/"), label),
        asset_class=cls, algorithm=F.coalesce(_of(KEY_TYPES, kind), F.regexp_replace(kind, "CKK_", "")), key_size=bits, usage=F.when(signs, "sign").otherwise("encrypt"),
        starts=F.col("o.CKA_START_DATE"), ends=F.col("o.CKA_END_DATE"), owner=F.col("o.owner"), blocked=~F.col("ready"),
    )


def kmip(documents: DataFrame) -> DataFrame:
    """Objects of key managers that speak KMIP, with their state: a deactivated key may still be needed to read what it wrapped."""
    obj = "struct<`Unique Identifier`:string,Name:string,`Cryptographic Algorithm`:string,`Cryptographic Length`:int,`Cryptographic Usage Mask`:array<string>,`Activation Date`:string,`Deactivation Date`:string,State:string>"
    rows = _parsed(documents, "kmip.json", f"endpoint string, objects array<{obj}>").select(F.coalesce("d.endpoint", F.lit("kmip://")).alias("at"), F.explode("d.objects").alias("o"))
    uid = F.coalesce("o.`Unique Identifier`", F.lit(""))
    low = F.lower(F.coalesce("o.Name", uid))
    cls = F.when(_says(low, "tde", "archive", "backup"), "backup_encryption").when(_says(low, "jwt", "signing"), "token_signing").when(_says(low, "tls"), "tls_certificate").otherwise("generic_key")
    return _rows(
        rows,
        source=F.lit("vault_kmip"), id=F.lower(F.concat(F.lit("vault-kmip-"), uid)), location=F.concat("at", F.lit("/"), uid), asset_class=cls, algorithm=F.col("o.`Cryptographic Algorithm`"), key_size=F.col("o.`Cryptographic Length`"),
        usage=F.nullif(F.array_join("o.`Cryptographic Usage Mask`", ","), F.lit("")), starts=F.col("o.`Activation Date`"), ends=F.col("o.`Deactivation Date`"), state=F.col("o.State"),
    )


def cloud_keys(documents: DataFrame) -> DataFrame:
    """Keys of three cloud services, whose documents have nothing in common but what is made of them here."""
    schema = (
        "aws_kms struct<keys:array<struct<KeyId:string,Arn:string,KeySpec:string,KeyUsage:string>>>, azure_key_vault struct<keys:array<struct<kid:string,kty:string,key_size:int,crv:string,key_ops:array<string>,attributes:struct<exp:string>>>>,"
        "gcp_kms struct<crypto_key_versions:array<struct<name:string,algorithm:string>>>"
    )
    d = _parsed(documents, "cloud_kms.json", schema)
    back = lambda column, n: F.element_at(F.split(column, "/"), -n)

    def keys(rows: DataFrame, id_: Column, location: Column, spec: Column, usage: Column, ends: Column) -> DataFrame:
        algorithm = F.coalesce(_of({k: v[0] for k, v in KEY_SPECS.items()}, spec), spec)
        cls = F.when(algorithm == "AES", "generic_key").otherwise("token_signing")
        return _rows(rows, source=F.lit("vault_cloud_kms"), id=id_, location=location, asset_class=cls, algorithm=algorithm, key_size=_of({k: v[1] for k, v in KEY_SPECS.items()}, spec), usage=usage, ends=ends)

    none = F.lit(None).cast("string")
    aws = d.select(F.explode("d.aws_kms.keys").alias("k"))
    azure = d.select(F.explode("d.azure_key_vault.keys").alias("k"))
    gcp = d.select(F.explode("d.gcp_kms.crypto_key_versions").alias("k"))
    spec = F.when(F.col("k.kty") == "RSA", F.concat(F.lit("RSA_"), F.col("k.key_size").cast("string"))).otherwise(F.concat(F.lit("ECC_NIST_"), F.regexp_replace(F.coalesce("k.crv", F.lit("")), "-", "")))
    parts = [
        keys(aws, F.concat(F.lit("vault-aws-"), F.substring("k.KeyId", 1, 8)), F.col("k.Arn"), F.coalesce("k.KeySpec", F.lit("")), F.col("k.KeyUsage"), none),
        keys(azure, F.concat(F.lit("vault-azure-"), back("k.kid", 1)), F.col("k.kid"), spec, F.array_join("k.key_ops", ","), F.col("k.attributes.exp")),
        keys(gcp, F.concat(F.lit("vault-gcp-"), back("k.name", 3), F.lit("-"), back("k.name", 1)), F.col("k.name"), F.coalesce("k.algorithm", F.lit("")), none, none),
    ]
    return reduce(DataFrame.unionByName, parts)


def cloud_certificates(documents: DataFrame) -> DataFrame:
    """Certificates of two cloud services, by what the services themselves say of their keys."""
    schema = (
        "aws_acm struct<certificates:array<struct<Certificate:struct<CertificateArn:string,KeyAlgorithm:string,NotBefore:string,NotAfter:string,Status:string>>>>,"
        "azure_key_vault struct<certificates:array<struct<id:string,policy:struct<key_props:struct<kty:string,key_size:int,crv:string>>,attributes:struct<nbf:string,exp:string>>>>"
    )
    d = _parsed(documents, "cloud_kms.json", schema)
    acm = d.select(F.explode("d.aws_acm.certificates").alias("x")).select("x.Certificate.*")
    azure = d.select(F.explode("d.azure_key_vault.certificates").alias("c"))
    kty = F.coalesce("c.policy.key_props.kty", F.lit(""))
    key, name = F.col("KeyAlgorithm"), F.substring(F.element_at(F.split("CertificateArn", "/"), -1), 1, 12)
    one = _rows(
        acm,
        source=F.lit("vault_cloud_certificate/aws"), id=F.concat(F.lit("vault-acm-"), name), location=F.col("CertificateArn"), asset_class=F.lit("tls_certificate"), algorithm=F.coalesce(_of({k: v[0] for k, v in CERTIFICATE_KEYS.items()}, key), key),
        key_size=_of({k: v[1] for k, v in CERTIFICATE_KEYS.items()}, key), usage=F.lit("signing"), starts=F.col("NotBefore"), ends=F.col("NotAfter"), state=F.col("Status"),
    )
    two = _rows(
        azure,
        source=F.lit("vault_cloud_certificate/azure"), id=F.concat(F.lit("vault-azcert-"), F.element_at(F.split(F.regexp_replace("c.id", "/+$", ""), "/"), -2)), location=F.col("c.id"), asset_class=F.lit("tls_certificate"),
        algorithm=F.when(kty.startswith("RSA"), "RSA").when(kty.startswith("EC"), "ECDSA").otherwise(F.nullif(kty, F.lit(""))), key_size=F.coalesce("c.policy.key_props.key_size", _of(CURVES, F.col("c.policy.key_props.crv"))),
        usage=F.lit("signing"), starts=F.col("c.attributes.nbf"), ends=F.col("c.attributes.exp"),
    )
    return one.unionByName(two)


def keystores(documents: DataFrame) -> DataFrame:
    """Entries of keystores. A subject that calls itself a root or issuing authority is one."""
    entry = "struct<alias:string,subject_dn:string,key_algorithm:string,key_size:int,valid_from:string,valid_until:string>"
    rows = _parsed(documents, "keystores.json", f"stores array<struct<path:string,entries:array<{entry}>>>").select(F.explode("d.stores").alias("s")).select("s.path", F.explode("s.entries").alias("e"))
    subject = F.coalesce("e.subject_dn", F.lit(""))
    cls = F.when(subject.contains("Root CA"), "root_ca").when(subject.contains("Issuing CA"), "issuing_ca").otherwise("tls_certificate")
    return _rows(
        rows,
        source=F.lit("vault_keystore"), id=F.regexp_replace(F.lower(F.concat(F.lit("vault-ks-"), "path", F.lit("-"), "e.alias")), "[/.]", "-"), location=F.concat("path", F.lit("#"), "e.alias"), asset_class=cls,
        algorithm=F.col("e.key_algorithm"), key_size=F.col("e.key_size"), starts=F.col("e.valid_from"), ends=F.col("e.valid_until"),
    )


def certificates(documents: DataFrame) -> DataFrame:
    """Certificates of chains."""
    c = "struct<subject:string,sha256_fingerprint:string,public_key_algorithm:string,public_key_size:int,basic_constraints_ca:boolean,self_signed:boolean,not_before:string,not_after:string>"
    rows = _parsed(documents, "certificates.json", f"certificates array<{c}>").select(F.explode("d.certificates").alias("c"))
    ca, own = F.coalesce("c.basic_constraints_ca", F.lit(False)), F.coalesce("c.self_signed", F.lit(False))
    return _rows(
        rows,
        source=F.lit("vault_certificate"), id=F.regexp_replace(F.lower(F.concat(F.lit("vault-cert-"), F.substring(F.coalesce("c.sha256_fingerprint", F.lit("")), 1, 17))), ":", ""),
        location=F.regexp_replace(F.element_at(F.split(F.coalesce("c.subject", F.lit("")), ","), 1), "CN=", ""), asset_class=F.when(ca & own, "root_ca").when(ca, "issuing_ca").otherwise("tls_certificate"),
        algorithm=F.col("c.public_key_algorithm"), key_size=F.col("c.public_key_size"), starts=F.col("c.not_before"), ends=F.col("c.not_after"),
    )


READERS = {"pkcs11.json": (pkcs11,), "kmip.json": (kmip,), "cloud_kms.json": (cloud_keys, cloud_certificates), "keystores.json": (keystores,), "certificates.json": (certificates,)}


def findings(documents: DataFrame) -> DataFrame:
    """What all exports hold."""
    return reduce(DataFrame.unionByName, [read(documents) for readers in READERS.values() for read in readers])


def gaps(documents: DataFrame) -> DataFrame:
    """name, reason: sources that should be there and aren't, or can't be read. With a manifest only the sources that it declares are expected."""
    base = F.element_at(F.split("path", "/"), -1)
    have = documents.select(base.alias("name"), F.try_parse_json("text").isNotNull().alias("readable")).groupBy("name").agg(F.max("readable").alias("readable"))
    said = _parsed(documents, "manifest.json", "sources array<struct<file:string>>").select(F.explode("d.sources").alias("s")).select(F.col("s.file").alias("name"), F.lit(True).alias("declared")).distinct()
    known = documents.sparkSession.createDataFrame([(n,) for n in READERS], "name string")
    some = said.agg((F.count("*") > 0).alias("some"))
    every = known.join(have, "name", "left").join(said, "name", "left").crossJoin(some)  # five rows, one row
    missing = every.where("readable is null and (declared or not some)").select("name", F.lit("missing").alias("reason"))
    return missing.unionByName(every.where("readable = false").select("name", F.lit("unreadable").alias("reason")))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("source").agg(F.count("*").alias("objects"), F.count_if("blocked").alias("blocked"))
