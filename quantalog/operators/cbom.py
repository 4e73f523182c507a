"""Documents of cryptographic components: export with references, rule by rule validation, conformance, and import.

An asset becomes up to four kinds of components, which name each other. They are rows until the end: documents are made of whole
assets and hold a bounded number of them, so no document grows with the estate. What is in a document is in a fixed order, so
equal assets give equal bytes. Checks are rows as well (a rule, a component, what is wrong), counted before anything is listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalog.functions.text import cipher_suite, stable_id
from quantalog.operators.checkpoints import dealt, written
from quantalog.operators.taxonomy import algorithm_facts

SPECS = ("1.7", "1.6")
#: Components (some kilobytes each with all their fields) that one task sorts or gathers.
TASK_COMPONENTS = 50_000
# Words of the public format for cryptographic components. Fixed values.
ASSET_TYPES = {"algorithm": "algorithmProperties", "certificate": "certificateProperties", "protocol": "protocolProperties", "related-crypto-material": "relatedCryptoMaterialProperties"}
PRIMITIVES = "drbg mac block-cipher stream-cipher signature hash pke xof kdf key-agree kem ae combiner other unknown".split()
FUNCTIONS = "generate keygen encrypt decrypt digest tag keyderive sign verify encapsulate decapsulate other unknown".split()
ENVIRONMENTS = "software-plain-ram software-encrypted-ram software-tee hardware other unknown".split()
PLATFORMS = "generic x86_32 x86_64 armv7-a armv7-m armv8-a armv8-m armv9-a armv9-m s390x ppc64 ppc64le other unknown".split()
MODES, PADDINGS = "cbc ecb ccm gcm cfb ofb ctr gcm-siv other unknown".split(), "pkcs5 pkcs7 pkcs1v15 oaep raw other unknown".split()
MATERIALS = "private-key public-key secret-key key ciphertext signature digest initialization-vector nonce seed salt shared-secret tag additional-data password credential token other unknown".split()
PROTOCOLS = "tls ssh ipsec ike sstp wpa other unknown".split()
LEVELS = ["none", "other", "unknown"] + [f"fips140-{s}-l{n}" for s in (1, 2, 3) for n in (1, 2, 3, 4)] + [f"cc-eal{n}{p}" for n in range(1, 8) for p in ("", "+")]
# What a use, and without one a primitive, does; paddings and states as sources spell them; package kinds with an address. Fixed values.
USES = {"signing": "sign verify", "encryption": "encrypt decrypt", "key_exchange": "keygen encapsulate decapsulate", "key_wrapping": "encrypt decrypt", "hashing": "digest", "key_derivation": "keyderive", "authentication": "sign verify"}
DOES = {
    "signature": "sign verify", "kem": "keygen encapsulate decapsulate", "key-agree": "keygen keyderive", "block-cipher": "encrypt decrypt", "stream-cipher": "encrypt decrypt", "ae": "encrypt decrypt tag", "hash": "digest", "mac": "tag", "kdf": "keyderive",
    "drbg": "generate", "pke": "encrypt decrypt",
}
PADDING_NAMES = {"pkcs5padding": "pkcs5", "pkcs7padding": "pkcs7", "pkcs1padding": "pkcs1v15", "oaeppadding": "oaep", "nopadding": "raw"}
KEY_STATES = {
    "pre-active": "pre-activation", "active": "active", "deactivated": "deactivated", "compromised": "compromised", "destroyed": "destroyed", "destroyed compromised": "destroyed", "enabled": "active", "disabled": "suspended", "pendingdeletion": "deactivated",
    "pendingimport": "pre-activation", "unavailable": "suspended",
}
PURLS = {"pypi": "pypi", "npm": "npm", "maven": "maven", "go": "golang", "cargo": "cargo", "nuget": "nuget", "composer": "composer", "gem": "gem", "conan": "conan"}

_REFS = "array<string>"
#: Fields in the order of their names, so that the text of a component is canonical.
ALGORITHM = "certificationLevel array<string>, classicalSecurityLevel int, cryptoFunctions array<string>, executionEnvironment string, implementationPlatform string, mode string, nistQuantumSecurityLevel int, padding string, parameterSetIdentifier string, primitive string"
CERTIFICATE = "certificateExtension string, certificateFormat string, issuerName string, notValidAfter string, notValidBefore string, serialNumber string, signatureAlgorithmRef string, subjectName string, subjectPublicKeyRef string"
PROTOCOL = f"cipherSuites array<struct<algorithms:{_REFS},name:string>>, cryptoRefArray {_REFS}, type string, version string"
MATERIAL = "activationDate string, algorithmRef string, creationDate string, expirationDate string, id string, size int, state string, type string"
CRYPTO = f"algorithmProperties struct<{ALGORITHM}>, assetType string, certificateProperties struct<{CERTIFICATE}>, protocolProperties struct<{PROTOCOL}>, relatedCryptoMaterialProperties struct<{MATERIAL}>"
COMPONENT = f"`bom-ref` string, cryptoProperties struct<{CRYPTO}>, name string, properties array<struct<name:string,value:string>>, purl string, type string, version string"
MADE = f"struct<component:struct<{COMPONENT}>,depends:{_REFS}>"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def bom_ref(*parts: Column) -> Column:
    return F.concat(F.lit("crypto:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def moment(value: Column) -> Column:
    """In RFC 3339, in UTC; null for what is none."""
    return F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _struct(fields: str, **values: Column) -> Column:
    """A struct of named columns with all fields of `fields`; those that aren't given are null."""
    names = [f.strip().split(" ")[0].strip("`") for f in _split(fields)]
    return F.struct(*[values.get(n.replace("-", "_"), F.lit(None)).alias(n) for n in names]).cast(f"struct<{fields}>")


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _made(kind: Column | str, ref: Column, name: Column, crypto: Column, depends: Column, **more: Column) -> Column:
    component = _struct(COMPONENT, bom_ref=ref, cryptoProperties=crypto, name=name, type=F.lit(kind) if isinstance(kind, str) else kind, **more)
    return F.struct(component.alias("component"), depends.alias("depends")).cast(MADE)


def _algorithm(ref: Column, facts: Column, bits: Column, mode: Column, padding: Column, usage: Column, place: Column, properties: Column) -> Column:
    primitive = F.when(facts["primitive"].isin(*PRIMITIVES), facts["primitive"]).otherwise("unknown")
    words = F.coalesce(F.try_element_at(_map(USES), usage), F.try_element_at(_map(DOES), primitive), F.lit("unknown"))
    canonical = facts["canonical"]
    size = F.when(canonical.rlike("^ML-(?:KEM|DSA)-"), F.element_at(F.split(canonical, "-"), -1)).otherwise(bits.cast("string"))
    named = F.when(primitive.isin("block-cipher", "ae") & F.lower(mode).isin(*MODES), F.lower(mode))
    shown = F.when(named.isNotNull() & ~named.isin("other", "unknown") & ~F.contains(F.upper(canonical), F.upper(named)), F.concat_ws("-", canonical, F.upper(named))).otherwise(canonical)
    properties_of = _struct(
        ALGORITHM, certificationLevel=F.array(F.lit("none")), classicalSecurityLevel=facts["classical_bits"], cryptoFunctions=F.split(words, " "), executionEnvironment=F.when(F.lower(place).startswith("hsm://"), "hardware").otherwise("software-plain-ram"),
        implementationPlatform=F.lit("generic"), mode=named, nistQuantumSecurityLevel=facts["nist_level"], padding=F.try_element_at(_map(PADDING_NAMES), F.lower(padding)), parameterSetIdentifier=size, primitive=primitive,
    )
    return _made("cryptographic-asset", ref, shown, _struct(CRYPTO, algorithmProperties=properties_of, assetType=F.lit("algorithm")), F.array().cast(_REFS), properties=properties)


def components(assets: DataFrame, as_of: str) -> DataFrame:
    """assets: id, name, algorithm, key_size, mode, padding, usage, asset_class, source_type, source_location, protocol, cipher_suite,
    cert_subject, cert_issuer, cert_serial, not_before, not_after, key_id, state, created, ecosystem, package, version, properties
    (map<string,string>). A row for each component: asset, ref, kind, component, depends. Of components with the same ref one stays.

    A library is one component. Anything else is an algorithm, and key material if it is a key in store or a certified one, and
    a certificate if it has a subject, and a protocol if it has a suite, an SSH or IPsec place, or a version of TLS; the parts of a suite are
    algorithms of their own.
    """
    col, usage, place = F.col, F.col("usage"), F.coalesce("source_location", F.lit(""))
    # What is known of names is worked out in tables of its own: inside of what follows it would be repeated at each mention.
    rows = written(assets.withColumns({"suite": cipher_suite(col("cipher_suite")), "ref": bom_ref(F.lit("algorithm"), col("id"))}), "assets")
    none = F.lit(None).cast("int")
    bits = {"key_exchange": none, "authentication": none, "bulk_cipher": col("suite.bulk_key_bits"), "mac": none}
    rows = written(rows.withColumns({"facts": algorithm_facts(col("algorithm"), col("key_size")), **{f"of_{n}": algorithm_facts(col(f"suite.{n}"), b) for n, b in bits.items()}}), "facts")
    extra = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    own = _algorithm(col("ref"), col("facts"), col("key_size"), col("mode"), col("padding"), usage, place, extra)

    def part(role: str, name: str, mode: Column) -> Column:
        facts = col(f"of_{name}")
        ref = F.when(facts["canonical"] == col("facts.canonical"), col("ref")).otherwise(bom_ref(F.lit("algorithm"), col("id"), F.lit(role), facts["canonical"]))
        made = _algorithm(ref, facts, bits[name], mode, F.lit(None), F.lit(None), place, F.array(F.struct(F.lit("suite-part-of").alias("name"), col("ref").alias("value"))))
        return F.when(col(f"suite.{name}").isNotNull(), made)

    parts = F.array_compact(F.array(part("key_exchange", "key_exchange", F.lit(None)), part("authentication", "authentication", F.lit(None)), part("cipher", "bulk_cipher", col("suite.mode")), part("mac", "mac", F.lit(None))))
    rows = written(rows.withColumns({"own": own, "parts": F.when(col("cipher_suite").isNotNull(), parts).otherwise(F.array().cast(f"array<{MADE}>"))}), "algorithms")
    of_suite = F.transform("parts", lambda p: p["component"]["bom-ref"])
    every = F.array_sort(F.array_union(F.array("ref"), of_suite))

    material_ref, now = bom_ref(F.lit("material"), col("id")), F.lit(as_of)
    keeps = (col("source_type") == "keystore") | col("cert_subject").isNotNull() | F.coalesce(col("key_id").isNotNull(), F.lit(False))
    start, end = moment(col("not_before")), moment(col("not_after"))
    plain = F.lower(F.regexp_replace("state", r"(?<=[a-zA-Z])_", ""))
    state = F.coalesce(F.try_element_at(_map(KEY_STATES), plain), F.when(end < now, "deactivated").when(start > now, "pre-activation").when(start.isNotNull() & end.isNotNull(), "active"))
    kind = F.when(usage.isin("signing", "key_wrapping"), "private-key").when(usage == "encryption", "secret-key").when(usage == "key_exchange", "shared-secret").otherwise("key")
    key = _struct(MATERIAL, activationDate=start, algorithmRef=col("ref"), creationDate=moment(col("created")), expirationDate=end, id=col("key_id"), size=F.nullif("key_size", F.lit(0)), state=state, type=kind)
    material = _made("cryptographic-asset", material_ref, F.concat("name", F.lit(" (key material)")), _struct(CRYPTO, assetType=F.lit("related-crypto-material"), relatedCryptoMaterialProperties=key), F.array("ref"))
    signed = _struct(
        CERTIFICATE, certificateExtension=F.lit("crt"), certificateFormat=F.lit("X.509"), issuerName=col("cert_issuer"), notValidAfter=end, notValidBefore=start, serialNumber=col("cert_serial"), signatureAlgorithmRef=col("ref"), subjectName=col("cert_subject"), subjectPublicKeyRef=material_ref,
    )
    certificate = _made("cryptographic-asset", bom_ref(F.lit("certificate"), col("id")), col("cert_subject"), _struct(CRYPTO, assetType=F.lit("certificate"), certificateProperties=signed), F.array_sort(F.array("ref", material_ref)))
    low = F.lower(place)
    speaks = F.when(col("asset_class") == "vpn_ipsec", "ike").when((col("source_type") == "ssh") | (col("asset_class") == "ssh_key_exchange") | low.startswith("ssh://"), "ssh").when((col("source_type") == "tls") | F.lower("protocol").contains("tls"), "tls")
    speaks = F.coalesce(speaks, F.when(low.contains("ipsec"), "ipsec").when(col("cipher_suite").isNotNull(), "tls"), F.lit("other"))
    versions = F.array_sort(F.split(F.trim(F.replace(F.replace(F.upper("protocol"), F.lit("TLSV"), F.lit("")), F.lit("SSH-"), F.lit(""))), r"\s+"))
    suites = F.when(F.size("parts") > 0, F.array(F.struct(of_suite.alias("algorithms"), col("cipher_suite").alias("name")))).when(col("cipher_suite").isNotNull(), F.array(F.struct(every.alias("algorithms"), col("cipher_suite").alias("name"))))
    said = _struct(PROTOCOL, cipherSuites=suites, cryptoRefArray=every, type=speaks, version=F.nullif(F.get(versions, F.lit(0)), F.lit("")))
    protocol = _made("cryptographic-asset", bom_ref(F.lit("protocol"), col("id")), col("name"), _struct(CRYPTO, assetType=F.lit("protocol"), protocolProperties=said), every)
    talks = col("cipher_suite").isNotNull() | ((col("source_type") == "tls") & col("protocol").isNotNull()) | speaks.isin("ike", "ssh")

    address = F.try_element_at(_map(PURLS), F.lower("ecosystem"))
    package = F.when(address == "pypi", F.lower(F.regexp_replace("package", r"[-_.]+", "-"))).when(address == "maven", F.regexp_replace("package", "^([^:]*):", "$1/")).when(address == "npm", F.regexp_replace("package", "^@", "%40")).otherwise(col("package"))
    mark = F.when((address == "golang") & ~F.startswith("version", F.lit("v")), F.concat(F.lit("@v"), "version")).otherwise(F.concat(F.lit("@"), "version"))
    purl = F.concat(F.lit("pkg:"), address, F.lit("/"), package, F.coalesce(mark, F.lit("")))
    library = _made("library", bom_ref(F.lit("library"), col("id")), F.coalesce("package", "name"), F.lit(None), F.array().cast(_REFS), version=col("version"), purl=purl, properties=extra)
    usual = F.concat(F.array("own"), F.filter("parts", lambda p: p["component"]["bom-ref"] != col("ref")), F.array_compact(F.array(F.when(keeps, material), F.when(col("cert_subject").isNotNull(), certificate), F.when(talks, protocol))))
    made = rows.select(col("id").alias("asset"), F.explode(F.when(col("asset_class") == "crypto_library", F.array(library)).otherwise(usual)).alias("m"))
    named = made.select("asset", F.col("m.component.bom-ref").alias("ref"), F.coalesce("m.component.cryptoProperties.assetType", "m.component.type").alias("kind"), "m.component", "m.depends")
    once = dealt(named, 4 * rows.count(), TASK_COMPONENTS, "ref").groupBy("ref").agg(F.min_by(F.struct("asset", "kind", "component", "depends"), "asset").alias("c"))
    return once.select("c.asset", "ref", "c.kind", "c.component", "c.depends")


def lines(made: DataFrame) -> DataFrame:
    """asset, ref, kind, depends, line: each component as canonical JSON."""
    return made.select("asset", "ref", "kind", F.array_sort("depends").alias("depends"), F.to_json("component").alias("line"))


def documents(made: DataFrame, estate: str, timestamp: str, spec: str = SPECS[0], most: int = 2000, by_asset: bool = False) -> DataFrame:
    """number, document: the estate as CycloneDX documents with some `most` components each, whole assets together; or one for each asset.

    Components and dependencies are sorted by ref. The serial number is a digest of estate, time and refs, so equal content has the same.
    """
    if spec not in SPECS:
        raise ValueError(f"spec {spec!r} is none of {SPECS}")
    rows = written(lines(made), "lines")
    number, count = F.col("asset"), rows.count()
    if not by_asset:
        number = F.pmod(F.conv(F.substring(F.sha2("asset", 256), 1, 15), 16, 10).cast("long"), F.lit(count // most + 1)).cast("string")
    held = dealt(rows.withColumn("number", number), count, TASK_COMPONENTS, "number").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("ref", "line", "depends"))).alias("c"))  # some `most` rows
    refs = F.array_join(F.col("c.ref"), "|")
    serial = F.concat(F.lit("urn:uuid:"), stable_id(F.lit(spec), F.lit(estate), F.lit(timestamp), refs))
    told = F.to_json(F.struct(F.transform("c", lambda c: F.struct(c["depends"].alias("dependsOn"), c["ref"].alias("ref"))).alias("dependencies")))
    head = F.to_json(F.struct(F.struct(F.struct(F.lit(estate).alias("name"), F.lit("application").alias("type")).alias("component"), F.lit(timestamp).alias("timestamp"), F.struct(F.array(F.struct(F.lit("quantalog").alias("name"), F.lit("application").alias("type"))).alias("components")).alias("tools")).alias("metadata"), serial.alias("serialNumber"), F.lit(spec).alias("specVersion"), F.lit(1).alias("version")))
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    text = F.concat(F.lit('{"bomFormat":"CycloneDX","components":['), F.array_join(F.col("c.line"), ","), F.lit("],"), inner(told), F.lit(","), inner(head), F.lit("}"))
    return held.select("number", text.alias("document"))


# Validation.

RULES = [
    ("envelope", "format, version of the format, serial number and version are well formed"), ("metadata", "a time in RFC 3339, tools and a target are named"), ("components", "there is a list of components"), ("component_required", "a component has a type, a name and a reference, a certificate a subject"),
    ("bomref_unique", "references are unique in a document"), ("asset_type", "the asset type is a known one"), ("property_object", "an asset type has its own properties and no others"), ("primitive", "known primitive"), ("crypto_functions", "known functions"),
    ("execution_env", "known environment and platform"), ("mode_padding", "known mode and padding"), ("material_type", "known kind of key material"), ("protocol_type", "known protocol"), ("certification_level", "known certification levels"), ("nist_level", "a level from 0 to 6"),
    ("dates", "dates are in RFC 3339"), ("ref_integrity", "what is referred to exists in the document"),
]
_READ_ALGORITHM = ALGORITHM.replace("nistQuantumSecurityLevel int", "nistQuantumSecurityLevel string").replace("classicalSecurityLevel int", "classicalSecurityLevel string")
_READ = COMPONENT.replace(ALGORITHM, _READ_ALGORITHM).replace("size int", "size string")
DOCUMENT = f"bomFormat string, specVersion string, serialNumber string, version string, metadata struct<timestamp:string,tools:string,component:struct<name:string>>, components array<struct<{_READ}>>, dependencies array<struct<ref:string,dependsOn:{_REFS}>>"


def _dated(text: Column) -> Column:
    return F.replace(text, F.lit("Z"), F.lit("+00:00")).rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::?\d\d(?::?\d\d(?:\.\d+)?)?)?(?:[+-]\d\d:?\d\d)?)?$") & F.substring(text, 1, 10).try_cast("date").isNotNull()


def violations(texts: DataFrame) -> DataFrame:
    """texts: document (its name), text. A row for each thing that is wrong: document, rule, at. A text that is no JSON breaks `envelope` and `components`."""
    read = written(texts.select("document", F.from_json("text", DOCUMENT).alias("d")), "read")  # parsed once, not once for each rule
    fault = lambda when, rule, at: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), (at if isinstance(at, Column) else F.lit(at)).cast("string").alias("at")))
    d = lambda path: F.col(f"d.{path}")
    absent = lambda c: c.isNull() | (c == "")
    whole = F.array(
        fault(~d("bomFormat").eqNullSafe(F.lit("CycloneDX")), "envelope", "bomFormat"), fault(d("specVersion").isNull() | ~d("specVersion").isin(*SPECS), "envelope", "specVersion"),
        fault(absent(d("serialNumber")) | ~d("serialNumber").rlike("^urn:uuid:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "envelope", "serialNumber"), fault(d("version").isNull() | ~d("version").rlike("^[1-9][0-9]*$"), "envelope", "version"),
        fault(d("metadata.timestamp").isNull() | ~_dated(d("metadata.timestamp")), "metadata", "timestamp"), fault(absent(d("metadata.tools")) | d("metadata.tools").isin("[]", "{}"), "metadata", "tools"), fault(absent(d("metadata.component.name")), "metadata", "component"),
        fault(d("components").isNull(), "components", "components"),
    )
    of_document = read.select("document", F.explode(F.array_compact(whole)).alias("f")).select("document", "f.*")

    rows = written(read.select("document", F.posexplode("d.components").alias("n", "c")), "components")
    c = lambda path: F.col(f"c.{path}")
    label = F.coalesce(F.nullif(c("bom-ref"), F.lit("")), F.concat(F.lit("components["), F.col("n").cast("string"), F.lit("]")))
    kind, crypto = c("type"), "cryptoProperties"
    asset = c(f"{crypto}.assetType")
    checked = ~kind.eqNullSafe(F.lit("library"))
    known = checked & asset.isin(*ASSET_TYPES)
    a, m, s, p = (f"{crypto}.{o}" for o in ("algorithmProperties", "relatedCryptoMaterialProperties", "certificateProperties", "protocolProperties"))
    outside = lambda path, words: known & c(path).isNotNull() & ~c(path).isin(*words)
    several = lambda path, words, rule: F.transform(F.filter(F.coalesce(c(path), F.array().cast(_REFS)), lambda x: ~x.isin(*words) | x.isNull()), lambda x: fault(known, rule, label))
    undated = lambda path: fault(known & c(path).isNotNull() & ~_dated(c(path)), "dates", label)
    own = F.concat(
        F.array(
            fault(kind.isNull() | ~kind.isin("cryptographic-asset", "library"), "component_required", label), fault(absent(c("name")), "component_required", label), fault(absent(c("bom-ref")), "component_required", label),
            fault(checked & (asset.isNull() | ~asset.isin(*ASSET_TYPES)), "asset_type", label), fault(known & c(s).isNotNull() & absent(c(f"{s}.subjectName")), "component_required", label),
            *[fault(known & (asset == t) & c(f"{crypto}.{o}").isNull(), "property_object", label) for t, o in ASSET_TYPES.items()], *[fault(known & (asset != t) & c(f"{crypto}.{o}").isNotNull(), "property_object", label) for t, o in ASSET_TYPES.items()],
            fault(outside(f"{a}.primitive", PRIMITIVES), "primitive", label), fault(outside(f"{a}.executionEnvironment", ENVIRONMENTS), "execution_env", label), fault(outside(f"{a}.implementationPlatform", PLATFORMS), "execution_env", label),
            fault(outside(f"{a}.mode", MODES), "mode_padding", label), fault(outside(f"{a}.padding", PADDINGS), "mode_padding", label), fault(known & c(f"{a}.nistQuantumSecurityLevel").isNotNull() & ~c(f"{a}.nistQuantumSecurityLevel").rlike("^[0-6]$"), "nist_level", label),
            fault(outside(f"{m}.type", MATERIALS), "material_type", label), fault(outside(f"{p}.type", PROTOCOLS), "protocol_type", label), *[undated(x) for x in (f"{m}.activationDate", f"{m}.expirationDate", f"{m}.creationDate", f"{s}.notValidBefore", f"{s}.notValidAfter")],
        ),
        several(f"{a}.cryptoFunctions", FUNCTIONS, "crypto_functions"), several(f"{a}.certificationLevel", LEVELS, "certification_level"),
    )
    of_components = rows.select("document", F.explode(F.array_compact(own)).alias("f")).select("document", "f.*")
    refs = rows.where(~absent(c("bom-ref"))).groupBy("document", c("bom-ref").alias("ref")).agg(F.count("*").alias("n"))
    again = refs.where("n > 1").select("document", F.lit("bomref_unique").alias("rule"), F.col("ref").alias("at"), F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k")).drop("k")

    empty = F.array().cast(_REFS)
    suites = F.flatten(F.transform(F.coalesce(c(f"{p}.cipherSuites"), F.array().cast(f"array<struct<algorithms:{_REFS},name:string>>")), lambda x: F.coalesce(x["algorithms"], empty)))
    pointed = F.concat(F.array_compact(F.transform(F.array(c(f"{m}.algorithmRef"), c(f"{s}.signatureAlgorithmRef"), c(f"{s}.subjectPublicKeyRef")), lambda x: F.nullif(x, F.lit("")))), F.coalesce(c(f"{p}.cryptoRefArray"), empty), suites)
    uses = rows.select("document", label.alias("at"), F.explode(pointed).alias("ref"))
    told = read.select("document", F.explode("d.dependencies").alias("x"))
    uses = uses.unionByName(told.where("x.ref <> ''").select("document", F.lit("dependencies").alias("at"), F.col("x.ref").alias("ref"))).unionByName(told.select("document", F.coalesce("x.ref", F.lit("dependencies")).alias("at"), F.explode("x.dependsOn").alias("ref")))
    listed = read.where("d.components is not null").select(F.col("document").alias("listed"))
    lost = uses.join(refs, ["document", "ref"], "left_anti").join(listed, F.col("document") == F.col("listed"), "left_semi").select("document", F.lit("ref_integrity").alias("rule"), "at")
    return reduce(DataFrame.unionByName, [of_document, of_components, again, lost])


def validation(texts: DataFrame, examples: int = 5) -> DataFrame:
    """rule, description, passed, violations, documents, examples: every rule with what breaks it; the examples are the first ones by document and place."""
    table = texts.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(RULES)], "place int, rule string, description string")
    found = written(violations(texts), "violations")
    counts = found.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("document").alias("documents"))
    first = found.distinct().withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("document", "at"))).where(F.col("n") <= examples)
    some = first.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "document", "at"))), lambda x: F.concat_ws(": ", x["document"], x["at"])).alias("examples"))
    out = table.join(F.broadcast(counts), "rule", "left").join(F.broadcast(some), "rule", "left")  # a row for each rule
    return out.select("place", "rule", "description", F.col("violations").isNull().alias("passed"), F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"), F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), F.coalesce("examples", F.array().cast(_REFS)).alias("examples"))


def _elements() -> list[tuple[str, str, Column, Column, Column]]:
    """asset type, element, whether it applies, whether it is there, why not."""
    c = lambda path: F.col(f"c.{path}")
    there = lambda v: F.coalesce((v != "") & (v != "unknown"), F.lit(False))
    yes, a, k, p, s = F.lit(True), "cryptoProperties.algorithmProperties", "cryptoProperties.relatedCryptoMaterialProperties", "cryptoProperties.protocolProperties", "cryptoProperties.certificateProperties"
    resolved, modal = ~F.lower(c("name")).startswith("unknown"), F.coalesce(c(f"{a}.primitive").isin("block-cipher", "ae"), F.lit(False))
    out = [
        ("algorithm", "Name", yes, resolved & there(c("name")), "not resolved"), ("algorithm", "Primitive", yes, there(c(f"{a}.primitive")), "not determined"), ("algorithm", "Mode", modal, there(c(f"{a}.mode")), "not stated"),
        ("algorithm", "Crypto functions", yes, F.coalesce((F.size(c(f"{a}.cryptoFunctions")) > 0) & (F.array_join(c(f"{a}.cryptoFunctions"), " ") != "unknown"), F.lit(False)), "use not known"), ("algorithm", "Classical security level", yes, c(f"{a}.classicalSecurityLevel").isNotNull(), F.when(resolved, "no key size").otherwise("not resolved")),
    ]
    out += [("related-crypto-material", e, yes, there(c(f"{k}.{f}")), "not recorded") for e, f in (("Id", "id"), ("State", "state"), ("Size", "size"), ("Creation date", "creationDate"), ("Activation date", "activationDate"))]
    out += [("protocol", "Version", yes, there(c(f"{p}.version")), "not stated"), ("protocol", "Cipher suites", yes, (F.coalesce(F.size(c(f"{p}.cipherSuites")), F.lit(0)) > 0) | (F.coalesce(F.size(c(f"{p}.cryptoRefArray")), F.lit(0)) > 0), "none recorded")]
    fields = ("subjectName", "issuerName", "notValidBefore", "notValidAfter", "signatureAlgorithmRef", "subjectPublicKeyRef", "certificateFormat", "certificateExtension")
    out += [("certificate", f, yes, there(c(f"{s}.{f}")), "not recorded") for f in fields]
    out += [(t, "Name", yes, there(c("name")), "no name") for t in ("related-crypto-material", "protocol", "certificate")] + [(t, "Asset type", yes, yes, "") for t in ASSET_TYPES]
    return [(t, e, w, x, r if isinstance(r, Column) else F.lit(r)) for t, e, w, x, r in out]


def conformance(texts: DataFrame, examples: int = 5) -> DataFrame:
    """asset_type, element, applicable, present, percent, missing (names of the first `examples` components by ref that lack it), reason (the commonest), reasons."""
    rows = written(texts.select(F.explode(F.from_json("text", DOCUMENT)["components"]).alias("c")).where("c.type = 'cryptographic-asset'"), "components")
    checks = F.array_compact(F.array(*[F.when(F.col("c.cryptoProperties.assetType") == t, F.struct(F.lit(t).alias("asset_type"), F.lit(e).alias("element"), w.alias("applies"), x.alias("there"), r.alias("reason"))) for t, e, w, x, r in _elements()]))
    each = written(rows.select(F.col("c.bom-ref").alias("ref"), "c.name", F.explode(checks).alias("k")).select("ref", "name", "k.*"), "elements")
    by = ["asset_type", "element"]
    counts = each.groupBy(*by).agg(F.count_if("applies").alias("applicable"), F.count_if(F.col("applies") & F.col("there")).alias("present"))
    gaps = each.where("applies and not there")
    first = gaps.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("ref", "name"))).where(F.col("n") <= examples).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("missing"))
    why = gaps.groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("reason"), F.count("*").alias("reasons"))
    out = counts.join(first, by, "left").join(why, by, "left")
    percent = F.round(100.0 * F.col("present") / F.nullif("applicable", F.lit(0)), 1)
    return out.select(*by, "applicable", "present", percent.alias("percent"), F.coalesce("missing", F.array().cast(_REFS)).alias("missing"), "reason", F.coalesce("reasons", F.lit(0).cast("bigint")).alias("reasons"))


def assets(texts: DataFrame) -> DataFrame:
    """Import: a row for each asset of documents (text): ref, name, algorithm, key_size, mode, usage, protocol, cipher_suite, cert_subject, key_id, package, version, properties.

    The algorithm that has properties stands for its asset; key material, certificate and protocol come to it by their references.
    """
    rows = written(texts.select(F.posexplode(F.from_json("text", DOCUMENT)["components"]).alias("n", "c")), "components")
    count = rows.count()
    by_ref = lambda part: dealt(part, count, TASK_COMPONENTS, "ref")
    c = lambda path: F.col(f"c.cryptoProperties.{path}")
    kind = c("assetType")
    said = F.map_from_entries(F.array_distinct("c.properties"))
    own = rows.where((kind == "algorithm") & ~F.exists("c.properties", lambda p: p["name"] == "suite-part-of")).select(
        F.col("c.bom-ref").alias("ref"), F.col("c.name").alias("algorithm"), c("algorithmProperties.parameterSetIdentifier").try_cast("int").alias("key_size"), c("algorithmProperties.mode").alias("mode"), said.alias("properties")
    )
    keys = rows.where(kind == "related-crypto-material").select(c("relatedCryptoMaterialProperties.algorithmRef").alias("ref"), c("relatedCryptoMaterialProperties.id").alias("key_id"))
    keys = by_ref(keys).groupBy("ref").agg(F.min("key_id").alias("key_id"))
    signed = rows.where(kind == "certificate").select(c("certificateProperties.signatureAlgorithmRef").alias("ref"), c("certificateProperties.subjectName").alias("cert_subject"))
    signed = by_ref(signed).groupBy("ref").agg(F.min("cert_subject").alias("cert_subject"))
    spoken = rows.where(kind == "protocol").select(F.explode(c("protocolProperties.cryptoRefArray")).alias("ref"), c("protocolProperties.version").alias("protocol_version"), F.get(c("protocolProperties.cipherSuites"), F.lit(0))["name"].alias("cipher_suite"))
    spoken = by_ref(spoken).groupBy("ref").agg(F.min("protocol_version").alias("protocol_version"), F.min("cipher_suite").alias("cipher_suite"))
    full = reduce(lambda left, right: left.join(right, "ref", "left"), [keys, signed, spoken], by_ref(own))
    none = F.lit(None).cast("string")
    libraries = rows.where("c.type = 'library'").select(F.col("c.bom-ref").alias("ref"), none.alias("algorithm"), none.cast("int").alias("key_size"), none.alias("mode"), said.alias("properties"), *[none.alias(x) for x in ("key_id", "cert_subject", "protocol_version", "cipher_suite")], F.col("c.name").alias("package"), F.col("c.version").alias("version"))
    return full.withColumns({"package": none, "version": none}).unionByName(libraries)
