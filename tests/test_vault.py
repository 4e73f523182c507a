import json

from quantalog.sources import vault

PKCS11 = {"slots": [{"slot_id": 1, "token_label": "Tok A", "pqc_ready": False, "objects": [
    {"CKA_LABEL": "Firmware Key", "CKA_KEY_TYPE": "CKK_RSA", "CKA_MODULUS_BITS": 2048, "CKA_SIGN": True, "CKA_END_DATE": "2030-01-01", "CKA_VALUE": "never read"},
    {"CKA_LABEL": "pin-verify", "CKA_KEY_TYPE": "CKK_DES3", "CKA_VALUE_LEN": 24}, {"CKA_LABEL": "ec", "CKA_KEY_TYPE": "CKK_EC", "CKA_EC_CURVE_NAME": "secp256r1", "CKA_SIGN": True}]}, {"objects": []}]}
KMIP = {"endpoint": "kmip://h:5696", "objects": [{"Unique Identifier": "U1", "Name": "TDE master", "Cryptographic Algorithm": "AES", "Cryptographic Length": 256, "Cryptographic Usage Mask": ["Encrypt", "Decrypt"], "State": "Deactivated"}]}
CLOUD = {
    "aws_kms": {"keys": [{"KeyId": "12345678-aa", "Arn": "arn:aws:kms:x:1:key/1", "KeySpec": "RSA_2048", "KeyUsage": "SIGN_VERIFY"}]},
    "azure_key_vault": {"keys": [{"kid": "https://v/keys/k/1", "kty": "EC", "crv": "P-256", "key_ops": ["sign", "verify"]}], "certificates": [{"id": "https://v/certificates/c/7", "policy": {"key_props": {"kty": "EC-HSM", "crv": "P-384"}}}]},
    "gcp_kms": {"crypto_key_versions": [{"name": "p/l/cryptoKeys/kk/cryptoKeyVersions/3", "algorithm": "GOOGLE_SYMMETRIC_ENCRYPTION"}]},
    "aws_acm": {"certificates": [{"Certificate": {"CertificateArn": "arn:aws:acm:x:1:certificate/abcdef0123456789", "KeyAlgorithm": "EC_secp384r1", "NotAfter": "2027-01-01"}}]},
}
STORES = {"stores": [{"path": "/etc/a.jks", "entries": [{"alias": "root", "subject_dn": "CN=Own Root CA", "key_algorithm": "RSA", "key_size": 4096}, {"alias": "web", "subject_dn": "CN=web"}]}]}
CHAIN = {"certificates": [{"subject": "CN=Root,O=x", "sha256_fingerprint": "AA:BB:CC:DD:EE:FF:00:11", "public_key_algorithm": "RSA", "public_key_size": 2048, "basic_constraints_ca": True, "self_signed": True}]}
DOCUMENTS = {"v/pkcs11.json": PKCS11, "v/kmip.json": KMIP, "v/cloud_kms.json": CLOUD, "v/keystores.json": STORES, "v/certificates.json": CHAIN}


def documents(spark, found):
    return spark.createDataFrame([(p, d if isinstance(d, str) or d is None else json.dumps(d)) for p, d in found.items()], "path string, text string")


def test_all_exports(spark):
    got = {r.id: r for r in vault.findings(documents(spark, DOCUMENTS)).collect()}
    assert {i: (r.asset_class, r.algorithm, r.key_size) for i, r in got.items()} == {
        "vault-hsm-tok-a-firmware-key": ("firmware_signing", "RSA", 2048),
        "vault-hsm-tok-a-pin-verify": ("payment_hsm", "3DES", 192),
        "vault-hsm-tok-a-ec": ("code_signing", "ECDSA", 256),
        "vault-kmip-u1": ("backup_encryption", "AES", 256),
        "vault-aws-12345678": ("token_signing", "RSA", 2048),
        "vault-azure-1": ("token_signing", "ECDSA", 256),
        "vault-gcp-kk-3": ("generic_key", "AES", 256),
        "vault-acm-abcdef012345": ("tls_certificate", "ECDSA", 384),
        "vault-azcert-c": ("tls_certificate", "ECDSA", 384),
        "vault-ks--etc-a-jks-root": ("root_ca", "RSA", 4096),
        "vault-ks--etc-a-jks-web": ("tls_certificate", None, None),
        "vault-cert-aabbccddeeff": ("root_ca", "RSA", 2048),
    }
    assert got["vault-hsm-tok-a-ec"].blocked and got["vault-kmip-u1"].state == "Deactivated" and got["vault-azure-1"].usage == "sign,verify"
    assert "never read" not in str(got)


def test_one_bad_source_loses_no_other(spark):
    some = documents(spark, DOCUMENTS | {"v/kmip.json": "{not json", "v/cloud_kms.json": None})
    assert {r.source for r in vault.findings(some).collect()} == {"vault_pkcs11", "vault_keystore", "vault_certificate"}
    assert {(r.name, r.reason) for r in vault.gaps(some).collect()} == {("kmip.json", "unreadable"), ("cloud_kms.json", "unreadable")}
    few = documents(spark, {"v/pkcs11.json": PKCS11, "v/manifest.json": {"sources": [{"file": "pkcs11.json"}, {"file": "kmip.json"}]}})
    assert [(r.name, r.reason) for r in vault.gaps(few).collect()] == [("kmip.json", "missing")]
    assert len(vault.gaps(documents(spark, {})).collect()) == 5 and vault.findings(documents(spark, {})).count() == 0
