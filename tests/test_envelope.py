"""C1-C5, P16."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions.envelope import FieldKey, decrypt, decrypt_fields, encrypt, encrypt_fields


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_c1_layout(spark, key):
    long = "가나다" * 200
    rows = texts(spark, ["abc", long, "", None]).select("i", encrypt(F.col("t"), key).alias("e")).orderBy("i").collect()
    assert [r.e for r in rows[2:]] == ["", ""]
    for r, clear in zip(rows, ["abc", long]):
        body = json.loads(r.e)
        assert list(body) == ["alg", "key_id", "nonce", "ciphertext", "tag"]
        assert r.e == json.dumps(body, separators=(",", ":"))
        assert (body["alg"], body["key_id"]) == ("AES-256-GCM", "k1")
        sizes = [len(base64.b64decode(body[n])) for n in ("nonce", "ciphertext", "tag")]
        assert sizes == [12, len(clear.encode()), 16]


def test_c1_c2_round_trip_and_fresh_nonces(spark, key):
    df = texts(spark, [" same "] * 200).select(encrypt(F.col("t"), key).alias("e"))
    rows = df.withColumn("d", decrypt(F.col("e"), {"k1": key})).collect()
    assert {r.d for r in rows} == {" same "}
    nonces = {json.loads(r.e)["nonce"] for r in rows}
    assert len(nonces) == 200


def test_c2_d7_key_choice_and_failures(spark, key):
    other = FieldKey("k2", bytes(32))
    sealed = texts(spark, ["x"]).select(encrypt(F.col("t"), key).alias("e"))
    cases = sealed.select(
        decrypt(F.col("e"), {"k1": key, "k2": other}).alias("both"),
        decrypt(F.col("e"), {"k2": other}).alias("unknown"),
        decrypt(F.col("e"), {"k1": FieldKey("k1", bytes(32))}).alias("wrong"),
        decrypt(F.replace("e", F.lit('"tag":"'), F.lit('"tag":"!!')), {"k1": key}).alias("broken"),
        decrypt(F.lit("no json"), {"k1": key}).alias("text"),
        decrypt(F.lit(""), {"k1": key}).alias("empty"),
    ).collect()[0]
    assert tuple(cases) == ("x", None, None, None, None, "")


def test_c3_c4_p16_fields(spark, key):
    df = spark.createDataFrame([(1, "a@x", "  ", None), (2, "", " b ", "c")], "i int, sender string, cc string, title string")
    sealed = encrypt_fields(df, ("sender", "cc"), key)
    assert sealed.columns == ["i", "sender_enc", "cc_enc", "title"]
    one, two = decrypt_fields(sealed, ("sender", "cc"), {"k1": key}).orderBy("i").collect()
    assert (one.sender, one.cc, one.cc_enc, two.sender, two.sender_enc, two.cc) == ("a@x", None, None, None, None, " b ")
    kept = decrypt_fields(sealed.withColumn("sender", F.lit("old")), ("sender",), {})
    assert {r.sender for r in kept.collect()} == {"old"}


def test_c5_d8_keys(monkeypatch):
    monkeypatch.delenv("TIDEWELL_FIELD_KEY_B64", raising=False)
    with pytest.raises(ValueError):
        FieldKey.from_env()
    monkeypatch.setenv("TIDEWELL_FIELD_KEY_B64", base64.b64encode(b"short").decode())
    with pytest.raises(ValueError):
        FieldKey.from_env()
    monkeypatch.setenv("TIDEWELL_FIELD_KEY_B64", base64.b64encode(bytes(32)).decode())
    monkeypatch.setenv("TIDEWELL_FIELD_KEY_ID", "prod-1")
    assert FieldKey.from_env() == FieldKey("prod-1", bytes(32))
    assert "\\x00" not in repr(FieldKey.from_env())
