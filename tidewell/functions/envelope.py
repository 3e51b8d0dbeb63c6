"""Field-level encryption envelopes on Spark's own AES functions."""

from __future__ import annotations

import base64
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.coerce import is_blank, is_empty

# Envelope layout.
ALGORITHM = "AES-256-GCM"
_NONCE, _TAG = 12, 16
_FIELDS = "alg STRING, key_id STRING, nonce STRING, ciphertext STRING, tag STRING"


@dataclass(frozen=True)
class FieldKey:
    """One 256-bit key.  There is no default key and no padding."""

    key_id: str
    secret: bytes

    def __post_init__(self) -> None:
        if len(self.secret) != 32:
            raise ValueError("a field key must be exactly 32 bytes")

    def __repr__(self) -> str:
        return f"FieldKey({self.key_id!r})"

    @classmethod
    def from_base64(cls, key_id: str, encoded: str) -> FieldKey:
        return cls(key_id, base64.b64decode(encoded, validate=True))

    @classmethod
    def from_env(
        cls, name: str = "TIDEWELL_FIELD_KEY_B64", id_name: str = "TIDEWELL_FIELD_KEY_ID"
    ) -> FieldKey:
        """Read the key from the environment; refuse to run without one."""
        encoded = os.environ.get(name, "").strip()
        if not encoded:
            raise ValueError(f"no field key: set {name} to 32 bytes in base64")
        return cls.from_base64(os.environ.get(id_name, "").strip() or "default", encoded)


def _b64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), r"[\r\n]", "")


def encrypt(c: Column, key: FieldKey) -> Column:
    """Text to envelope JSON; null and '' become ''."""
    sealed = F.aes_encrypt(c.cast("binary"), F.lit(key.secret), F.lit("GCM"))

    def fold(b: Column) -> Column:
        # b is bound once, so nonce, ciphertext and tag always come from one draw
        return F.to_json(
            F.struct(
                F.lit(ALGORITHM).alias("alg"),
                F.lit(key.key_id).alias("key_id"),
                _b64(F.substring(b, 1, _NONCE)).alias("nonce"),
                _b64(b.substr(F.lit(_NONCE + 1), F.length(b) - (_NONCE + _TAG))).alias("ciphertext"),
                _b64(b.substr(F.length(b) - (_TAG - 1), F.lit(_TAG))).alias("tag"),
            )
        )

    return F.when(is_empty(c), F.lit("")).otherwise(F.transform(F.array(sealed), fold)[0])


def decrypt(c: Column, keys: Mapping[str, FieldKey]) -> Column:
    """Envelope JSON to text by key id; '' for null or ''; null if it cannot be opened."""
    parts = F.from_json(c, _FIELDS)
    sealed = F.concat(
        F.try_to_binary(parts["nonce"], F.lit("base64")),
        F.try_to_binary(parts["ciphertext"], F.lit("base64")),
        F.try_to_binary(parts["tag"], F.lit("base64")),
    )
    opened = F.lit(None).cast("binary")
    for key in keys.values():
        opened = F.when(
            parts["key_id"] == key.key_id,
            F.try_aes_decrypt(sealed, F.lit(key.secret), F.lit("GCM")),
        ).otherwise(opened)
    return F.when(is_empty(c), F.lit("")).otherwise(opened.cast("string"))


def protected(c: Column, key: FieldKey) -> Column:
    """C3 for one field: blank becomes null, otherwise the envelope."""
    return F.when(~is_blank(c), encrypt(c, key))


def encrypt_fields(df: DataFrame, fields: tuple[str, ...], key: FieldKey) -> DataFrame:
    """Each field is replaced in place by ``<field>_enc``; clear text is dropped."""
    return df.select(
        *(
            protected(F.col(n).cast("string"), key).alias(f"{n}_enc") if n in fields else F.col(n)
            for n in df.columns
        )
    )


def decrypt_fields(
    df: DataFrame, fields: tuple[str, ...], keys: Mapping[str, FieldKey]
) -> DataFrame:
    """C4: add the clear text beside ``<field>_enc``; what cannot be opened stays null."""
    opened = {}
    for n in fields:
        if f"{n}_enc" in df.columns:
            sealed = F.col(f"{n}_enc")
            clear = F.when(~is_empty(sealed), decrypt(sealed, keys))
            opened[n] = F.coalesce(clear, F.col(n)) if n in df.columns else clear
    return df.withColumns(opened)
