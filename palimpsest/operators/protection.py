"""Column protection: sealed values, key rotation, blind token index.

A sealed value is ``enc:<key id>:<base64>`` of AES-256-GCM with the table and column as associated data."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def _aad(table: str, column: str) -> Column:
    return F.lit(f"{table}:{column}".encode())


def seal(value: Column, table: str, column: str, key_id: str, key: bytes) -> Column:
    sealed = F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _aad(table, column))
    return F.when(value.isNull(), None).otherwise(F.concat(F.lit(f"enc:{key_id}:"), F.base64(sealed)))


def open_(value: Column, table: str, column: str, keys: dict[str, bytes]) -> Column:
    """The text; null where no key opens it, never the sealed value. Plain values stay."""
    out = F.when(~value.startswith("enc:"), value)
    for key_id, key in keys.items():
        body = F.unbase64(F.substring(value, len(key_id) + 6, 1 << 30))
        plain = F.decode(F.try_aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _aad(table, column)), "UTF-8")
        out = out.when(value.startswith(f"enc:{key_id}:"), plain)
    return out


def rotate(df: DataFrame, table: str, columns: list[str], keys: dict[str, bytes], current: str) -> DataFrame:
    """All values under the current key. Fails before anything is returned if some value can't be opened."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & open_(F.col(c), table, c, keys).isNull()).alias(c) for c in columns]).first()
    if any(bad[c] for c in columns):
        raise ValueError(f"values that no key opens: { {c: bad[c] for c in columns if bad[c]} }")
    fresh = lambda c: F.col(c).startswith(f"enc:{current}:")
    return df.withColumns({c: F.when(fresh(c) | F.col(c).isNull(), F.col(c)).otherwise(seal(open_(F.col(c), table, c, keys), table, c, current, keys[current])) for c in columns})


def key_usage(df: DataFrame, column: str) -> DataFrame:
    kind = F.when(F.col(column).isNull(), "null").when(F.col(column).startswith("enc:"), F.split(column, ":")[1]).otherwise("plain")
    return df.groupBy(kind.alias("key_id")).agg(F.count(F.lit(1)).alias("n"))


def sub_key(master: bytes, table: str, column: str) -> bytes:
    return hmac.new(master, f"{table}:{column}".encode(), hashlib.sha256).digest()


def blind(tokens: Column, key: bytes) -> Column:
    """Each token as the first 16 hex characters of its keyed hash: equal tokens stay equal, so ranks don't change."""
    return F.transform(tokens, lambda x: F.substring(t.hmac_sha256(x, key), 1, 16))


def sealed_like(value: Column, pattern: str, table: str, column: str, keys: dict[str, bytes]) -> Column:
    """LIKE over sealed text, where case is folded for ASCII letters alone."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(open_(value, table, column, keys), upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def sealed_length(value: Column, table: str, column: str, keys: dict[str, bytes]) -> Column:
    return F.length(open_(value, table, column, keys))
