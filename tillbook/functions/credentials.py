"""Credential rules and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.functions.text import base64_text, decoded_base64, url_encode_lower, utf16_length

HASHES = ("sha1", "sha256")


def policy_errors(secret: Column, min_length: int = 7, min_symbols: int = 1, strength: str = "") -> Column:
    """Array of the broken rules of a new secret, empty when acceptable."""
    symbols = utf16_length(F.regexp_replace(secret, r"[\p{L}\p{Nd}]", ""))
    checks = [
        F.when(secret.isNull(), F.lit("missing")),
        F.when(utf16_length(secret) < min_length, F.lit("too short")),
        F.when(symbols < min_symbols, F.lit("too few symbols")),
    ]
    if strength:
        checks.append(F.when(~secret.rlike(strength), F.lit("too weak")))
    return F.array_compact(F.array(*checks))


def policy_error(secret: Column, min_length: int = 7, min_symbols: int = 1, strength: str = "") -> Column:
    return F.get(policy_errors(secret, min_length, min_symbols, strength), F.lit(0))


def contains_name(secret: Column, name: Column) -> Column:
    """The secret holds the user name as plain text, in any case."""
    return F.contains(F.lower(secret), F.lower(name))


def hash_bytes(data: Column, algorithm: str) -> Column:
    if algorithm not in HASHES:
        raise ValueError(f"unknown hash {algorithm!r}; use one of {HASHES}")
    return F.unhex(F.sha1(data) if algorithm == "sha1" else F.sha2(data, 256))


def text_digest(text: Column, algorithm: str) -> Column:
    """Base64 of the hash of the UTF-8 bytes."""
    return F.base64(hash_bytes(F.encode(text, "UTF-8"), algorithm))


def salted_digest(secret: Column, salt: Column, algorithm: str = "sha256") -> Column:
    """Base64 of the hash of salt bytes followed by UTF-16LE bytes.

    An empty or NULL secret is returned as it is.
    """
    digest = F.base64(hash_bytes(F.concat(F.unbase64(salt), F.encode(secret, "UTF-16LE")), algorithm))
    return F.when(secret == "", secret).otherwise(digest)


def reversible_base64(stored: Column) -> Column:
    """The stored text may be base64 of UTF-8: it decodes and encodes back."""
    return F.coalesce(base64_text(decoded_base64(stored)) == stored, F.lit(False))


PROTECTIONS = ("base64", "url", "sha1", "sha256", "aes")


def protect(text: Column, how: str, key: Column | None = None) -> Column:
    """One column under one of the protections; ``aes`` needs the caller's key."""
    if how == "base64":
        return base64_text(text)
    if how == "url":
        return url_encode_lower(text)
    if how in HASHES:
        return text_digest(text, how)
    if how == "aes":
        if key is None:
            raise ValueError("aes needs a key")
        return F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), key, F.lit("CBC"), F.lit("PKCS")))
    raise ValueError(f"unknown protection {how!r}; use one of {PROTECTIONS}")


def reveal_aes(protected: Column, key: Column) -> Column:
    plain = F.aes_decrypt(F.unbase64(protected), key, F.lit("CBC"), F.lit("PKCS"))
    return plain.cast("string")
