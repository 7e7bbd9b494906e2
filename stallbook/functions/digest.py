"""Content hashes, keyed hashes and canonical JSON as native columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix and the first 16 hex digits of the hash of the space-joined parts."""
    joined = F.concat_ws(" ", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 16))


def job_id(merchant: Column | str, source_file: Column | str, n_rows: Column | str) -> Column:
    return stable_id("job", merchant, source_file, n_rows)


def feed_id(merchant: Column | str) -> Column:
    return F.concat(F.lit("feed_"), F.regexp_replace(col(merchant), "^mer_", ""))


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256 for one key."""
    block = key.encode("utf-8")
    if len(block) > 64:
        block = hashlib.sha256(block).digest()
    block = block.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_sha256(c: Column | str, key: str) -> Column:
    """HMAC-SHA256 of the UTF-8 text, as hex, by two nested native hashes."""
    inner_pad, outer_pad = hmac_pads(key)
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), F.encode(col(c), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)


def canonical_mandate_json(
    mandate_id: Column, issued_at: Column, expires_at: Column, intent_text: Column,
    max_value: Column, max_currency: Column, categories: Column, max_items: Column,
    single_use: Column,
) -> Column:
    """The text a mandate is signed over: keys sorted on every level, absent keys left out."""
    constraints = F.struct(
        categories.alias("categories"),
        F.struct(max_currency.alias("currency"), max_value.alias("value")).alias("max_amount"),
        max_items.alias("max_items"),
        single_use.alias("single_use"),
    )
    return F.to_json(
        F.struct(
            constraints.alias("constraints"),
            expires_at.alias("expires_at"),
            intent_text.alias("intent_text"),
            issued_at.alias("issued_at"),
            mandate_id.alias("mandate_id"),
        )
    )
