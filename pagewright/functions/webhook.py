"""Signed webhook events: signature check and event schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import fixed_values as fv

EVENT_SCHEMA = "event_name string, sender struct<id:string>, message struct<text:string>"
_BLOCK = 64


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text or binary column, from nested ``sha2`` calls."""
    import hashlib

    key = secret.encode("utf-8")
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def signature_ok(body: Column, signature: Column, secret: str) -> Column:
    """False for a missing, empty or wrong signature."""
    return F.coalesce((signature != "") & (hmac_sha256(body, secret) == signature), F.lit(False))


def parse_event(body: Column) -> Column:
    """The event struct; NULL when the payload is not a valid event."""
    event = F.from_json(body.cast("string"), EVENT_SCHEMA)
    return F.when(event["event_name"].isNotNull() & (event["sender"]["id"] != ""), event)


def is_text_message(event: Column) -> Column:
    return F.coalesce(
        (event["event_name"] == fv.TEXT_MESSAGE_EVENT) & (event["message"]["text"] != ""),
        F.lit(False),
    )
