"""Content hashes and the three-valued verdict on two items' content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes of the payload that the short hash covers.
PREFIX = 64 * 1024


def bytes_hash(content: Column) -> Column:
    """Proof-grade hash of all bytes."""
    return F.sha2(content, 256)


def prefix_hash(content: Column, n: int = PREFIX) -> Column:
    """Nominating hash of the first n bytes (or characters of text)."""
    return F.md5(F.substring(content, 1, n))


def shallow_hash(payload: Column, content: Column, n: int = PREFIX) -> Column:
    """Hash of the payload's head, or of all bytes where there is no payload."""
    return F.when(payload.isNotNull(), prefix_hash(payload, n)).otherwise(F.md5(content))


def content_hash(payload: Column) -> Column:
    """Proof-grade hash of a whole payload; null without one."""
    return F.sha2(payload, 256)


def decoded(payload: Column) -> Column:
    return payload.isNotNull()


def strategy_hash(strategy: str, content: Column, payload: Column) -> Column:
    """`exact`: all bytes; `image_data`: the payload, or all bytes without one."""
    if strategy == "exact":
        return bytes_hash(content)
    return F.coalesce(content_hash(payload), bytes_hash(content))


def verdict(a, b) -> Column:  # noqa: ANN001
    """same, different or unknown: by bytes, then whole payloads (final for videos), then pixels. a, b: columns by name."""
    same = a("bytes_hash") == b("bytes_hash")
    blind = a("payload_hash").isNull() | b("payload_hash").isNull()
    payload = a("payload_hash") == b("payload_hash")
    no_pixels = a("pixel_hash").isNull() | b("pixel_hash").isNull()
    return (
        F.when(F.coalesce(same, F.lit(False)), "same").when(blind, "unknown").when(payload, "same").when(a("video") | b("video"), "different")
        .when(no_pixels, "unknown").when(a("pixel_hash") == b("pixel_hash"), "same").otherwise("different")
    )


def reason(a, b) -> Column:  # noqa: ANN001
    """Why a pair is not the same; null if it is."""
    v = verdict(a, b)
    return F.when(v == "unknown", "no proof: one of them has no readable content").when(v == "different", F.when(a("video") | b("video"), "not one film: other film data").otherwise("not one picture: other pixels"))
