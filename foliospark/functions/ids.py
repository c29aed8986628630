"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS name space of version-5 UUIDs.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def chunk_key(text: Column) -> Column:
    """First 16 hex digits of the MD5 as a number, modulo 2^63: a long that is never negative."""
    wide = F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")
    return (wide % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def positional_chunk_key(filename: Column, index: Column, content: Column) -> Column:
    """Key of a chunk without an id of its own: file, running index and content."""
    return chunk_key(F.concat_ws("-", filename, index.cast("string"), content))


def collection_name(prefix: Column, name: Column) -> Column:
    return F.concat_ws("_", prefix, F.md5(name))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def _uuid_from(digest: Column) -> Column:
    """First 32 of 40 hex digits with version 5 and the variant bits set."""
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    pick = F.element_at(F.array(*map(F.lit, "89ab")), nibble % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(pick, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def name_uuid(namespace_hex: Column, name: Column) -> Column:
    """Version-5 UUID of a name in a name space given as 32 hex digits."""
    return _uuid_from(F.sha1(F.concat(F.unhex(namespace_hex), F.encode(name, "UTF-8"))))


def image_uuid(collection: Column, name: Column) -> Column:
    """Name of an exported image: a UUID of its name in the UUID of its collection."""
    outer = name_uuid(F.lit(DNS_NAMESPACE), collection)
    return name_uuid(F.regexp_replace(outer, "-", ""), name)
