"""Stable identities: digests of canonical JSON, ranks and buckets taken from them.

Everything that looks random is the SHA-256 of a value's JSON text (keys sorted, ", " and ": " between parts, no
escaping beyond JSON's own), so results repeat on any cluster and in any order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column | str) -> Column:
    """A string as JSON text with its quotes; null gives `null`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))


def json_list(*items: Column) -> Column:
    """JSON text of a list of strings."""
    return F.concat(F.lit("["), F.concat_ws(", ", *map(json_string, items)), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """JSON text of an object with string members, keys in order."""
    parts = [F.concat(F.lit(f'"{k}": '), json_string(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def digest(json: Column) -> Column:
    """Hex SHA-256 of JSON text made by the functions above."""
    return F.sha2(json, 256)


def digest_string(c: Column | str) -> Column:
    return digest(json_string(c))


def digest_list(*items: Column) -> Column:
    return digest(json_list(*items))


def hash_number(hex_digest: Column) -> Column:
    """The first 32 bits of a digest as a long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def hash_bucket(hex_digest: Column, n: int) -> Column:
    """A bucket below `n`, the same for equal digests."""
    return hash_number(hex_digest) % n
