"""Canonical JSON, content hashes and hash-derived orders."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """Sorted keys, tight separators, no NaN (driver side)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_hash(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_json(fields: dict[str, Column]) -> Column:
    """The same for columns that hold no doubles: fields in order of name, nulls written out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def row_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def short(c: Column, n: int = 12) -> Column:
    return F.substring(c, 1, n)


def hash_order(seed: int, salt: str, *ids: Column) -> Column:
    """A seeded order that no partitioning changes: md5 of ``seed:salt:ids``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *(i.cast("string") for i in ids)).cast("binary"))


def git_blob_sha1(content: Column) -> Column:
    """The blob id that git gives to a binary column."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))
