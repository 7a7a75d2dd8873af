"""Deterministic pseudo-random draws that depend only on row keys.

A draw is a function of its text, so the same row gets the same draw under any
partitioning, after a lost executor, and in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash32(*parts) -> Column:
    """First eight hex digits of md5 over the parts joined by ':', as a long."""
    digest = F.md5(F.concat_ws(":", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def unit_draw(*parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(*parts) / F.lit(float(HASH_RANGE))


def key_hash(seed, key: list[str]) -> Column:
    return hash32(seed, *[F.col(c) for c in key])


def fast_unit(*parts) -> Column:
    """Cheaper uniform draw for inner loops that no other engine has to repeat."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
