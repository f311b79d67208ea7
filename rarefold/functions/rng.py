"""Portable, partition-independent random numbers.

u = first 12 hex digits of md5('seed|salt|key...') / 2**48, in [0, 1).
The same value is produced by any SQL engine with md5, so random operators
get exact oracles and never depend on partitioning (unlike ``rand(seed)``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO48 = float(2**48)


def _key(seed, salt: str, keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(str(salt))]
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        parts.append(c.cast("string"))
    return F.concat_ws("|", *parts)


def uniform(seed, salt: str, *keys) -> Column:
    """u in [0, 1) from integer/string key columns."""
    h = F.conv(F.substring(F.md5(_key(seed, salt, keys)), 1, 12), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(TWO48)


def normal(seed, salt: str, *keys) -> Column:
    """Standard normal by Box-Muller on two portable uniforms."""
    u1 = uniform(seed, salt + ":a", *keys)
    u2 = uniform(seed, salt + ":b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sql_uniform(seed, salt: str, *key_sql: str) -> str:
    """The same draw as :func:`uniform`, as a DuckDB SQL expression."""
    parts = " || '|' || ".join(f"cast({k} as varchar)" for k in key_sql)
    inner = f"'{seed}|{salt}|' || {parts}" if key_sql else f"'{seed}|{salt}'"
    return f"(('0x' || substr(md5({inner}), 1, 12))::bigint / 281474976710656.0)"


def sql_normal(seed, salt: str, *key_sql: str) -> str:
    u1 = sql_uniform(seed, salt + ":a", *key_sql)
    u2 = sql_uniform(seed, salt + ":b", *key_sql)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"
