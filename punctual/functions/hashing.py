"""Reproducible pseudo-random columns derived from row keys.

Every draw is a pure function of (salt, key), so results do not depend on
partitioning, task retries or executor loss, and the same numbers can be
produced by any SQL engine that has ``md5``.  13 hex digits give a 52-bit
integer that a double holds exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.functions.common import ColumnOrName, to_col

_HEX_DIGITS = 13
_SCALE = float(2**52)


def hash_bits(key: ColumnOrName, salt: str) -> Column:
    """52-bit non-negative integer drawn from md5(salt|key)."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), to_col(key).cast("string")))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(key: ColumnOrName, salt: str) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_bits(key, salt) / F.lit(_SCALE)


def hash_mod(key: ColumnOrName, salt: str, n: ColumnOrName) -> Column:
    """Integer in [0, n) chosen by hash; ``n`` may be a column."""
    return F.pmod(hash_bits(key, salt), to_col(n).cast("bigint"))


def normal(key: ColumnOrName, salt: str, mean: float = 0.0, std: float = 1.0) -> Column:
    """Gaussian draw by the Box-Muller transform of two independent uniforms."""
    u1 = F.lit(1.0) - uniform(key, salt + "#u1")  # (0, 1]: log is finite
    u2 = uniform(key, salt + "#u2")
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(std)) * z


# --- SQL twins (DuckDB dialect) used by the oracle queries -------------------

def sql_hash_bits(key_sql: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5('{salt}|' || CAST({key_sql} AS VARCHAR)), 1, {_HEX_DIGITS})) AS BIGINT)"


def sql_uniform(key_sql: str, salt: str) -> str:
    return f"({sql_hash_bits(key_sql, salt)} / CAST({_SCALE!r} AS DOUBLE))"


def sql_hash_mod(key_sql: str, salt: str, n_sql: str) -> str:
    return f"({sql_hash_bits(key_sql, salt)} % CAST({n_sql} AS BIGINT))"


def sql_normal(key_sql: str, salt: str, mean: float = 0.0, std: float = 1.0) -> str:
    u1 = f"(CAST(1.0 AS DOUBLE) - {sql_uniform(key_sql, salt + '#u1')})"
    u2 = sql_uniform(key_sql, salt + "#u2")
    return (f"(CAST({float(mean)!r} AS DOUBLE) + CAST({float(std)!r} AS DOUBLE) * "
            f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({u1})) * cos(CAST({2.0 * math.pi!r} AS DOUBLE) * {u2})))")
