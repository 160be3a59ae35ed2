"""Reproducible random numbers as columns: any engine with md5 gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *parts: Column | str) -> Column:
    """Within [0, 1), from the md5 of the seed and the parts."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def normal(seed: int | str, *parts: Column | str) -> Column:
    """Standard normal, by the polar form of two uniforms."""
    u, v = uniform(f"{seed}a", *parts), uniform(f"{seed}b", *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def sql_uniform(seed: int | str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0::double)"


def sql_normal(seed: int | str, *parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {sql_uniform(f'{seed}a', *parts)})) * cos(2 * pi() * {sql_uniform(f'{seed}b', *parts)}))"
