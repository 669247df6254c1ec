"""Seeded row keys.

Every random choice in the library (samples, splits, bags, shuffles) is a
function of ``md5("<seed>:<salt>:...:<id>")`` so that it does not depend on
how the table is partitioned, on the number of executors, or on retries.
The same key is a one-liner in any SQL engine with ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(id_col, seed, *salts) -> Column:
    """Hex md5 of ``seed:salt1:...:id``; salts may be literals or columns."""
    parts = [F.lit(str(seed))]
    for s in salts:
        parts.append(F.lit(":"))
        parts.append(s.cast("string") if isinstance(s, Column) else F.lit(str(s)))
    parts.append(F.lit(":"))
    parts.append(_as_col(id_col).cast("string"))
    return F.md5(F.concat(*parts))


def draw_key(id_col, seed, purpose: str, salt: str = "") -> Column:
    """Key of one kind of draw: ``md5(seed:purpose[:salt]:id)``.

    Every operator that draws has a purpose of its own (``sample``, ``limit``,
    ``init``, ``split``, ``shuffle``, ``bag``), so its choice is independent of
    what the others chose with the same seed; a caller that repeats a draw
    passes a ``salt`` per repetition.
    """
    return seeded_key(id_col, seed, *([purpose, salt] if salt else [purpose]))


def key_threshold(fraction: float) -> str | None:
    """Hex threshold (64 bits) for keeping ``fraction`` of rows; None means keep all."""
    if fraction >= 1.0:
        return None
    return format(max(int(fraction * 2 ** 64), 0), "016x")


def key_below(key: Column, fraction: float) -> Column:
    """True for about ``fraction`` of keys: compares the first 64 bits."""
    thr = key_threshold(fraction)
    if thr is None:
        return F.lit(True)
    return F.substring(key, 1, 16) < F.lit(thr)


def key_uniform(key: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)
