"""Deterministic noise: the same seed and key give the same draw on every run and layout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: int | None, *key: Column | str) -> Column:
    """Uniform double in [0, 1) from md5(seed:key...). ``rand(seed)`` would depend on partitioning."""
    parts = [F.lit(str(seed or 0))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def signed(seed: int | None, *key: Column | str) -> Column:
    """Uniform double in [-1, 1)."""
    return uniform(seed, *key) * 2.0 - 1.0
