"""Volumes as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per cent of the volume from which it is called short, and nearly gone.
WARN_PCT, CRIT_PCT = 80, 95


def short_count(n: Column) -> Column:
    """29786587 as 29.7M, 45600 as 45k; always rounded down, never below 0."""
    n = F.greatest(n.cast("long"), F.lit(0))
    tenths = F.floor(n / 100_000)
    millions = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("")), F.lit("M"))
    return F.when(n >= 1_000_000, millions).when(n >= 1_000, F.concat(F.floor(n / 1_000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def quota_level(used: Column, cap: Column) -> Column:
    """ok, warn or crit; null without a volume."""
    pct = used * 100 / F.when(cap > 0, cap)
    return F.when(pct >= CRIT_PCT, "crit").when(pct >= WARN_PCT, "warn").when(pct.isNotNull(), "ok")
