"""Importance of an entity as Column expressions; ``today`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.vocab import PROJECT_MIN_DAYS, SCORE_WEIGHTS, TYPE_BASE


def days_since(last_seen: Column, today: dt.date) -> Column:
    """Days from ``last_seen`` to today, not below 0; 999 where unknown."""
    return F.when(last_seen.isNull(), 999).otherwise(F.greatest(F.datediff(F.lit(today), last_seen), F.lit(0)))


def freshness(days: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - days / 30)


def frequency(count: Column, days: Column) -> Column:
    """ln(1+n)/ln 8, without ceiling; fading after 30 days to three tenths."""
    base = F.log(count + 1.0) / F.log(F.lit(8.0))
    fade = F.when(days > 30, F.greatest(F.lit(0.3), 1 - (days - 30) / 90)).otherwise(F.lit(1.0))
    return F.when(count > 0, base * fade).otherwise(F.lit(0.0))


def capped(count: Column, full: int) -> Column:
    return F.least(F.lit(1.0), count / full)


def type_base(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, base in TYPE_BASE.items():
        out = F.when(kind == name, F.lit(base)).otherwise(out)
    return out


def importance(
    kind: Column, last_seen: Column, day_count: Column, today: dt.date, categories: Column | None = None,
    tags: Column | None = None, access: Column | None = None, recent_days: Column | None = None,
) -> Column:
    """The weighted sum of six factors, at least 0, not rounded. ``recent_days`` takes the
    place of ``day_count`` where it is given and not null."""
    zero = F.lit(0)
    days = days_since(last_seen, today)
    count = day_count if recent_days is None else F.coalesce(recent_days, day_count)
    parts = {
        "freshness": freshness(days),
        "frequency": frequency(F.coalesce(count, zero), days),
        "diversity": capped(F.coalesce(categories if categories is not None else zero, zero), 4),
        "richness": capped(F.coalesce(tags if tags is not None else zero, zero), 5),
        "access": capped(F.coalesce(access if access is not None else zero, zero), 5),
        "type_base": type_base(F.coalesce(kind, F.lit("fact"))),
    }
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + SCORE_WEIGHTS[name] * part
    return F.greatest(F.lit(0.0), total)


def is_provisional(kind: Column, day_count: Column, registered: Column | None = None, min_days: int = PROJECT_MIN_DAYS) -> Column:
    """The recurrence gate: a project not registered and seen on too few days."""
    known = F.lit(False) if registered is None else F.coalesce(registered, F.lit(False))
    return (kind == "project") & ~known & (F.coalesce(day_count, F.lit(0)) < min_days)
