"""Entities from mentions, and the gates and counts on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.scoring import importance, is_provisional
from daybook.vocab import PROJECT_GRACE_DAYS, PROJECT_MIN_DAYS


def rollup(mentions: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per entity id: type, first and last day, number of different days. Days are
    counted over the mentions themselves, so replayed or late files change nothing twice."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return mentions.groupBy("id", "type").agg(
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count_distinct("date").alias("day_count"), *more
    )


def recent_days(mentions: DataFrame, today: dt.date, window: int = 30) -> DataFrame:
    """Exact number of different days on which each entity was seen since ``window`` days ago."""
    recent = F.when(F.col("date") >= today - dt.timedelta(days=window), F.col("date"))
    return mentions.groupBy("id").agg(F.count_distinct(recent).alias("recent_day_count"))


def recent_days_bound(entities: DataFrame, manifest: DataFrame, today: dt.date, window: int = 30) -> DataFrame:
    """The bound used where mentions are gone: at most the days the manifest has since the
    cutoff, if the entity's time overlaps them, and at most its own days."""
    cutoff = today - dt.timedelta(days=window)
    days = manifest.filter(F.col("date") >= cutoff).agg(F.count_distinct("date").alias("__days"))
    overlap = (F.col("last_seen") >= cutoff) & (F.col("first_seen") <= today)
    bound = F.when(overlap, F.least("day_count", "__days")).otherwise(0).cast("bigint")
    return entities.crossJoin(F.broadcast(days)).withColumn("recent_day_count", bound).drop("__days")


def scored(entities: DataFrame, today: dt.date, access: DataFrame | None = None) -> DataFrame:
    """``entities`` with ``score``. Columns tags, distinct_categories and recent_day_count
    count where they exist; ``access`` has (entity_id, access_count)."""
    have = set(entities.columns)
    if access is not None:
        entities = entities.join(access.withColumnRenamed("entity_id", "id"), "id", "left")
    return entities.withColumn(
        "score",
        importance(
            F.col("type"), F.col("last_seen"), F.col("day_count"), today,
            categories=F.col("distinct_categories") if "distinct_categories" in have else None,
            tags=F.size(F.coalesce("tags", F.array().cast("array<string>"))) if "tags" in have else None,
            access=F.col("access_count") if access is not None else None,
            recent_days=F.col("recent_day_count") if "recent_day_count" in have else None,
        ),
    )


def access_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("entity_id").agg(F.count(F.lit(1)).alias("access_count"))


def registered(entities: DataFrame, slugs: DataFrame | None) -> DataFrame:
    """Adds ``registered``: the id is one of ``slugs`` (id). The registry is a hand-written
    file; its join is left to the optimizer."""
    if slugs is None:
        return entities.withColumn("registered", F.lit(False))
    known = slugs.select("id").distinct().withColumn("registered", F.lit(True))
    return entities.join(known, "id", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def gate(entities: DataFrame, slugs: DataFrame | None = None, min_days: int = PROJECT_MIN_DAYS) -> DataFrame:
    """Without provisional projects."""
    out = registered(entities, slugs)
    return out.filter(~is_provisional(F.col("type"), F.col("day_count"), F.col("registered"), min_days)).drop("registered")


def stale_provisional(
    entities: DataFrame, today: dt.date, slugs: DataFrame | None = None, min_days: int = PROJECT_MIN_DAYS, grace: int = PROJECT_GRACE_DAYS
) -> DataFrame:
    """Provisional projects last seen before the grace period."""
    out = registered(entities, slugs)
    old = F.col("last_seen") < today - dt.timedelta(days=grace)
    return out.filter(is_provisional(F.col("type"), F.col("day_count"), F.col("registered"), min_days) & old).drop("registered")


def active(entities: DataFrame, today: dt.date, lookback: int = 14) -> DataFrame:
    """Seen within ``lookback`` days, with a status: active from three days on, else recent."""
    status = F.when(F.col("day_count") >= 3, "active").otherwise("recent")
    return entities.filter(F.col("last_seen") >= today - dt.timedelta(days=lookback)).withColumn("status", status)
