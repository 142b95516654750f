"""Maintenance: what is noise, what goes, and scoring anew."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook import vocab
from daybook.operators import rollup
from daybook.sources.scratch import kept
from daybook.sources.store import Store, cascade_delete


def noisy(entities: DataFrame, today: dt.date, slugs: DataFrame | None = None) -> DataFrame:
    """(id, reason): facts that are log lines, common and structural tech terms, stale
    provisional projects. An id can have several reasons."""
    name = F.col("name")
    ops = name.rlike(vocab.OPS_KEYWORDS) & (F.length("name") < 120)
    facts = entities.filter((F.col("type") == "fact") & (name.rlike(vocab.CLOCK_UTC) | name.rlike(vocab.CLOCK_BRACKET) | ops))
    tech = entities.filter("type = 'tech'")
    parts = (
        (facts, "noisy_fact"),
        (tech.filter(F.upper("name").isin(*vocab.TECH_COMMON)), "common_tech"),
        (tech.filter(name.rlike(vocab.TECH_STRUCTURAL)), "structural_tech"),
        (rollup.stale_provisional(entities, today, slugs), "stale_provisional"),
    )
    out = None
    for df, reason in parts:
        got = df.select("id", F.lit(reason).alias("reason"))
        out = got if out is None else out.unionAll(got)
    return out.distinct()


def without_weak(relations: DataFrame) -> DataFrame:
    weak = (F.col("rel_type") == "RELATES_TO") & F.coalesce(F.col("evidence").isin(*vocab.WEAK_EVIDENCES), F.lit(False))
    return relations.filter(~weak)


def rescored(entities: DataFrame, log: DataFrame, today: dt.date, digits: int = 4) -> DataFrame:
    out = rollup.scored(entities, today, rollup.access_counts(log))
    return out.withColumn("importance", F.round("score", digits)).select(entities.columns)


def sizes(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}


def prune_and_rescore(
    tables: dict[str, DataFrame], today: dt.date, slugs: DataFrame | None = None, dry_run: bool = False, prune_only: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after, (id, reason) of what went or, in a dry run, would go)."""
    gone = noisy(tables["entities"], today, slugs)
    if dry_run:
        return tables, gone
    out = cascade_delete(tables, gone)
    out["relations"] = without_weak(out["relations"])
    if not prune_only:
        out["entities"] = rescored(out["entities"], out["access_log"], today)
    return out, gone


def maintain(store: Store, today: dt.date, slugs: DataFrame | None = None, dry_run: bool = False, prune_only: bool = False) -> dict:
    """Prunes and rescores a store: sizes before and after, how many ids went (or would go) by
    reason, and how many edges. A dry run writes nothing."""
    names = ("entities", "relations", "vectors", "access_log")
    tables = {n: store.read(n) for n in names}
    after, gone = prune_and_rescore(tables, today, slugs, dry_run, prune_only)
    gone = kept(gone)
    report = {"before": sizes(tables), "reasons": {r.reason: r["count"] for r in gone.groupBy("reason").count().collect()}}
    report["ids"] = gone.select("id").distinct().count()
    if not dry_run:
        out = {n: kept(after[n]) for n in names if n != "access_log"}
        for n, df in out.items():
            store.write(n, df)
        links = without_weak(store.read("links"))
        for end in ("from_entity", "to_entity"):
            links = links.join(gone.select(F.col("id").alias(end)).distinct(), end, "left_anti")
        store.write("links", kept(links))
        # Entities are made from mentions: what went must not come back with the next run.
        store.write("mentions", kept(store.read("mentions").join(gone.select("id").distinct(), "id", "left_anti")))
    return report | {"after": sizes({n: store.read(n) for n in names}), "dry_run": dry_run}
