"""Ingestion: from changed files to the store's next version, in one plan per table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.operators import extract, link, rollup, search
from daybook.sources import embeddings
from daybook.sources.notes import parse_checked, read_files
from daybook.sources.scratch import kept
from daybook.sources.store import TABLES, Store, put_relations, upsert


@dataclass
class Result:
    """Counters of a run; ``status`` is ok, partial or error."""

    processed: int = 0
    skipped: int = 0
    failed: int = 0
    created: int = 0
    updated: int = 0
    entities: int = 0
    relations: int = 0
    status: str = "ok"
    errors: list[str] = field(default_factory=list)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose bytes the manifest does not know. Files without items are kept there
    with an empty hash and so come back."""
    return files.join(manifest.select("date", "source", "file_name", "sha256"), ["date", "source", "file_name", "sha256"], "left_anti")


def entities_of(mentions: DataFrame, today: dt.date, access: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """Entities derived from all mentions: they can always be made again from the files.
    The latest mention names and describes; source lines are all kept."""
    latest = F.struct("date", "source", "file_name", (-F.col("section_ord")).alias("s"), (-F.col("item_ord")).alias("i"), "__raw")
    mentions = mentions.withColumn("__raw", F.col("id"))
    if merges is not None:
        mentions = mentions.join(merges, "id", "left").withColumn("id", F.coalesce("canonical", "id")).drop("canonical")
    place = F.struct("date", "source", "file_name", "section_ord", "item_ord", "source_line")
    whole = rollup.rollup(
        mentions,
        {
            "name": F.max_by("name", latest),
            "summary": F.max_by("summary", latest),
            "status": F.max_by("status", F.when(F.col("status").isNotNull(), latest)),
            "origin": F.max_by("source", latest),
            "distinct_categories": F.count_distinct("section_title"),
            # In the order of days and places, each once.
            "source_lines": F.array_distinct(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["source_line"])),
        },
    )
    whole = whole.join(rollup.recent_days(mentions, today), "id")
    scored = rollup.scored(whole, today, access)
    meta = F.map_filter(F.create_map(F.lit("source"), F.col("origin"), F.lit("status"), F.col("status")), lambda k, v: v.isNotNull())
    return scored.withColumn("importance", F.round("score", 4)).withColumn("metadata", meta)


def relations_of(links: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Relations derived from all links: ends that were merged go to their canonical id."""
    ends = links
    for end in ("from_entity", "to_entity"):
        if merges is not None:
            ends = ends.join(merges.select(F.col("id").alias(end), "canonical"), end, "left").withColumn(end, F.coalesce("canonical", end)).drop("canonical")
    ends = ends.withColumn("id", F.format_string("rel:%s->%s:%s", "from_entity", "to_entity", "rel_type"))
    names = [c.split()[0] for c in TABLES["relations"][0].split(", ")]
    return put_relations(ends.select(*names).limit(0), ends.select(*names))


def links_of(mentions: DataFrame, projects: DataFrame) -> DataFrame:
    """Links of each file of ``mentions``, by the ids that its mentions have."""
    file = F.struct("source", "file_name").alias("file")
    own = mentions.select(file, F.col("section_ord").alias("section"), F.col("item_ord").alias("ord"), "id", "type", "name", "summary").dropDuplicates(["file", "id"])
    edges = link.section_links(own).unionAll(link.contradictions(own)).unionAll(link.dependencies(own, projects, ("file",)))
    return edges.select("file.source", "file.file_name", "from_entity", "to_entity", "rel_type", "weight", "evidence")


def similar_pairs(mentions: DataFrame, store: Store, embedder: Callable | None) -> DataFrame:
    """Pairs of ids that are one entity: an id with the earlier one whose name is most alike, by
    0.85; where there is none, those alike by 0.70 whose vectors are neighbours (an embedder
    given; vectors missing are made first)."""
    latest = F.struct("date", "file_name", (-F.col("nth")).alias("n"))
    whole = rollup.rollup(mentions, {"name": F.max_by("name", latest), "summary": F.max_by("summary", latest)})
    sure = link.nearest_earlier(whole)
    if embedder is None:
        return sure
    sure = kept(sure)
    embed_missing(store, whole, embedder)
    rest = whole.join(sure.select(F.col("b").alias("id")), "id", "left_anti")
    return sure.unionByName(link.confirmed_by_vectors(link.similar_names(whole, 0.70, of=rest), store.read("vectors")))


def embed_missing(store: Store, entities: DataFrame, embedder: Callable) -> None:
    known = store.read("vectors")
    wanted = entities.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
    store.write("vectors", upsert(known, embeddings.embed(wanted, embedder), ["entity_id"]))


def embed_again(store: Store, embedder: Callable) -> int:
    """All entities' vectors anew, whatever was stored; how many have one now."""
    store.write("vectors", embeddings.embed(store.read("entities"), embedder))
    return store.read("vectors").count()


def write_index(store: Store) -> None:
    """The keyword index of the present entities, laid out by term so that a query's words
    are found by the files' least and greatest terms."""
    index = search.postings(store.read("entities"))
    store.write("postings", index.repartitionByRange("term", "entity_id").sortWithinPartitions("term", "entity_id"))


def consolidate(
    store: Store, sources: list[tuple[str, str]], today: dt.date, embedder: Callable | None = None, merge_similar: bool = True
) -> Result:
    """Reads what is new, writes the next version of each table, and says how it went. A
    version appears whole or not at all. Files that cannot be read are reported and come back
    at the next run; the others are processed. Edited files lose their old mentions and links."""
    result = Result()
    files = read_files(store.spark, sources)
    manifest = store.read("manifest")
    new = kept(changed(files, manifest))
    result.skipped = files.count() - new.count()
    try:
        items = kept(parse_checked(new))
        bad = items.filter("error IS NOT NULL").select("source", "file_name", "error")
        result.errors = [f"{r.source}/{r.file_name}: {r.error}" for r in bad.orderBy("source", "file_name").limit(100).collect()]
        result.failed = bad.count()
        new = new.join(bad.select("source", "file_name"), ["source", "file_name"], "left_anti")
        result.processed = new.count()
        result.status = "ok" if not result.failed else "partial" if result.processed else "error"
        if not result.processed:
            return result
        names = [c.split()[0] for c in TABLES["mentions"][0].split(", ")]
        fresh = extract.mentions(items.filter("error IS NULL").drop("error")).filter("nth = 1").select(*names)
        replaced = new.select("source", "file_name").distinct()
        store.write("mentions", store.read("mentions").join(replaced, ["source", "file_name"], "left_anti").select(*names).unionAll(fresh))
        mentions = store.read("mentions")
        merges = link.merge_map(similar_pairs(mentions, store, embedder)) if merge_similar else None
        before = kept(store.read("entities").select("id"))
        store.write("entities", entities_of(mentions, today, rollup.access_counts(store.read("access_log")), merges))
        entities = store.read("entities")
        result.entities = entities.count()
        result.created = entities.join(before, "id", "left_anti").count()
        touched = mentions.join(replaced, ["source", "file_name"], "left_semi").select("id").distinct()
        if merges is not None:
            touched = touched.join(merges, "id", "left").select(F.coalesce("canonical", "id").alias("id")).distinct()
        result.updated = touched.join(before, "id", "left_semi").count()
        own = links_of(mentions.join(replaced, ["source", "file_name"], "left_semi"), entities.filter("type = 'project'"))
        old = store.read("links").join(replaced, ["source", "file_name"], "left_anti")
        store.write("links", old.select(own.columns).unionAll(own))
        store.write("relations", relations_of(store.read("links"), merges))
        result.relations = store.read("relations").count()
        write_index(store)
        if embedder:
            embed_missing(store, entities, embedder)
        counts = mentions.groupBy("source", "file_name").agg(F.count_distinct("id").alias("entity_count"))
        empty = F.col("entity_count").isNull()
        rows = new.join(counts, ["source", "file_name"], "left").select(
            "date", "source", "file_name", F.when(empty, "").otherwise(F.col("sha256")).alias("sha256"),
            F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.lit(dt.datetime.combine(today, dt.time())).alias("processed_at"),
            F.when(empty, "empty").otherwise("ok").alias("status"), "title",
        )
        store.write("manifest", upsert(manifest, rows, ["date", "source", "file_name"]))
    except Exception as e:  # the run reports; versions already written stay whole
        result.failed, result.status = result.failed + result.processed, "error"
        said = str(e).strip().splitlines() or [""]
        result.errors.append(f"{type(e).__name__}: {said[0]} ... {said[-1]}")
    return result
