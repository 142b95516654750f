"""The query tools over a store: search, trace, activity, preferences, decisions, stats."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.scoring import importance
from daybook.functions.text import about_topic
from daybook.operators import graph, rollup, search, stats
from daybook.sources.store import Store


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


class Knowledge:
    """Tools over the current versions of a store's tables. ``today`` is given, results do
    not depend on the clock, and reads write nothing; pass ``log=True`` to record hits."""

    def __init__(self, store: Store, today: dt.date, slugs: DataFrame | None = None, embedder: Callable | None = None) -> None:
        self.store, self.today, self.slugs, self.embedder = store, today, slugs, embedder
        self.entities, self.relations = store.read("entities"), store.read("relations")

    def _log(self, hits: DataFrame, tool: str, query: str, log: bool) -> None:
        if log:
            self.store.log_access(hits, tool, query, dt.datetime.combine(self.today, dt.time()))

    def _index(self) -> DataFrame | None:
        """The stored index, where the store has one."""
        return self.store.read("postings") if getattr(self.store, "version", lambda t: 0)("postings") else None

    def _candidates(self, query: str, pool: DataFrame, most: int) -> DataFrame:
        """The first ``most`` rows of ``pool`` by nearness of vectors, or by keywords."""
        if self.embedder:
            vector = self.embedder([query])[0]
            if vector:
                mine = self.store.read("vectors").join(pool.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
                near = search.nearest(mine, vector, most).withColumnRenamed("entity_id", "id")
                return pool.join(near.withColumnRenamed("value", "rank"), "id")
        return search.keyword(pool, query, most, self._index(), self.entities)

    def hits(
        self, query: str, entity_type: str | None = None, source: str | None = None, max_results: int = 10, min_score: float = 0.0, offset: int = 0
    ) -> DataFrame:
        """A page of entities with ``score``, ``rank`` and ``similarity_score``.

        Type, source, recurrence gate and least score come before all limits, for vectors and
        keywords alike, so a page is full where there are hits enough. Of the nearest hits,
        three for each place, those of the greatest score of today come first."""
        most, skipped = clamp(max_results, 1, 100), max(0, offset)
        score = importance(F.col("type"), F.col("last_seen"), F.col("day_count"), self.today)
        pool = rollup.gate(self.entities, self.slugs).withColumn("score", score).filter(F.col("score") >= min_score)
        if entity_type:
            pool = pool.filter(F.col("type") == entity_type)
        if source:
            pool = pool.filter(F.col("metadata")["source"] == source)
        found = self._candidates(query, pool, 3 * (most + skipped)).withColumn("similarity_score", search.similarity_score(query))
        return found.orderBy(F.desc("score"), F.desc("rank"), "id").offset(skipped).limit(most)

    def knowledge_search(
        self, query: str, entity_type: str | None = None, source: str | None = None, max_results: int = 10, min_score: float = 0.0,
        offset: int = 0, log: bool = False,
    ) -> DataFrame:
        """``hits`` with their nearest neighbours in the graph, in the order of the page."""
        page = self.hits(query, entity_type, source, max_results, min_score, offset)
        related = graph.top_related(self.relations, page.select(F.col("id").alias("node")))
        out = page.join(related.withColumnRenamed("node", "id"), "id", "left").orderBy(F.desc("score"), F.desc("rank"), "id").select(
            F.col("id").alias("entity_id"), "name", "type", F.substring("summary", 1, 200).alias("summary"), "similarity_score", "score",
            "importance", "first_seen", "last_seen", F.coalesce("related", F.array().cast("array<string>")).alias("related_entities"),
        )
        self._log(out, "knowledge_search", query, log)
        return out

    def resolve(self, topic: str) -> str | None:
        """The id itself, or the first hit of a search for the topic."""
        exact = self.entities.filter(F.col("id") == topic).select("id").limit(1).collect()
        hit = exact or search.keyword(self.entities, topic, 1, self._index(), self.entities).select("id").limit(1).collect()
        return hit[0].id if hit else None

    def knowledge_trace(self, topic: str, max_depth: int = 2, log: bool = False) -> dict[str, DataFrame]:
        """Around the entity that the topic names: ``entity``, ``timeline`` by date,
        ``related`` (at most 20, nearest and heaviest first) and ``decisions``. All are empty
        where nothing is found."""
        root, depth = self.resolve(topic) or "", clamp(max_depth, 1, 5)
        own = self.entities.filter(F.col("id") == root)
        self._log(own.select(F.col("id").alias("entity_id")), "knowledge_trace", topic, log)
        return {
            "entity": described(own),
            "timeline": graph.timeline(self.entities, self.relations, root, depth),
            "related": graph.trace(self.entities, self.relations, root, depth),
            "decisions": graph.decisions_around(self.entities, self.relations, root, depth),
        }

    def active_projects(self, lookback_days: int = 14, only_open: bool = False, log: bool = False) -> DataFrame:
        mine = rollup.active(rollup.gate(self.entities.filter("type = 'project'"), self.slugs), self.today, clamp(lookback_days, 1, 90))
        tasks = self.entities.filter("type = 'task'")
        if only_open:
            tasks = tasks.filter(F.coalesce(F.col("metadata")["status"], F.lit("todo")) != "completed")
        out = graph.attach_by_name(mine, tasks, 5, "open_tasks").orderBy(F.desc("importance"), "id")
        self._log(mine.select(F.col("id").alias("entity_id")), "active_projects", "", log)
        return out.select("id", "name", F.substring("summary", 1, 200).alias("summary"), "last_seen", "day_count", "status", "importance", "open_tasks")

    def preference_lookup(self, topic: str | None = None, domain: str | None = None, log: bool = False) -> DataFrame:
        out = self.entities.filter("type = 'preference'")
        if topic:
            out = out.filter(about_topic(topic))
        if domain:
            out = out.filter(F.lower(F.col("metadata")["domain"]) == domain.lower())
        self._log(out.select(F.col("id").alias("entity_id")), "preference_lookup", topic or "", log)
        return out.select(
            "id", "name", F.col("summary").alias("content"), F.col("importance").alias("strength"), "first_seen", "last_seen", "day_count"
        ).orderBy(F.desc("strength"), "id")

    def decision_history(self, topic: str, include_risk: bool = True, offset: int = 0) -> DataFrame:
        return decision_history(self.entities, self.relations, topic, include_risk).offset(max(0, offset))

    def by_type(self, entity_type: str) -> DataFrame:
        """All entities of a type, the most important first."""
        return self.entities.filter(F.col("type") == entity_type).orderBy(F.desc("importance"), "id")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """The entities among ``ids`` (id)."""
        return self.entities.join(ids.select("id").distinct(), "id", "left_semi")

    def knowledge_stats(self) -> dict[str, DataFrame]:
        """Each group of figures as a DataFrame of its own, all lazy."""
        e, r = self.entities, self.relations
        return {
            "by_type": stats.count_by(e, "type").orderBy(F.desc("cnt"), "type"),
            "by_relation": stats.count_by(r, "rel_type"),
            "totals": e.agg(F.count(F.lit(1)).alias("entities")).crossJoin(r.agg(F.count(F.lit(1)).alias("relations"))).crossJoin(
                self.store.read("vectors").agg(F.count(F.lit(1)).alias("vectors"))
            ),
            "orphans": stats.orphans(e, r).agg(F.count(F.lit(1)).alias("orphans")),
            "density": stats.density_by_type(e, r),
            "quartiles": stats.quartiles(e, "importance"),
            "gini": stats.gini(e, "importance"),
            "noise": stats.noise(e, "importance"),
            "manifest": stats.manifest_stats(self.store.read("manifest")),
            "by_source": stats.count_by(e.select(F.coalesce(F.col("metadata")["source"], F.lit("default")).alias("source")), "source"),
        }

    def entity(self, entity_id: str) -> tuple[DataFrame, DataFrame]:
        """The entity's row, and the edges that touch it."""
        node = self.entities.filter(F.col("id") == entity_id)
        return node, graph.touching(self.relations, node.select(F.col("id").alias("node")))

    def day(self, date: dt.date) -> DataFrame:
        """The manifest's rows of a day, of all sources."""
        return self.store.read("manifest").filter(F.col("date") == date)


def described(entities: DataFrame) -> DataFrame:
    """Entities as results: the summary's first 500 characters, metadata beside it."""
    return entities.select(
        F.col("id").alias("entity_id"), "type", "name", F.substring("summary", 1, 500).alias("summary"), "importance", "first_seen", "last_seen", "day_count", "metadata"
    )


def decision_history(entities: DataFrame, relations: DataFrame, topic: str, include_risk: bool = True, most: int = 10) -> DataFrame:
    """Decisions about a topic, latest first, with the ids of linked risks and tasks; risks
    about the topic follow the linked ones."""
    found = entities.filter(F.col("type") == "decision").filter(about_topic(topic))
    near = graph.neighbours(relations).join(entities.select(F.col("id").alias("other"), F.col("type").alias("kind")), "other")
    near = near.filter("kind IN ('risk', 'task')").join(found.select(F.col("id").alias("node")), "node", "left_semi")
    lists = near.groupBy("node").agg(
        *(
            F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct((-F.col("weight")).alias("w"), "other")))).alias(f"{k}s")
            for k in ("risk", "task")
        )
    )
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["other"]), F.array().cast("array<string>"))
    # The most important risks about the topic: ``most`` rows in one array.
    top = entities.filter(F.col("type") == "risk").filter(about_topic(topic)).orderBy(F.desc("importance"), "id").limit(most)
    about = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("w"), "id"))).alias("about"))
    out = found.join(lists.withColumnRenamed("node", "id"), "id", "left").crossJoin(F.broadcast(about))
    risks = F.array_distinct(F.concat(ids(F.col("risks")), F.transform("about", lambda x: x["id"])))
    risks = F.slice(risks, 1, most) if include_risk else F.array().cast("array<string>")
    return out.select(
        "id", F.col("name").alias("rationale"), F.col("last_seen").alias("date"), risks.alias("risks"), F.slice(ids(F.col("tasks")), 1, most).alias("follow_ups")
    ).orderBy(F.desc("date"), "id")
