"""The engine's tables as projections of the driver's tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TODAY = dt.date(2001, 8, 1)
KINDS = {"1-URGENT": "project", "2-HIGH": "decision", "3-MEDIUM": "risk", "4-NOT SPECIFIED": "task", "5-LOW": "fact"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a mention of the entity (priority, customer) on its day."""
    kind = F.lit(None).cast("string")
    for priority, k in KINDS.items():
        kind = F.when(F.col("o_orderpriority") == priority, k).otherwise(kind)
    return table(spark, sf_dir, "orders").select(
        F.concat_ws(":", "o_orderpriority", F.col("o_custkey").cast("string")).alias("id"),
        kind.alias("type"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("source"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled-up mentions with a name, a summary, tags and an importance between 0 and 1."""
    from daybook.operators.rollup import rollup

    extra = {"importance": F.max("price") / 600000, "tag_count": F.count_distinct("source"), "origin": F.min("source")}
    out = rollup(mentions(spark, sf_dir), extra)
    key = F.element_at(F.split("id", ":"), -1)
    return out.withColumn("name", F.concat_ws(" ", "type", key)).withColumn(
        "summary", F.concat(F.lit("about customer "), key, F.lit(" since "), F.col("first_seen").cast("string"))
    )


#: Orders in a run of so many keys are neighbours: groups stay small however many there are.
RUN = 500


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive orders inside a run of order keys link their entities."""
    own = table(spark, sf_dir, "orders").select(
        F.concat_ws(":", "o_orderpriority", F.col("o_custkey").cast("string")).alias("to_entity"),
        F.floor(F.col("o_orderkey") / RUN).alias("run"), "o_orderdate", "o_orderkey", "o_totalprice",
    )
    before = Window.partitionBy("run").orderBy("o_orderdate", "o_orderkey")
    edges = own.withColumn("from_entity", F.lag("to_entity").over(before)).filter("from_entity <> to_entity")
    edges = edges.groupBy("from_entity", "to_entity").agg((F.max("o_totalprice") / 500000).alias("weight"))
    return edges.select(
        F.format_string("rel:%s->%s:RELATES_TO", "from_entity", "to_entity").alias("id"), "from_entity", "to_entity",
        F.when(F.col("weight") > 0.95, "DEPENDS_ON").otherwise("RELATES_TO").alias("rel_type"), "weight", F.lit("co_occurrence").alias("evidence"),
    )


class Snapshot:
    """Tables by name, as the tools read them from a store."""

    def __init__(self, **tables: DataFrame) -> None:
        self.tables = tables

    def read(self, name: str) -> DataFrame:
        return self.tables[name]


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities with metadata; facts about every second customer are preferences, and
    projects have their customer's name, which tasks mention."""
    e = entities(spark, sf_dir).withColumn("even", F.element_at(F.split("id", ":"), -1).cast("bigint") % 2 == 0)
    meta = F.create_map(
        F.lit("source"), F.col("origin"), F.lit("domain"), F.when(F.col("origin") == "F", "Work").otherwise("home"),
        F.lit("status"), F.when(F.col("origin") == "F", "completed").otherwise("todo"),
    )
    kind = F.when((F.col("type") == "fact") & F.col("even"), "preference").otherwise(F.col("type"))
    name = F.when(F.col("type") == "project", F.concat_ws(" ", F.lit("customer"), F.element_at(F.split("id", ":"), -1))).otherwise(F.col("name"))
    return e.withColumns({"type": kind, "name": name, "metadata": meta}).drop("even", "origin", "tag_count")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: the first line is the name, the text the summary."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id"),
        F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("name"), F.coalesce("text", F.lit("")).alias("summary"), F.col("lang").alias("type"),
        "source", (F.col("n_chars") / 40000.0).alias("importance"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of a source was processed at the latest event of that day and type."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("source")).agg(
        F.max("ts").alias("processed_at"), F.count(F.lit(1)).alias("entity_count")
    )


MENTIONS_SQL = """men AS (SELECT o_orderpriority || ':' || o_custkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'project' WHEN '2-HIGH' THEN 'decision'
  WHEN '3-MEDIUM' THEN 'risk' WHEN '4-NOT SPECIFIED' THEN 'task' WHEN '5-LOW' THEN 'fact' END AS type, o_orderdate::DATE AS date,
  o_totalprice AS price, o_orderstatus AS source FROM orders)"""
ENTITIES_SQL = (
    MENTIONS_SQL
    + """,
ent0 AS (SELECT id, type, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT date)::BIGINT AS day_count, max(price) / 600000 AS importance,
  count(DISTINCT source)::BIGINT AS tag_count, min(source) AS origin FROM men GROUP BY id, type),
ent AS (SELECT *, type || ' ' || string_split(id, ':')[-1] AS name, 'about customer ' || string_split(id, ':')[-1] || ' since ' || first_seen::VARCHAR AS summary FROM ent0)"""
)
RELATIONS_SQL = f"""rel0 AS (SELECT lag(t) OVER (PARTITION BY run ORDER BY o_orderdate, o_orderkey) AS f, t, o_totalprice FROM
  (SELECT *, o_orderpriority || ':' || o_custkey AS t, o_orderkey // {RUN} AS run FROM orders)),
rel AS (SELECT 'rel:' || f || '->' || t || ':RELATES_TO' AS id, f AS from_entity, t AS to_entity,
  CASE WHEN max(o_totalprice) / 500000 > 0.95 THEN 'DEPENDS_ON' ELSE 'RELATES_TO' END AS rel_type, max(o_totalprice) / 500000 AS weight, 'co_occurrence' AS evidence
  FROM rel0 WHERE f <> t GROUP BY f, t),
ends AS (SELECT from_entity AS node, to_entity AS other, * FROM rel UNION ALL SELECT to_entity, from_entity, * FROM rel WHERE from_entity <> to_entity)"""
KNOWN_SQL = (
    ENTITIES_SQL
    + """,
kn AS (SELECT id, CASE WHEN type = 'fact' AND string_split(id, ':')[-1]::BIGINT % 2 = 0 THEN 'preference' ELSE type END AS type,
  CASE WHEN type = 'project' THEN 'customer ' || string_split(id, ':')[-1] ELSE name END AS name, summary, importance, first_seen, last_seen, day_count, origin AS source, CASE WHEN origin = 'F' THEN 'Work' ELSE 'home' END AS domain, CASE WHEN origin = 'F' THEN 'completed' ELSE 'todo' END AS status FROM ent)"""
)
NOTES_SQL = """note AS (SELECT 'doc:' || doc_id AS id, doc_id, string_split(coalesce(text, ''), chr(10))[1] AS name, coalesce(text, '') AS summary, lang AS type,
  source, n_chars / 40000.0 AS importance FROM documents)"""
MANIFEST_SQL = "man AS (SELECT ts::DATE AS date, event_type AS source, max(ts) AS processed_at, count(*)::BIGINT AS entity_count FROM events GROUP BY 1, 2)"


def score_sql(day_count: str = "day_count", tags: str = "0", access: str = "0", categories: str = "0") -> str:
    d = f"greatest(date_diff('day', last_seen, DATE '{TODAY}'), 0)"
    fade = f"CASE WHEN {d} > 30 THEN greatest(0.3, 1 - ({d} - 30) / 90.0) ELSE 1.0 END"
    return f"""greatest(0, 0.15 * greatest(0, 1 - {d} / 30.0) + 0.30 * (CASE WHEN {day_count} > 0 THEN ln(1.0 + {day_count}) / ln(8.0) * {fade} ELSE 0 END)
      + 0.05 * least(1, {categories} / 4.0) + 0.05 * least(1, {tags} / 5.0) + 0.10 * least(1, {access} / 5.0)
      + 0.35 * CASE type WHEN 'decision' THEN 0.8 WHEN 'risk' THEN 0.6 WHEN 'project' THEN 0.5 WHEN 'preference' THEN 0.4 WHEN 'task' THEN 0.15
        WHEN 'tech' THEN 0.05 ELSE 0 END)::DOUBLE"""
