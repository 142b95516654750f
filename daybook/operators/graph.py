"""Edges read as undirected: neighbours, expansion by levels, attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.link import names_inside, searchable
from daybook.operators.stats import endpoints


def neighbours(relations: DataFrame) -> DataFrame:
    """(node, other, rel_type, weight): one row per pair, its heaviest edge."""
    first = Window.partitionBy("node", "other").orderBy(F.desc("weight"), "rel_type", "id")
    ends = endpoints(relations).filter("node <> other")
    return ends.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("node", "other", "rel_type", "weight")


def touching(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes`` (node), heaviest first."""
    ids = endpoints(relations).join(nodes.select("node").distinct(), "node", "left_semi")
    return ids.drop("node", "other").distinct().orderBy(F.desc("weight"), "id")


def expand(relations: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): all nodes within ``depth`` edges of ``start`` (node). One join per
    level (at most five); nodes seen are not expanded again."""
    links = endpoints(relations).select("node", "other").distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        found = front.select("node").join(links, "node").select(F.col("other").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionAll(front)
    return seen


def top_related(relations: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(node, related): for each of ``nodes`` its heaviest neighbours' ids, in order."""
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    near = neighbours(relations).join(nodes.select("node").distinct(), "node", "left_semi")
    near = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    pairs = F.array_sort(F.collect_list(F.struct("nth", "other")))
    return near.groupBy("node").agg(F.transform(pairs, lambda x: x["other"]).alias("related"))


def trace(entities: DataFrame, relations: DataFrame, root: str, depth: int = 2, most: int = 20) -> DataFrame:
    """The nodes around ``root``: depth, the root's edge to it (RELATES_TO at 0.5 beyond one
    hop), its days; in order of depth, weight and id."""
    spark = entities.sparkSession
    nodes = expand(relations, spark.createDataFrame([(root,)], "node string"), depth).filter("depth > 0")
    edge = neighbours(relations).filter(F.col("node") == root).select(F.col("other").alias("id"), "rel_type", "weight")
    out = entities.join(nodes.withColumnRenamed("node", "id"), "id").join(edge, "id", "left")
    return out.select(
        "id", "type", "name", "first_seen", "last_seen", "depth",
        F.coalesce("rel_type", F.lit("RELATES_TO")).alias("rel_type"), F.coalesce("weight", F.lit(0.5)).alias("weight"),
    ).orderBy("depth", F.desc("weight"), "id").limit(most)


def timeline(entities: DataFrame, relations: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """``root`` and the nodes around it in order of their first day: (date, id, summary)."""
    spark = entities.sparkSession
    nodes = expand(relations, spark.createDataFrame([(root,)], "node string"), depth).select(F.col("node").alias("id"))
    out = entities.join(nodes, "id", "left_semi").filter("first_seen IS NOT NULL")
    return out.select(F.col("first_seen").alias("date"), "id", F.substring("summary", 1, 200).alias("summary")).orderBy("date", "id")


def decisions_around(entities: DataFrame, relations: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """The decisions among ``root`` and the nodes around it, the root's own first, then by
    depth and id: (place, id, date, content)."""
    spark = entities.sparkSession
    nodes = expand(relations, spark.createDataFrame([(root,)], "node string"), depth).withColumnRenamed("node", "id")
    out = entities.filter("type = 'decision'").join(nodes, "id")
    return out.select(F.col("depth").alias("place"), "id", F.col("last_seen").alias("date"), F.substring("summary", 1, 200).alias("content")).orderBy("place", "id")


def attach_by_name(parents: DataFrame, children: DataFrame, most: int = 5, column: str = "children") -> DataFrame:
    """For each of ``parents`` (id, name): ids of ``children`` (id, name, summary, importance)
    whose text holds the parent's name, the most important first. Names too short or too
    general to be searched for have none."""
    text = F.concat(F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit("")))
    kids = children.select(F.col("id").alias("c_id"), text.alias("text"), F.col("importance").alias("c_importance"))
    pairs = names_inside(kids, searchable(parents.select("id", "name"))).filter("c_id <> id")
    order = Window.partitionBy("id").orderBy(F.desc("c_importance"), "c_id")
    pairs = pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    got = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "c_id"))).alias("x"))
    return parents.join(got, "id", "left").withColumn(
        column, F.coalesce(F.transform("x", lambda x: x["c_id"]), F.array().cast("array<string>"))
    ).drop("x")
