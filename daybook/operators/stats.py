"""Health statistics of the store. Every figure is one distributed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, column: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def endpoints(relations: DataFrame) -> DataFrame:
    """(node, other, and the edge) for both ends; a loop once. A union in place of an OR."""
    out = relations.select(F.col("from_entity").alias("node"), F.col("to_entity").alias("other"), "*")
    back = relations.filter("from_entity <> to_entity").select(F.col("to_entity").alias("node"), F.col("from_entity").alias("other"), "*")
    return out.unionAll(back)


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities at neither end of any edge."""
    return entities.join(endpoints(relations).select(F.col("node").alias("id")), "id", "left_anti")


def density_by_type(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Edge ends per entity of each type: an edge inside a type counts twice, a loop once."""
    ends = endpoints(relations).select(F.col("node").alias("id")).join(entities.select("id", "type"), "id")
    edges = ends.groupBy("type").agg(F.count(F.lit(1)).alias("edges"))
    total = entities.groupBy("type").agg(F.count(F.lit(1)).alias("entities"))
    return total.join(edges, "type", "left").select(
        "type", "entities", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) / F.col("entities")).alias("density")
    )


def ranked(df: DataFrame, column: str, groups: int = 512) -> DataFrame:
    """``df`` with ``place`` (from 0 in ascending order) and ``n``, without one task for all:
    equal values are summed up, ranges of values are counted, and running sums are taken
    first over the ranges and then inside each. One row per different value, with its
    first place and ``times``."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("times"))
    values = values.repartitionByRange(groups, "value").withColumn("part", F.spark_partition_id())
    totals = values.groupBy("part").agg(F.sum("times").alias("held"))
    # At most ``groups`` rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("n", F.sum("held").over(Window.partitionBy()))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    own = values.withColumn("own", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    return own.join(F.broadcast(firsts.select("part", "start", "n")), "part").select("value", "times", (F.col("start") + F.col("own")).alias("place"), "n")


def quartiles(df: DataFrame, column: str, groups: int = 512) -> DataFrame:
    """One row: values at places n//4, n//2 and 3n//4 from 0, least, greatest, and the number
    of values that differ at four decimals."""
    rows = ranked(df, column, groups)

    def at(place) -> F.Column:
        inside = (F.col("place") <= place) & (place < F.col("place") + F.col("times"))
        return F.max(F.when(inside, F.col("value")))

    n = F.col("n")
    return rows.agg(
        at(F.floor(n / 4)).alias("p25"), at(F.floor(n / 2)).alias("p50"), at(F.floor(3 * n / 4)).alias("p75"),
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.count_distinct(F.round("value", 4)).alias("values"),
    )


def gini(df: DataFrame, column: str, groups: int = 512) -> DataFrame:
    """One row: 2 sum(i s_i) / (n sum s) - (n + 1) / n; 0 for one row or a sum of 0."""
    rows = ranked(df, column, groups)
    # Equal values take the places place+1 .. place+times: their sum in closed form.
    weight = F.col("times") * F.col("place") + F.col("times") * (F.col("times") + 1) / 2
    sums = rows.agg(F.sum(F.col("value") * weight).alias("w"), F.sum(F.col("value") * F.col("times")).alias("s"), F.max("n").alias("n"))
    value = 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return sums.select(F.when((F.col("n") > 1) & (F.col("s") > 0), value).otherwise(0.0).alias("gini"))


def noise(df: DataFrame, column: str, below: float = 0.3) -> DataFrame:
    count = F.count_if(F.col(column) < below)
    return df.agg(count.alias("noise"), F.when(F.count(F.lit(1)) > 0, count / F.count(F.lit(1))).otherwise(0.0).alias("noise_ratio"))


def source_counts(df: DataFrame, metadata: str = "metadata", key: str = "source", default: str = "default") -> DataFrame:
    """Rows by ``metadata.<key>``; without it by ``default``; malformed JSON is left out."""
    json = F.coalesce(F.col(metadata), F.lit("{}"))
    good = df.filter(F.try_parse_json(json).isNotNull())
    return good.groupBy(F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(default)).alias(key)).agg(F.count(F.lit(1)).alias("cnt"))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """One row: indexed days (rows of the manifest), and when the latest date's row was processed."""
    return manifest.agg(
        F.count(F.lit(1)).alias("days_indexed"),
        F.count_distinct("date").alias("dates"),
        F.max_by("processed_at", F.struct("date", "source")).alias("last_consolidation"),
    )
