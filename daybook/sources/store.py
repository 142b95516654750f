"""Versioned Parquet tables: a version is written whole, then a pointer moves to it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook import schemas

TABLES = {
    "entities": (schemas.ENTITIES, ["id"]),
    "relations": (schemas.RELATIONS, ["id"]),
    "manifest": (schemas.MANIFEST, ["date", "source", "file_name"]),
    "mentions": (schemas.MENTIONS, ["file_name", "source", "id", "nth"]),
    "links": (schemas.LINKS, []),
    "postings": (schemas.POSTINGS, ["entity_id", "field", "term"]),
    "access_log": (schemas.ACCESS_LOG, []),
    "vectors": (schemas.VECTORS, ["entity_id"]),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``new`` over ``old`` by ``keys``; columns in ``keep`` stay as they were where a row
    was there. ``new`` has one row per key."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    marked_a = old.withColumn("__old", F.lit(True)).alias("a")
    marked_b = new.withColumn("__new", F.lit(True)).alias("b")
    joined = marked_a.join(marked_b, on, "full_outer")
    out = []
    for c in old.columns:
        first, second = (F.col(f"a.{c}"), F.col(f"b.{c}"))
        fresh = F.when(F.col("b.__new") & ~(F.coalesce(F.col("a.__old"), F.lit(False)) & F.lit(c in keep)), second).otherwise(first)
        out.append(fresh.alias(c))
    return joined.select(*out)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def put_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id; edges from a node to itself are dropped."""
    fresh = latest_per_key(new.filter("from_entity <> to_entity"), ["id"], [F.desc("weight"), "evidence"])
    return upsert(old, fresh, ["id"])


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Without the entities in ``ids`` (id), their edges and vectors. The access log stays."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    out["entities"] = tables["entities"].join(gone, "id", "left_anti")
    rel = tables["relations"]
    for end in ("from_entity", "to_entity"):
        rel = rel.join(gone.withColumnRenamed("id", end), end, "left_anti")
    out["relations"] = rel.select(tables["relations"].columns)
    if "vectors" in tables:
        out["vectors"] = tables["vectors"].join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    return out


class Store:
    """Tables under one folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def version(self, table: str) -> int:
        """The greatest version with a complete write; 0 without any."""
        folder = self._path(table)
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath() for s in self.fs.listStatus(folder)]
        done = [p.getName() for p in names if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(n[2:]) for n in done if n.startswith("v=")), default=0)

    def read(self, table: str) -> DataFrame:
        schema, _ = TABLES[table]
        if table == "access_log":
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if self.fs.exists(self._path(table)) else self.spark.createDataFrame([], schema)
        v = self.version(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v={v}") if v else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame) -> None:
        """The next version; readers of the present one are not disturbed. The one before
        the present is removed."""
        v = self.version(table)
        names = [f.split()[0] for f in TABLES[table][0].split(", ")]
        df.select(*names).write.mode("overwrite").parquet(f"{self.root}/{table}/v={v + 1}")
        if v > 1:
            self.fs.delete(self._path(table, f"v={v - 1}"), True)

    def size_mb(self) -> float:
        """Megabytes of all tables and versions."""
        root = self._path()
        return round(self.fs.getContentSummary(root).getLength() / 2**20, 2) if self.fs.exists(root) else 0.0

    def log_access(self, hits: DataFrame, tool: str, query: str, now: dt.datetime) -> None:
        """Appends one row per hit (entity_id). Reading never writes by itself."""
        rows = hits.select("entity_id", F.lit(tool).alias("tool"), F.lit(query).alias("query"), F.lit(now).alias("accessed_at"))
        rows.write.mode("append").parquet(f"{self.root}/access_log")
