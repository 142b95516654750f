"""Shared pieces of the corpus operators: scratch tables, row keys, word classes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators count it, and what a word is made of.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary folder is set,
    which goes when the driver ends; on a cluster that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="daybook-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        known = "file://" + folder
        spark.sparkContext.setCheckpointDir(known)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """One folder for each application, so that scratch tables can be removed together."""
    return f"{shared_dir(spark)}/daybook/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables of this application. Results of the operators read them, so
    call it when all results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII goes through ``lower``; the rest, whose
    other capitals must stay, through ``translate``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """16 bytes for (id, text); never null. Rows that agree in both share it."""
    return F.unhex(
        F.md5(
            F.concat(
                F.coalesce(F.col(id_column).cast("string"), F.lit("~")),
                F.lit(":"),
                F.when(F.col(text_column).isNull(), F.lit("-")).otherwise(F.lit("+")),
                text_or_empty(text_column),
            )
        )
    )


#: A key is hot beyond so many rows, and beyond one in ``MOST_HOT`` of the rows counted.
HOT_ROWS = 1000
MOST_HOT = 15_000


def hot_limit(rows: int) -> int:
    """Rows of one key that may meet in one task. Of a table of k times ``rows`` rows, at most
    k * ``MOST_HOT`` keys have more, which bounds what ``spread_join`` broadcasts."""
    return max(HOT_ROWS, rows // MOST_HOT)


def hot_keys(counts: DataFrame, keys: list[str], limit: int, count: str = "c") -> DataFrame:
    """(keys, __salts) of the rows of ``counts`` with more than ``limit`` rows of a key."""
    return counts.filter(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__salts"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key, so that no key of ``left``
    fills a task: rows of a hot key are dealt by the hash ``by`` over as many salts as it
    needs, and its row of ``right`` is repeated for each salt."""
    hot = F.broadcast(hot)  # bounded by ``hot_limit``
    salts = F.coalesce("__salts", F.lit(1))
    left = left.join(hot, keys, "left").withColumn("__salt", F.pmod(by, salts).cast("int")).drop("__salts")
    right = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
