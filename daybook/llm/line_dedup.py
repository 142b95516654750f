"""Line dedup across documents, in DataFrame functions only.

Lines are exploded as 16-byte hashes of their normalised keys, documents are counted per
hash, and the positions of lines over the threshold go back to their documents, which are
put together again from the positions that stay.

Defined cases. Null or empty text: one empty line, whose key is empty and never dropped.
Documents are told apart by ``id_column`` (a null id is one document more), so repeated rows
of one id count once. Ties cannot arise: a key is over the threshold or not, in all its
documents alike. Empty table: empty result. Other columns pass through; one that has the name of a
result comes out with ``_own`` put after its name. Internal columns start with ``__ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import ascii_lower, row_key, strip_space, text_or_empty

#: Copies of each frequent key, so that a key found in a third of all documents is spread.
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(strip_space(line))


def _line_hashes(text: str) -> Column:
    """For each line its position's key hash; null where the key is empty."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(key != "", F.unhex(F.md5(key)))

    return F.transform(F.split(text_or_empty(text), "\n"), one)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, id_column: str = "doc_id", text_column: str = "text", by_text: bool = False,
    names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with ``names`` added: the text left, the lines it had and those dropped.

    Lines whose key is found in at least ``min_docs`` documents are dropped everywhere.
    With ``by_text``, documents are told apart by their text instead of their id, so that
    exact copies of one document count once and keep their lines.
    """
    for name in names:
        free = name
        while free in docs.columns and name in docs.columns:
            free += "_own"
        docs = docs.withColumnRenamed(name, free)
    lines = docs.select(
        row_key(id_column, text_column).alias("__ld_row"),
        (F.unhex(F.md5(text_or_empty(text_column))) if by_text else F.col(id_column)).alias("__ld_id"),
        F.posexplode(_line_hashes(text_column)).alias("__ld_pos", "__ld_key"),
    ).filter(F.col("__ld_key").isNotNull())
    frequent = (
        lines.select("__ld_key", "__ld_id")
        .distinct()
        .groupBy("__ld_key")
        .agg(F.count(F.lit(1)).alias("__ld_docs"))
        .filter(F.col("__ld_docs") >= min_docs)
        .select("__ld_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__ld_salt"))
    )
    dropped = (
        lines.withColumn("__ld_salt", F.pmod(F.xxhash64("__ld_row"), F.lit(SALTS)).cast("int"))
        .join(frequent, ["__ld_key", "__ld_salt"], "left_semi")
        .groupBy("__ld_row")
        .agg(F.collect_set("__ld_pos").alias("__ld_gone"))
    )
    whole = F.split(text_or_empty(text_column), "\n")
    joined = docs.withColumn("__ld_row", row_key(id_column, text_column)).join(
        dropped.hint("shuffle_hash"), "__ld_row", "left"
    )
    # array_except is a set difference by hashing: long documents stay linear.
    stay = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_gone"))
    return (
        joined.withColumn("__ld_lines", whole)
        .withColumns(
            {
                names[0]: F.when(F.col("__ld_gone").isNull(), text_or_empty(text_column)).otherwise(
                    F.array_join(F.transform(stay, lambda i: F.col("__ld_lines")[i]), "\n")
                ),
                names[1]: F.size("__ld_lines").cast("long"),
                names[2]: F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long"),
            }
        )
        .drop("__ld_row", "__ld_gone", "__ld_lines")
    )
