"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Columns that a stage adds on its way start with ``__cp_``.

In all stages rows are told apart by id and text, so null and repeated ids do no harm; rows
that agree in both are repeated rows. Very long texts are read whole. An empty table gives
an empty table. Further columns pass through whatever their names, but for the last stage,
which has the columns of its operator.

The first two stages tell documents apart by their text when they count in how many a line
is found. Counted by id, the lines of a document with ten copies would all be common, and
its copies would be emptied before the stage that keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from daybook.llm.common import hot_keys, hot_limit, read_table, spread_join, text_or_empty, written

#: What may be sent to every executor (keys of some 20 bytes, and line numbers); more meets
#: the documents by shuffle.
SENT = 500_000


def _key(text_hash: Column, *others: Column) -> Column:
    """16 bytes for a row; null and empty texts share theirs."""
    parts = (F.coalesce(c.cast("string"), F.lit("~")) for c in others)
    return F.unhex(F.md5(F.concat_ws(":", F.hex(text_hash), *parts)))


def _own_hash() -> Column:
    return F.unhex(F.md5(text_or_empty()))


def _looked_up(docs: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """``docs`` with ``__cp_key`` and the columns of ``found``, null where it has no row.

    ``found`` has one row per ``__cp_key``, with ``__cp_rows``, the number of rows of ``docs``
    that have the key, and ``__cp_places``, an array or null. Its size is taken first: little
    goes to the documents, more meets them by shuffle, keys of many rows over salts."""
    keyed = docs.withColumn("__cp_key", key)
    places = F.greatest(F.size("__cp_places"), F.lit(0))
    n, rows = found.agg(F.coalesce(F.sum(places + 1), F.lit(0)), F.coalesce(F.sum("__cp_rows"), F.lit(0))).first()
    table = found.drop("__cp_rows")
    if n <= SENT:
        return keyed.join(F.broadcast(table), "__cp_key", "left")
    hot = hot_keys(found, ["__cp_key"], hot_limit(rows), "__cp_rows")
    dealt = keyed.withColumn("__cp_at", F.monotonically_increasing_id())
    return spread_join(dealt, table, ["__cp_key"], hot, F.xxhash64("__cp_at"), "left").drop("__cp_at")


def _with_text(docs: DataFrame, changed: Column, text: Column, columns: list[str]) -> DataFrame:
    """``columns`` with ``text``, and ``n_chars`` where there is one, set where ``changed``."""
    out = docs.withColumn("__cp_text", text)
    own = {"text": F.when(changed, F.col("__cp_text")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(changed, F.length("__cp_text").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*(own[c].alias(c) if c in own else F.col(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that are over the
    limits on their host, and ``n_chars`` follows.

    Null or empty text: rejected. Null source: a host of its own. Repeated rows: all stay or
    all go, as they do with ties (see ``quality_rules``)."""
    judged = quality_rules.judge(docs, by_text=True).filter("NOT kept OR removed IS NOT NULL")
    judged = judged.withColumn("__cp_key", _key(F.col("text_hash"), F.col("doc_id"), F.col("host")))
    found = judged.groupBy("__cp_key").agg(
        F.first("kept").alias("__cp_kept"), F.first(F.when(F.col("kept"), F.col("removed"))).alias("__cp_places"), F.count(F.lit(1)).alias("__cp_rows")
    )
    out = _looked_up(docs, _key(_own_hash(), F.col("doc_id"), quality_rules.host_key()), written(found, "judged"))
    out = out.filter(F.coalesce("__cp_kept", F.lit(True)))
    places = F.col("__cp_places")
    return _with_text(out, places.isNotNull(), quality_rules.without_lines(F.col("text"), places), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more different texts go; ``n_chars`` follows. No document goes:
    one whose lines were all common stays with an empty text.

    Null or empty text: as it is. Repeated rows and copies: count once, and lose the same
    lines. Ties: a line goes everywhere or nowhere."""
    names = ("__cp_kept", "__cp_lines", "__cp_dropped")
    out = line_dedup.dedup_lines(docs, min_docs=10, by_text=True, names=names)
    return _with_text(out, F.col("__cp_dropped") > 0, F.col("__cp_kept"), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) one document stays: that of least id
    (null last), and of these that of least text hash.

    Ids may be null or repeat: groups are told apart by their texts, not by ids. Null and
    empty texts and those without words have no group and stay. Of repeated rows one stays."""
    found = near_dedup.near_duplicates(docs, size=5, percent=80).select("doc_id", "text_hash", "cls", "stands")
    found = found.withColumn("__cp_key", _key(F.col("text_hash"), F.col("doc_id")))
    found = found.groupBy("__cp_key").agg(
        F.max("stands").alias("__cp_stands"), F.max(F.col("cls").isNotNull()).alias("worded"), F.count(F.lit(1)).alias("__cp_rows")
    )
    gone = found.filter("NOT __cp_stands OR (worded AND __cp_rows > 1)").drop("worded")
    gone = written(gone.withColumn("__cp_places", F.lit(None).cast("array<int>")), "gone")
    out = _looked_up(docs, _key(_own_hash(), F.col("doc_id")), gone)
    stay = out.filter("__cp_stands IS NULL").select(docs.columns)
    if gone.filter("__cp_stands").isEmpty():
        return stay
    # Rows that agree in id and text: one of them stays.
    once = out.filter("__cp_stands").dropDuplicates(["__cp_key"]).select(docs.columns)
    return stay.unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a 13-word window of a benchmark item occurs go.

    Null or empty text: no words, stays. Repeated rows: all stay or all go. Benchmark rows
    with null id or without words have no windows. Rows are told apart by a 64-bit hash of id
    and text, so a repeated id loses only the texts that are hit."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), text_or_empty())
    keyed = docs.select(key.alias("__cp_key"), "text")
    index = decontaminate.build_index(keyed, id_column="__cp_key")
    hit = decontaminate.summarize(index, read_table(spark, sf_dir, "benchmark"), window=13).filter("n_hit > 0")
    hit = hit.groupBy(F.col("doc_id").alias("__cp_key")).agg(F.count(F.lit(1)).alias("__cp_rows"))
    hit = hit.withColumns({"__cp_hit": F.lit(True), "__cp_places": F.lit(None).cast("array<int>")})
    return _looked_up(docs, key, written(hit, "leaks")).filter("__cp_hit IS NULL").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left as pieces of sequences of at most 4096 ids; a null or empty text is its
    end id alone, and repeated rows are documents of their own."""
    from public_tokenizers import path

    return packing.pack(docs, path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Neither the tokenizer nor the plan of the packing can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
