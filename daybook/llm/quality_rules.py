"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The cross-document rule hashes normalised lines and counts, per
host (``source``), the distinct documents that carry each line. A line is over the limits if
at least ``min_docs`` documents of its host carry it and these are at least ``min_percent`` of the
host's documents, so that the limit means the same at every size. Lines over the limits are
removed (``without_lines``), and a document is depleted, and rejected, when less than
``min_left`` percent of its lines' characters (white space at their ends left out) is left.

Documents are told apart by id; all rows with a null id are one document more. With
``by_text`` they are told apart by their text, so that the copies of one document do not make
boilerplate of its lines, and all null and empty texts are one.

Defined cases. Null or empty text: no words, base_failed, not kept. Null host: a host of its
own. A line repeated in a text weighs as often as it stands there, but makes one document.
Ties: a line is over the limits or not in all documents of its host alike. Repeated rows get
the same verdict. Empty table: empty result. Very long texts: all work in a row is linear or
n log n. 3-word windows are told apart by a 64-bit hash within their text. Only the named
columns of ``docs`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import SPACE, hot_keys, hot_limit, spread_join, strip_space, text_or_empty, written
from daybook.llm.line_dedup import line_key

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 3-word windows found twice or more.

    ``__qr_windows`` holds the windows' hashes. Sorting (hash, place) pairs puts equal
    windows side by side; only texts in which a hash recurs are sorted. Each step is a
    column of its own, so that the lambdas refer to arrays already computed.
    """
    windows = F.col("__qr_windows")
    recurs = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__qr_pairs", F.when(recurs, F.sort_array(pairs)))
    ordered = F.col("__qr_pairs")

    def place(x: Column, k: Column) -> Column:
        before, after = F.get(ordered, k - 1)["h"], F.get(ordered, k + 1)["h"]
        return F.when((before.eqNullSafe(x["h"])) | (after.eqNullSafe(x["h"])), x["i"])

    hit = F.sort_array(F.array_compact(F.transform(ordered, place)))
    covered = F.aggregate(
        hit,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def text_rules(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the counts of one text and ``base_failed`` added."""
    text = text_or_empty(text_column)
    df = docs.withColumn("__qr_text", text).withColumn(
        "__qr_words",
        F.when(strip_space(F.col("__qr_text")) == "", F.array().cast("array<string>")).otherwise(
            F.split(strip_space(F.col("__qr_text")), f"{SPACE}+")
        ),
    )
    words, lines = F.col("__qr_words"), F.filter(
        F.split("__qr_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    )
    df = df.withColumn("__qr_lines", lines).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": (F.length("__qr_text") - F.regexp_count("__qr_text", F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count("__qr_text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long"),
            "__qr_windows": F.when(
                F.size(words) >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
                    lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    df = _with_repeats(df)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop(
        "__qr_text", "__qr_words", "__qr_windows", "__qr_pairs", "__qr_lines"
    )


def host_key(host_column: str = "source") -> Column:
    """The host as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_column).cast("string")), F.lit("-"))


def judge(
    docs: DataFrame,
    min_docs: int = 10,
    min_percent: int = 1,
    min_left: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    by_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, ``base_failed``, ``chars``,
    ``chars_removed``, ``removed`` (places of the lines over the limits, from 0, sorted; null
    without any), ``kept``, and the row's 16-byte ``text_hash`` and ``host``."""
    text = text_or_empty(text_column)
    keys = F.transform(F.split(text, "\n"), line_key)
    own = docs.select(
        F.col(id_column).alias("doc_id"),
        host_key(host_column).alias("host"),
        F.unhex(F.md5(text)).alias("text_hash"),
        F.transform(
            keys, lambda k: F.struct(F.when(k != "", F.unhex(F.md5(k))).alias("key"), F.length(k).alias("len"))
        ).alias("lines"),
        F.col(text_column).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = text_rules(own).withColumn(
        "chars", F.aggregate("lines", F.lit(0), lambda n, x: n + x["len"])
    )
    own = written(own.drop("text"), "quality")
    document = F.col("text_hash") if by_text else F.col("doc_id")
    lines = own.select("host", "row", document.alias("document"), F.posexplode("lines").alias("at", "line"))
    lines = lines.select("host", "row", "document", "at", "line.*").filter("key IS NOT NULL")
    # Two steps, the first over (host, key, document): no host or line meets in one task.
    found = lines.select("host", "key", "document").distinct()
    per_line = found.groupBy("host", "key").agg(F.count(F.lit(1)).alias("c"))
    # One row per host; the hosts of the lines left are few where the limits bite.
    per_host = own.select("host", document.alias("document")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = written(per_line.filter(F.col("c") >= min_docs), "often")
    hosts = often.groupBy("host").agg(F.count(F.lit(1)).alias("c"))
    limit = hot_limit(own.count())
    over = spread_join(often, per_host, ["host"], written(hot_keys(hosts, ["host"], limit), "hot_hosts"), F.xxhash64("key"))
    over = written(over.filter(100 * F.col("c") >= min_percent * F.col("all")).select("host", "key", "c"), "over")
    hot = hot_keys(over, ["host", "key"], limit)
    removed = (
        spread_join(lines, over.drop("c"), ["host", "key"], hot, F.xxhash64("row"))
        .groupBy("row")
        .agg(F.sum("len").alias("chars_removed"), F.sort_array(F.collect_list("at")).alias("removed"))
    )
    out = own.drop("lines").join(removed, "row", "left").drop("row")
    gone = F.coalesce("chars_removed", F.lit(0))
    depleted = (gone > 0) & (100 * (F.col("chars") - gone) < min_left * F.col("chars"))
    return out.withColumn("chars_removed", gone).withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at ``places`` (from 0); as it is where they are null."""
    lines = F.split(text, "\n")
    # A set difference by hashing: long texts stay linear.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.when(places.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
