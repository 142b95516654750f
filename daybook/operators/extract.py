"""Typed mentions from items, as regular-expression generators inside the plan.

Each generator gives an array of candidates in order; the arrays are joined in order of
rank and exploded once, and the first candidate of an id stays. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook import vocab
from daybook.functions.text import compact_name, contains_any, entity_id, is_garbage_name, is_garbage_text, strip

#: Python's dialect: ``.`` stops at line feeds alone, classes are Unicode's.
_DIALECT = "(?dU)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(_DIALECT + pattern), F.lit(group))


#: What a generator gives; ``rule`` says where the name comes from, and so what describes it.
CANDIDATE = "struct<type:string,name:string,status:string,seed:string,rule:string>"
#: Fixed value: how a technical term is described.
TECH_SUMMARY = "技术栈关键词: "


def _candidates(names: Column, kind: str, status: str | None = None, seed: str = "") -> Column:
    return F.transform(
        names,
        lambda n: F.struct(
            F.lit(kind).alias("type"), n.alias("name"), F.lit(status).cast("string").alias("status"), F.concat(F.lit(seed), n).alias("seed"),
            F.lit("term" if kind == "tech" else "pattern").alias("rule"),
        ),
    )


def _compacted(names: Column, most: int = 40) -> Column:
    return F.transform(F.transform(names, strip), lambda n: compact_name(n, most, stripped=True))


def _clauses(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.concat(*(_found(text, p) for p in patterns))
    return F.filter(_compacted(found), lambda n: n != "")


def decisions(text: Column) -> Column:
    return _candidates(_clauses(text, vocab.DECISION_PATTERNS), "decision")


def preferences(text: Column) -> Column:
    return _candidates(_clauses(text, vocab.PREFERENCE_PATTERNS), "preference")


def risks(text: Column) -> Column:
    """Groups of one match are joined by a colon and cut; nothing left means the text's start."""
    def joined(pattern: str) -> Column:
        groups = range(pattern.count("(") - pattern.count("(?"))
        pairs = F.arrays_zip(*(_found(text, pattern, g + 1).alias(f"g{g}") for g in groups))
        return F.transform(pairs, lambda z: F.array_join(F.filter(F.array(*(strip(z[f"g{g}"]) for g in groups)), lambda x: x != ""), "："))

    arrays = [joined(p) for p in vocab.RISK_PATTERNS]
    names = F.transform(F.concat(*arrays), lambda n: F.when(n == "", F.substring(text, 1, 30)).otherwise(F.substring(n, 1, 40)))
    return _candidates(_compacted(names), "risk")


def tasks(text: Column) -> Column:
    done = _candidates(_clauses(text, vocab.DONE_PATTERNS), "task", "completed", "完成_")
    return F.concat(done, _candidates(_clauses(text, vocab.TODO_PATTERNS), "task", "todo", "计划_"))


def _plausible_project(name: Column) -> Column:
    return (
        F.length(name).between(2, 8)
        & ~contains_any(name, vocab.PROJECT_STRUCTURAL)
        & ~name.rlike(f"[{vocab.PROJECT_NON_NAME}]")
    )


def projects(text: Column) -> Column:
    latin, cjk, english = vocab.PROJECT_PATTERNS
    verbs = "|".join(vocab.PROJECT_VERBS)
    a = F.filter(_found(text, latin), lambda n: F.length(n) >= 3)
    b = F.filter(F.transform(_found(text, cjk), lambda n: F.regexp_replace(n, f"^(?:{verbs})(?=.)", "")), _plausible_project)
    names = F.array_distinct(F.concat(a, b, _found(text, english)))
    return _candidates(F.filter(names, lambda n: ~is_garbage_name(n)), "project")


def tech_names(text: Column) -> Column:
    """Names in order of pattern and place; spellings can recur."""

    def hits(pattern: str, least: int) -> Column:
        found = F.filter(_found(text, pattern), lambda n: F.length(n) >= least)
        return F.filter(found, lambda n: n.rlike("[0-9]")) if least == 3 else found

    return F.filter(
        F.concat(*(hits(*p) for p in vocab.TECH_PATTERNS)),
        lambda n: ~is_garbage_name(n)
        & ~F.upper(n).isin(*vocab.TECH_COMMON)
        & ~n.rlike(vocab.TECH_STRUCTURAL)
        & (F.length(F.regexp_replace(n, "[.,;:!?)]+$", "")) >= 2)
        & ~F.lower(F.regexp_replace(n, "[.,;:!?)]+$", "")).isin(*vocab.TECH_ENGLISH),
    )


def tech_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): of each text (one row per key), terms in their first spelling."""
    found = texts.select(key, F.posexplode(tech_names(F.coalesce(F.col(text), F.lit("")))).alias("place", "term"))
    low = F.lower(F.regexp_replace("term", "[.,;:!?)]+$", ""))
    return found.groupBy(key, low.alias("low")).agg(F.min_by("term", "place").alias("term")).drop("low")


def tech(text: Column) -> Column:
    return _candidates(tech_names(text), "tech")


def _first_clause(text: Column, kind: Column) -> Column:
    """The first hit of the kind's patterns, else the first clause."""

    def first(patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.get(_found(text, p), F.lit(0)) for p in patterns))

    return (
        F.when(kind == "decision", first(vocab.DECISION_PATTERNS))
        .when(kind == "preference", first(vocab.PREFERENCE_PATTERNS))
        .when(kind == "task", first(vocab.DONE_PATTERNS + vocab.TODO_PATTERNS))
        .when(kind == "risk", F.get(F.transform(risks(text), lambda r: r["name"]), F.lit(0)))
    )


def _term_like(name: Column) -> Column:
    signs = name.rlike(vocab.CJK_SIGNS)
    return ~signs & (name.rlike("^[A-Za-z]") | (name.rlike("^[一-鿿\\s]+$") & F.length(name).between(2, 8)))


def _generated(text: Column, kind: Column) -> Column:
    own = (
        F.when(kind == "decision", decisions(text))
        .when(kind == "preference", preferences(text))
        .when(kind == "risk", risks(text))
        .when(kind == "task", tasks(text))
        .otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    )
    return F.concat(own, projects(text), tech(text))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, by exploding an array of one: the optimizer would else copy a
    long expression into each place that reads its column."""
    one = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(one)).alias("__once")).select("*", "__once.*").drop("__once")


def mentions(items: DataFrame) -> DataFrame:
    """One row per item and entity; an id's first mention in a file has ``nth`` = 1.

    Raw items and garbage give none. The type comes from the tag, else from the section's
    title, else it is a fact. Order: the type's own patterns, projects, tech terms, and the
    item itself unless it only repeats its text."""
    tag_kind = section_kind = status = F.lit(None).cast("string")
    for t, k in vocab.TAG_TYPES.items():
        tag_kind = F.when(F.col("tag") == t, k).otherwise(tag_kind)
    for t, k in vocab.SECTION_TYPES.items():
        section_kind = F.when(F.col("section_title") == t, k).otherwise(section_kind)
    for t, s in vocab.TAG_STATUS.items():
        status = F.when(F.col("tag") == t, s).otherwise(status)
    text, kind = F.col("text"), F.col("kind")
    rows = items.filter(~F.col("skip_extraction") & F.col("text").isNotNull() & ~is_garbage_text(text)).withColumn(
        "kind", F.coalesce(tag_kind, section_kind, F.lit("fact"))
    )
    rows = _once(rows, hit=_first_clause(text, kind))
    rows = _once(rows, hit_clause=strip(F.coalesce("hit", F.split(text, "[。；，]", 2)[0])))
    rows = _once(rows, own=compact_name(F.col("hit_clause"), 30, stripped=True), every=_generated(text, kind))
    bare = strip(text)
    repeats = F.col("tag").isNull() & (F.length("own") >= 4) & bare.startswith(F.col("own")) & (F.length("own") > F.length(bare) * 0.8)
    whole = F.struct(
        kind.alias("type"), F.col("own").alias("name"), F.when(kind == "task", status).alias("status"), F.col("own").alias("seed"),
        F.lit("item").alias("rule"),
    )
    last = F.when(repeats | ((kind == "tech") & ~_term_like(F.col("own"))), F.array().cast(f"array<{CANDIDATE}>")).otherwise(F.array(whole))
    out = rows.select(
        "source", "date", "file_name", "section_ord", "section_title", "item_ord", "text",
        F.concat_ws(":", "file_name", "line_start", "line_end").alias("source_line"), F.posexplode(F.concat("every", last)).alias("place", "c"),
    ).filter(~is_garbage_name(F.col("c.name")))
    rule = F.col("c.rule")
    summary = F.when(rule == "term", F.concat(F.lit(TECH_SUMMARY), "c.name")).when(rule == "pattern", F.substring("text", 1, 200)).otherwise(F.substring("text", 1, 500))
    out = out.select(
        entity_id(F.col("c.type"), F.col("c.seed")).alias("id"), F.col("c.type").alias("type"), F.substring("c.name", 1, 100).alias("name"),
        summary.alias("summary"), F.col("c.status").alias("status"), "source", "date", "file_name", "section_ord",
        "section_title", "item_ord", "source_line", "place",
    )
    order = Window.partitionBy("source", "file_name", "id").orderBy("section_ord", "item_ord", "place")
    return out.withColumn("nth", F.row_number().over(order)).drop("place")
