"""Edges between mentions of one file, and similar names across files."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook import vocab
from daybook.functions.text import contains_any, cosine, matching_ratio, tokens
from daybook.sources.scratch import kept


def relation(a: str, b: str, kind: Column, weight: Column, evidence: Column) -> list[Column]:
    return [
        F.format_string("rel:%s->%s:%s", F.col(a), F.col(b), kind).alias("id"),
        F.col(a).alias("from_entity"), F.col(b).alias("to_entity"), kind.alias("rel_type"), weight.alias("weight"), evidence.alias("evidence"),
    ]


def _eligible(a: Column, b: Column) -> Column:
    pair = F.array_join(F.array_sort(F.array(a, b)), "|")
    return pair.isin(*("|".join(sorted(p)) for p in vocab.CO_OCCURRENCE))


def section_links(mentions: DataFrame, most: int = vocab.MAX_RELATIONS_PER_FILE) -> DataFrame:
    """Pairs inside one section of one file: a name inside the other's summary (0.5), two
    or more tokens in common (0.5), or a pair of types that go together (0.3); the first rule
    that holds. ``mentions`` has file, section, ord, id, type, name, summary.

    A file's pairs are bounded by its section sizes, and its edges by ``most``, in order. The
    limit is a rank's, which the optimizer also takes before the shuffle, so that a task never
    receives more than ``most`` edges of a file from another."""
    own = mentions.withColumn("tokens", tokens(F.concat_ws(" ", "name", "summary"))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("file", "section").orderBy("ord", "id"))
    )
    a, b = (own.select("file", "section", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "type", "name", "summary", "tokens", "rank"))) for s in "ab")
    pairs = a.join(b, ["file", "section"]).filter("a_rank < b_rank AND a_id <> b_id")
    named = F.col("a_summary").contains(F.col("b_name")) | F.col("b_summary").contains(F.col("a_name"))
    shared = F.array_sort(F.array_intersect("a_tokens", "b_tokens"))
    rule = F.when(named, "name_mention").when(F.size(shared) >= 2, F.concat(F.lit("shared_tokens: "), F.array_join(shared, ",")))
    rule = rule.when(_eligible(F.col("a_type"), F.col("b_type")), "co_occurrence")
    pairs = pairs.withColumn("evidence", rule).filter("evidence IS NOT NULL")
    order = Window.partitionBy("file").orderBy("section", "a_rank", "b_rank")
    pairs = pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    weight = F.when(F.col("evidence") == "co_occurrence", 0.3).otherwise(0.5)
    return pairs.select("file", *relation("a_id", "b_id", F.lit("RELATES_TO"), weight, F.col("evidence")))


def contradictions(mentions: DataFrame) -> DataFrame:
    """Decisions of one file that take opposing stances and share a token."""
    own = mentions.filter("type = 'decision'").withColumn("tokens", tokens(F.concat_ws(" ", "name", "summary")))
    low = F.lower("summary")
    own = own.withColumns({f"{w}{k}": contains_any(low, words) for k, pair in enumerate(vocab.STANCES) for w, words in zip("pn", pair, strict=True)})
    flags = [f"{w}{k}" for k in range(len(vocab.STANCES)) for w in "pn"]
    own = own.filter(" OR ".join(flags))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("section", "ord", "id")))
    a, b = (own.select("file", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "tokens", "rank", *flags))) for s in "ab")
    opposed = F.lit(False)
    for k in range(len(vocab.STANCES)):
        opposed = opposed | (F.col(f"a_p{k}") & F.col(f"b_n{k}")) | (F.col(f"a_n{k}") & F.col(f"b_p{k}"))
    shared = F.array_sort(F.array_intersect("a_tokens", "b_tokens"))
    pairs = a.join(b, "file").filter("a_rank < b_rank AND a_id <> b_id").filter(opposed & (F.size(shared) >= 1))
    evidence = F.concat(F.lit("opposing_stance: "), F.array_join(F.slice(shared, 1, 3), ","))
    return pairs.select("file", *relation("a_id", "b_id", F.lit("CONTRADICTS"), F.lit(0.7), evidence))


#: So many names are sent to the texts; more are met through their rarest three letters.
SENT_NAMES = 2_000


def searchable(names: DataFrame) -> DataFrame:
    """Of (id, name), those long and special enough to be searched for inside texts."""
    return names.filter((F.length("name") >= vocab.MIN_PROJECT_NAME) & ~F.col("name").isin(*vocab.PROJECT_BLOCKLIST))


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def names_inside(texts: DataFrame, names: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """``texts`` joined with ``names`` (id, name) that stand in one of their ``fields``, whatever
    the case. Names are counted first: few go to all texts; many meet only the texts that
    hold the name's rarest three letters. Names have three letters or more."""
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    inside = reduce(or_, (x.contains(F.col("__name")) for x in low))
    own = names.select("id", F.lower("name").alias("__name"))
    if own.count() <= SENT_NAMES:
        return texts.join(F.broadcast(own), inside).drop("__name")
    own = own.withColumn("__gram", F.explode(_grams(F.col("__name"), 3)))
    held = texts.withColumn("__gram", F.explode(F.array_distinct(F.concat(*(_grams(x, 3) for x in low)))))
    often = held.join(own.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    own = own.join(often, "__gram", "left").groupBy("id", "__name").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__gram")).alias("__rarest"))
    own = own.select("id", "__name", F.col("__rarest.__gram").alias("__gram"))
    return held.join(own, "__gram").filter(inside).drop("__gram", "__name")


def dependencies(entities: DataFrame, projects: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Entities of other types whose name or summary holds a project's name (0.8), with the
    columns ``carried`` of the entities before them."""
    own = entities.filter("type <> 'project'").select(*carried, F.col("id").alias("e_id"), F.col("name").alias("e_name"), "summary")
    pairs = names_inside(own, searchable(projects.select("id", "name")), ("e_name", "summary")).filter("e_id <> id")
    return pairs.select(*carried, *relation("e_id", "id", F.lit("DEPENDS_ON"), F.lit(0.8), F.lit("name_mention")))


def _shared_at_least(length: Column, threshold: float) -> Column:
    """How many two-letter grams a name shares with any name that matches it by ``threshold``.

    M letters match in at most la + lb - 2M + 1 runs, each of which costs one gram; and the
    other name is at least t / (2 - t) as long."""
    whole = (1.5 * threshold - 1) * (1 + threshold / (2 - threshold))
    return F.greatest(F.lit(1), F.ceil(length * F.lit(whole) - 1 - 1e-9)).cast("int")


def similar_names(entities: DataFrame, threshold: float = 0.85, days: int = 30, of: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, ratio) of one type first seen within ``days`` of one another whose names
    match by ``threshold`` whatever their case, a the earlier; b among ``of`` (type, id) where
    given.

    A name is listed under its rarest grams only, as many as must hold one that the two
    share, so that grams that many names have bring nobody together; lists are cut by spans
    of days. At 0.85 no pair is lost; at lower thresholds short names can match without a
    gram in common, and such pairs are passed over."""
    own = entities.select("id", "type", F.lower("name").alias("name"), "first_seen").withColumn("len", F.length("name")).filter("len > 0")
    n = F.greatest(F.col("len") - 1, F.lit(1))
    own = own.withColumn("all", F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("name", i, 2)))
    # A gram that a name has twice is two: the k-th time counts with the k-th time elsewhere.
    numbered = F.transform("all", lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice("all", 1, i), lambda x: x == g)).cast("string")))
    listed = own.withColumn("gram", F.explode(numbered)).drop("all")
    often = listed.groupBy("type", "gram").agg(F.count(F.lit(1)).alias("times"))
    rarest = Window.partitionBy("id", "type", "name", "first_seen").orderBy("times", "gram")
    prefix = n - _shared_at_least(F.col("len"), threshold) + 1
    listed = listed.join(often, ["type", "gram"]).withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= prefix)
    listed = listed.withColumn("span", F.floor(F.datediff("first_seen", F.lit("1970-01-01").cast("date")) / (days + 1)))
    cols = ("id", "name", "first_seen", "len")
    a = listed.select("type", "gram", F.explode(F.array("span", F.col("span") + 1)).alias("span"), *(F.col(c).alias(f"a_{c}") for c in cols))
    if of is not None:
        listed = listed.join(of.select("type", "id"), ["type", "id"], "left_semi")
    b = listed.select("type", "gram", "span", *(F.col(c).alias(f"b_{c}") for c in cols))
    earlier = F.struct("a_first_seen", "a_id") < F.struct("b_first_seen", "b_id")
    near = F.datediff("b_first_seen", "a_first_seen").between(0, days)
    sizes = 2 * F.least("a_len", "b_len") >= threshold * (F.col("a_len") + F.col("b_len"))
    pairs = a.join(b, ["type", "gram", "span"]).filter(earlier & near & sizes).select(*(f"{s}_{c}" for s in "ab" for c in ("id", "name"))).distinct()
    return pairs.withColumn("ratio", matching_ratio("b_name", "a_name")).filter(F.col("ratio") >= threshold).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), "ratio"
    )


#: Names up to this length are also met by two letters left out, longer ones by grams.
SHORT_NAME = 20


def _left_out(name: Column) -> Column:
    """The name, and the name without each one of its letters."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.overlay(name, F.lit(""), i, F.lit(1)))))


def _pairs_left_out(own: DataFrame, sought: DataFrame, letters: int, threshold: float, days: int) -> DataFrame:
    """Pairs of ``own`` (a) and ``sought`` (b) that are equal where each leaves out up to
    ``letters``, a the earlier, with b's ``ratio``. Lists hold different names that are so much
    alike, so their lengths do not follow the number of rows."""

    def listed(df: DataFrame, spans: Column) -> DataFrame:
        rest = _left_out(F.col("name"))
        for _ in range(letters - 1):
            rest = F.array_distinct(F.flatten(F.transform(rest, _left_out)))
        # The other name is at least as long as what is left.
        rest = F.filter(rest, lambda v: 2 * F.length(v) >= threshold * (F.length(v) + F.col("len")) - 1e-9)
        cut = df.select("type", "id", "day", "len", spans.alias("span"), F.explode(rest).alias("rest"))
        return cut.select("type", "id", "day", "len", F.length("rest").alias("left"), F.xxhash64("type", "span", "rest").alias("key"))

    span = F.floor(F.col("day") / (days + 1))
    first = own.agg(F.min(span)).first()[0]
    a = listed(own, span).select("key", *(F.col(c).alias(f"a_{c}") for c in ("type", "id", "day", "len")))
    spans = sought.withColumn("at", F.explode(F.filter(F.array(span, span - 1), lambda x: x >= F.lit(first))))
    b = listed(spans, F.col("at")).select("key", "left", *(F.col(c).alias(f"b_{c}") for c in ("type", "id", "day", "len")))
    earlier = (F.struct("a_day", "a_id") < F.struct("b_day", "b_id")) & (F.col("a_day") >= F.col("b_day") - days) & (F.col("a_type") == F.col("b_type"))
    alike = 2 * F.col("left") >= threshold * (F.col("a_len") + F.col("b_len")) - 1e-9
    # Merged, as exploded rows are many more than the planner takes them for when it broadcasts.
    pairs = a.join(b.hint("merge"), "key").filter(earlier & alike).select(F.col("a_type").alias("type"), "a_id", "b_id").distinct()
    for s, df in (("a", own), ("b", sought)):
        pairs = pairs.join(df.select("type", F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name")).hint("merge"), ["type", f"{s}_id"])
    return pairs.select("type", F.col("a_id").alias("a"), F.col("b_id").alias("b"), matching_ratio("b_name", "a_name").alias("ratio")).filter(F.col("ratio") >= threshold)


def nearest_earlier(entities: DataFrame, threshold: float = 0.85, days: int = 30) -> DataFrame:
    """Of ``similar_names``, for each b the pair of the greatest ratio, and among those the one
    of the least a, without making the others: (a, b, ratio).

    Equal names of one day are one, known by its least id, and equal names meet first. Then
    names meet that are equal but for one letter on each side, then two (short names): a b
    goes on only while a name of a length that is there could match it as well as the best
    found. What is left meets through rare grams."""
    own = entities.select("id", "type", F.lower("name").alias("name"), "first_seen").filter("length(name) > 0 AND first_seen IS NOT NULL")
    before = Window.partitionBy("type", "name").orderBy("day").rangeBetween(-days, -1)
    one = own.groupBy("type", "name", "first_seen").agg(F.min("id").alias("id"))
    one = one.withColumns({"day": F.datediff("first_seen", F.lit("1970-01-01").cast("date")), "len": F.length("name")})
    one = kept(one.withColumn("same", F.min("id").over(before)))
    equal = own.join(one.select("type", "name", "first_seen", "same", F.col("id").alias("least")).hint("merge"), ["type", "name", "first_seen"])
    equal = equal.withColumn("a", F.least(F.when(F.col("least") < F.col("id"), F.col("least")), "same")).filter("a IS NOT NULL")
    equal = equal.select("a", F.col("id").alias("b"), F.lit(1.0).alias("ratio")).distinct()
    lengths = one.groupBy("type").agg(F.collect_set("len").alias("lengths"))
    sought = one.filter("same IS NULL").join(lengths, "type")
    best = None
    for letters in (1, 2, None):
        if letters is None:
            found = similar_names(one, threshold, days, sought)
            found = found.join(sought.select("type", F.col("id").alias("b")), "b")
        else:
            most = SHORT_NAME if letters > 1 else 2**31 - 1
            mine = one.filter(F.col("len") <= most).join(sought.select("type").distinct(), "type", "left_semi")
            found = _pairs_left_out(mine, sought.filter(F.col("len") <= most), letters, threshold, days)
        best = found if best is None else best.unionByName(found)
        best = kept(best.groupBy("type", "b").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "a")).alias("x")).select("type", "b", F.col("x.a").alias("a"), (-F.col("x.r")).alias("ratio")))
        if letters is None:
            break

        def could(other: Column, done: int = letters) -> Column:
            """The greatest ratio of a pair that did not meet: the longer one keeps more out."""
            longer, shorter = F.greatest(other, "len"), F.least(other, "len")
            out = done + 1 if done == 1 else F.when(longer <= SHORT_NAME, done + 1).otherwise(2)
            return 2 * F.least(shorter, longer - out) / (other + F.col("len"))

        reached = F.greatest(F.coalesce("ratio", F.lit(0.0)), F.lit(threshold)) - 1e-9
        after = sought.join(best.select("type", F.col("b").alias("id"), "ratio").hint("merge"), ["type", "id"], "left")
        sought = kept(after.filter(F.exists("lengths", lambda x: could(x) >= reached)).drop("ratio"))
        if sought.isEmpty():
            break
    return equal.unionByName(best.select("a", "b", "ratio"))


def confirmed_by_vectors(pairs: DataFrame, vectors: DataFrame, sure: float = 0.85, least: float = 0.85) -> DataFrame:
    """Of pairs (a, b, ratio), those that match by ``sure`` and those below it whose vectors
    (entity_id, embedding) have a cosine of at least ``least``."""
    own = vectors.select(F.col("entity_id").alias("id"), "embedding")
    doubtful = pairs.filter(F.col("ratio") < sure)
    for s in "ab":
        doubtful = doubtful.join(own.select(F.col("id").alias(s), F.col("embedding").alias(f"v{s}")), s)
    alike = doubtful.filter(cosine(F.col("va"), F.col("vb")) >= least)
    return pairs.filter(F.col("ratio") >= sure).unionByName(alike.select("a", "b", "ratio"))


def merge_map(pairs: DataFrame) -> DataFrame:
    """(id, canonical): each id with a similar earlier one goes to its earliest. Pairs point
    to earlier ids and are followed, twice as far each time, until nothing moves."""
    best = Window.partitionBy("b").orderBy(F.desc("ratio"), "a")
    step = pairs.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select(F.col("b").alias("id"), F.col("a").alias("canonical"))
    # Each round's result is stored: the next one reads it three times.
    out = kept(step)
    while True:
        up = out.select(F.col("id").alias("canonical"), F.col("canonical").alias("next"))
        moved = kept(out.join(up, "canonical", "left").select("id", F.coalesce("next", "canonical").alias("canonical"), "next"))
        out = moved.drop("next")
        if moved.filter("next IS NOT NULL").isEmpty():
            return out
