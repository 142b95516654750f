"""Keyword, pattern and vector search over (id, name, summary, type) rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import cosine, l2, like_ascii, matching_ratio

FIELDS = ("name", "summary", "type")
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower case, marks on letters removed."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\u0300-\\u036f]", "")
    folded = F.translate(plain, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(folded, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def postings(entities: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The inverted index, to be stored: (entity_id, field, term, tf, positions, len), where
    ``len`` is the entity's number of words. Each entity has one row of an empty field and
    term besides, so that totals and lengths are read from the index alone.

    An entity's words are counted where its row lies, so no word is shuffled. Only where ids
    are found in several rows (counted first) do the words of those rows meet by id."""
    many = entities.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("many"))
    if many.isEmpty():
        return _postings_of_rows(entities, fields)
    own = F.col("id").eqNullSafe(F.col("many"))
    rows = _postings_of_rows(entities.join(many, own, "left_anti"), fields)
    met = _postings_of_rows(entities.join(many, own, "left_semi"), fields)
    once = met.filter("term <> ''").groupBy("entity_id", "field", "term").agg(
        F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("len").alias("len")
    )
    return rows.unionByName(once).unionByName(met.filter("term = ''"))


def _postings_of_rows(entities: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The index of each row by itself."""
    # Arrays of structs, exploded: the optimizer would else copy the splitting into each use of it.
    words = entities.select(F.col("id").alias("entity_id"), F.explode(F.array(F.struct(*(terms(F.col(f)).alias(f"t_{f}") for f in fields)))).alias("x")).select("entity_id", "x.*")
    words = words.withColumn("len", sum((F.size(f"t_{f}") for f in fields), F.lit(0)).cast("bigint"))
    placed = (F.sort_array(F.transform(f"t_{f}", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))) for f in fields)
    parts = F.array(F.struct(F.lit("").alias("field"), F.array().cast("array<struct<term:string,pos:int>>").alias("s")), *(F.struct(F.lit(f).alias("field"), p.alias("s")) for f, p in zip(fields, placed, strict=True)))
    each = words.select("entity_id", "len", F.explode(parts).alias("x")).select("entity_id", "len", "x.field", "x.s")
    # A term's places are a run of the sorted array.
    term = lambda i: F.get("s", i)["term"]
    places = F.sequence(F.lit(0), F.size("s") - 1)
    begins = F.filter(places, lambda i: (i == 0) | ~term(i).eqNullSafe(term(i - 1)))
    ends = F.filter(places, lambda i: (i == F.size("s") - 1) | ~term(i).eqNullSafe(term(i + 1)))

    def posting(run: Column) -> Column:
        n = run["e"] - run["b"] + 1
        return F.struct(term(run["b"]).alias("term"), n.cast("bigint").alias("tf"), F.transform(F.slice("s", run["b"] + 1, n), lambda x: x["pos"]).alias("positions"))

    runs = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), posting)
    total = F.struct(F.lit("").alias("term"), F.col("len").alias("tf"), F.array().cast("array<int>").alias("positions"))
    found = F.when(F.col("field") == "", F.array(total)).when(F.size("s") > 0, runs)
    return each.select("entity_id", "field", "len", F.explode(found).alias("x")).select("entity_id", "field", "x.term", "x.tf", "x.positions", "len")


class Query:
    """A keyword query: words are all needed; ``a OR b``, ``a NOT b``, ``"a phrase"``,
    ``pre*`` and ``field:word`` as usual. ``SyntaxError`` for anything else."""

    _PART = re.compile(r'\s*(?:(OR|NOT|AND)\b|(?:(\w+):)?(?:"([^"]*)"|([^\W_]+)(\*?)))')

    def __init__(self, text: str) -> None:
        self.groups: list[list[tuple[bool, str | None, list[str], bool]]] = [[]]
        at, negative = 0, False
        text = text.rstrip()
        if not text:
            raise SyntaxError("empty query")
        while at < len(text):
            m = self._PART.match(text, at)
            if not m:
                raise SyntaxError(text[at:])
            at = m.end()
            word, field, phrase, plain, star = m.groups()
            if word == "OR":
                self.groups.append([])
            elif word == "NOT":
                negative = True
            elif word is None:
                if field is not None and field not in FIELDS:
                    raise SyntaxError("no such column: " + field)
                words = re.findall(r"[^\W_]+", (phrase if phrase is not None else plain).lower())
                self.groups[-1].append((negative, field, words, bool(star)))
                negative = False
        if not all(any(not n for n, *_ in g) for g in self.groups):
            raise SyntaxError("nothing to look for")

    def parts(self) -> list[tuple[str | None, list[str], bool]]:
        """The parts that add to the rank: those looked for, each once."""
        out = []
        for neg, *part in (x for g in self.groups for x in g):
            if not neg and part[1] and part not in out:
                out.append(part)
        return [tuple(p) for p in out]

    def _every(self) -> list[tuple[str | None, list[str], bool]]:
        return [tuple(p) for _, *p in (x for g in self.groups for x in g) if p[1]]

    def wanted(self) -> Column:
        """Of postings: those of any word of the query."""
        out = F.lit(False)
        for field, words, star in self._every():
            for i, w in enumerate(words):
                hit = _is(F.col("term"), w, star and i == len(words) - 1)
                out = out | (hit & (F.col("field") == field) if field else hit)
        return out

    def holds(self, count) -> Column:
        """The query's condition, from ``count``, a part's number of places in an entity."""
        out = F.lit(False)
        for g in self.groups:
            every = F.lit(True)
            for neg, field, words, star in g:
                if words:
                    n = count((field, words, star))
                    every = every & ((n == 0) if neg else (n > 0))
            out = out | every
        return out


def _is(term: Column, word: str, star: bool) -> Column:
    return term.startswith(word) if star else term == word


def _places_in_found(part: tuple) -> Column:
    """How often a part stands in ``found``, an entity's postings as an array."""
    field, words, star = part

    def starts(i: int, w: str) -> Column:
        def right(x: Column) -> Column:
            hit = _is(x["term"], w, star and i == len(words) - 1)
            return hit & (x["field"] == field) if field else hit

        return F.flatten(F.transform(F.filter("found", right), lambda x: F.transform(x["positions"], lambda p: F.struct(x["field"], p - i))))

    both = starts(0, words[0])
    for i, w in enumerate(words[1:], 1):
        both = F.array_intersect(both, starts(i, w))
    return F.size(both)


def _places_in_terms(part: tuple, fields: tuple[str, ...]) -> Column:
    """How often a part stands in the fields' word arrays ``t_<field>``."""
    field, words, star = part

    def inside(f: str) -> Column:
        own = F.col(f"t_{f}")
        if len(words) == 1:
            return F.size(F.filter(own, lambda t: _is(t, words[0], star)))

        # The array beside itself, moved on by one word and more.
        moved = F.arrays_zip(*(F.slice(own, k + 1, F.greatest(F.size(own) - k, F.lit(0))).alias(f"w{k}") for k in range(len(words))))

        def begins(x: Column) -> Column:
            out = F.lit(True)
            for k, w in enumerate(words):
                out = out & F.coalesce(_is(x[f"w{k}"], w, star and k == len(words) - 1), F.lit(False))
            return out

        return F.size(F.filter(moved, begins))

    return sum((inside(f) for f in ((field,) if field else fields)), F.lit(0))


def _ranked(rows: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    """(entity_id, rank) from rows of (entity_id, len, n0, n1, ...) that satisfy the query and
    the one row of totals (docs, words, d0, d1, ...)."""
    rank = F.lit(0.0)
    for i in range(parts):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        idf = F.greatest(F.log((F.col("docs") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        rank = rank + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("len") / (F.col("words") / F.col("docs"))))
    return rows.crossJoin(F.broadcast(totals)).select("entity_id", rank.alias("rank"))  # one row


def bm25(index: DataFrame, query: str) -> DataFrame:
    """(entity_id, rank) from a stored index: entities that satisfy the query; the greater the
    rank the better. A part in half of all rows or more weighs next to nothing. Only the rows
    of the query's words, and one row per entity, are read."""
    parsed = Query(query)
    parts = parsed.parts()
    found = index.filter(parsed.wanted()).groupBy("entity_id").agg(F.collect_list(F.struct("field", "term", "positions")).alias("found"), F.max("len").alias("len"))
    found = found.withColumn("ok", parsed.holds(_places_in_found)).select("entity_id", "len", "ok", *(_places_in_found(p).alias(f"n{i}") for i, p in enumerate(parts)))
    totals = index.filter("term = ''").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("words"))
    holding = found.agg(*(F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(parts))))
    return _ranked(found.filter("ok"), totals.crossJoin(holding), len(parts))


def bm25_scan(entities: DataFrame, query: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The same without an index, in two passes over the texts and without a shuffle of words."""
    parsed = Query(query)
    parts = parsed.parts()
    # One array, exploded: the optimizer would else copy the splitting into each use of it.
    once = F.explode(F.array(F.struct(*(terms(F.col(f)).alias(f"t_{f}") for f in fields)))).alias("x")
    words = entities.select(F.col("id").alias("entity_id"), once).select("entity_id", "x.*")
    rows = words.select(
        "entity_id", sum((F.size(f"t_{f}") for f in fields), F.lit(0)).alias("len"), parsed.holds(lambda p: _places_in_terms(p, fields)).alias("ok"),
        *(_places_in_terms(p, fields).alias(f"n{i}") for i, p in enumerate(parts)),
    )
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("words"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(parts))))
    return _ranked(rows.filter("ok"), totals, len(parts))


def like(entities: DataFrame, query: str) -> DataFrame:
    return entities.filter(like_ascii(F.col("name"), query) | like_ascii(F.col("summary"), query))


def keyword(pool: DataFrame, query: str, limit: int, index: DataFrame | None = None, all_rows: DataFrame | None = None) -> DataFrame:
    """Top rows of ``pool`` by BM25 with ``rank``; where the query is no keyword query or is
    found in no row at all, rows that hold it as text, by importance. Ranks are those among
    ``all_rows`` (``pool`` by default), whose stored ``index`` is read where there is one;
    rows outside the pool are left out before the limit."""
    try:
        ranks = bm25(index, query) if index is not None else bm25_scan(all_rows if all_rows is not None else pool, query)
        if not ranks.isEmpty():
            return pool.join(ranks.withColumnRenamed("entity_id", "id"), "id").orderBy(F.desc("rank"), "id").limit(limit)
    except SyntaxError:
        pass
    return like(pool, query).withColumn("rank", F.lit(0.0)).orderBy(F.desc("importance"), "id").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int, metric: str = "cosine", id_column: str = "entity_id", column: str = "embedding") -> DataFrame:
    """(id, value): greatest cosine or least L2 distance first. A pass with a bounded heap."""
    wanted = F.array(*(F.lit(float(x)).cast("float") for x in query))
    value = cosine(F.col(column), wanted) if metric == "cosine" else l2(F.col(column), wanted)
    order = F.desc("value") if metric == "cosine" else F.asc("value")
    return vectors.select(id_column, value.alias("value")).orderBy(order, id_column).limit(limit)


def similarity_score(query: str, name: str = "name", summary: str = "summary", importance: str = "importance") -> Column:
    """Half the importance, three tenths the ratio to the name, two tenths for the query in
    the summary; at most 1."""
    q = query.lower()
    ratio = matching_ratio(F.lit(q), F.lower(name))
    inside = F.lower(F.coalesce(F.col(summary), F.lit(""))).contains(q).cast("double")
    return F.least(F.lit(1.0), 0.5 * F.col(importance) + 0.3 * ratio + 0.2 * inside)
