"""Registered queries of the tools, on the driver's tables as a store would hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import maintain, rollup, search, stats
from daybook.plans import tables as t
from daybook.plans.consolidate import embed_missing
from daybook.plans.queries import LOW, query
from daybook.plans.tools import Knowledge, described
from daybook.sources import embeddings
from daybook.sources.store import upsert

D = t.TODAY
KNOWN, REL, NOTE = t.KNOWN_SQL, t.RELATIONS_SQL, t.NOTES_SQL
ROOT = "3-MEDIUM:400"
#: Words of every field, as the index has them.
FOLD = "regexp_extract_all(translate(regexp_replace(lower({}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{{L}}\\p{{N}}]+')"


def _knowledge(spark: SparkSession, sf: str, embedder=None) -> Knowledge:
    return Knowledge(t.Snapshot(entities=t.known(spark, sf), relations=t.relations(spark, sf)), D, embedder=embedder)


def _words(table: str) -> str:
    return (
        f"wn AS (SELECT id, {FOLD.format('name')} AS a, {FOLD.format('summary')} AS b, {FOLD.format('type')} AS c FROM {table}), "
        "wl AS (SELECT id, a || b || c AS w, len(a) + len(b) + len(c) AS len FROM wn)"
    )


def _rank(first: str, second: str) -> str:
    """CTEs up to ``rk`` (id, rank): rows of both words by BM25."""
    part = "greatest(ln((docs - d{0} + 0.5) / (d{0} + 0.5)), 1e-6) * n{0} * 2.2 / (n{0} + 1.2 * (0.25 + 0.75 * len / (words / docs)))"
    return (
        f"nn AS (SELECT id, len, len(list_filter(w, lambda x: x = '{first}')) AS n0, len(list_filter(w, lambda x: x = '{second}')) AS n1 FROM wl), "
        "tt AS (SELECT count(*) AS docs, sum(len)::DOUBLE AS words, count(*) FILTER (n0 > 0) AS d0, count(*) FILTER (n1 > 0) AS d1 FROM nn), "
        f"rk AS (SELECT id, 0.0::DOUBLE + {part.format(0)} + {part.format(1)} AS rank FROM nn, tt WHERE n0 > 0 AND n1 > 0)"
    )


SCORE = t.score_sql()
PASSED = "NOT (type = 'project' AND day_count < 2)"


@query(
    f"WITH {KNOWN}, {_words('kn')}, {_rank('decision', '12')}, pool AS (SELECT kn.*, {SCORE} AS score FROM kn WHERE {PASSED} AND {SCORE} >= 0.2 AND type = 'decision' AND source = 'F'), "
    "cd AS (SELECT pool.*, rank FROM pool JOIN rk USING (id) ORDER BY rank DESC, id LIMIT 75) "
    "SELECT id, type, round(score, 6) AS score, round(rank, 6) AS rank FROM cd ORDER BY score DESC, rank DESC, id LIMIT 20 OFFSET 5"
)
def search_page(spark, sf):
    """A page of keyword hits: type, source, gate and least score before the limits."""
    out = _knowledge(spark, sf).hits("decision 12", entity_type="decision", source="F", max_results=20, min_score=0.2, offset=5)
    return out.select("id", "type", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"))


@query(
    f"WITH {KNOWN}, pool AS (SELECT kn.*, {SCORE} AS score FROM kn WHERE {PASSED}), "
    f"cd AS (SELECT * FROM pool WHERE {LOW.format('name')} LIKE '%9%3-%' OR {LOW.format('summary')} LIKE '%9%3-%' ORDER BY importance DESC, id LIMIT 300) "
    "SELECT id, round(score, 6) AS score FROM cd ORDER BY score DESC, id LIMIT 100"
)
def search_as_text(spark, sf):
    """No keyword query, so rows that hold it as text, by importance."""
    out = _knowledge(spark, sf).hits("9%3-", max_results=100)
    return out.select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH {KNOWN}, {REL}, {_words('kn')}, {_rank('risk', '2000')}, cd AS (SELECT kn.*, {SCORE} AS score, rank FROM kn JOIN rk USING (id) WHERE {PASSED} ORDER BY rank DESC, id LIMIT 30), "
    "pg AS (SELECT * FROM cd ORDER BY score DESC, rank DESC, id LIMIT 10), n AS (SELECT node, other, max(weight) AS w FROM ends WHERE node <> other GROUP BY 1, 2), "
    "r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS i FROM n), "
    "g AS (SELECT node, string_agg(other, ',' ORDER BY i) AS related FROM r WHERE i <= 5 GROUP BY node) "
    "SELECT id AS entity_id, name, type, substr(summary, 1, 200) AS summary, round(score, 6) AS score, round(importance, 6) AS importance, first_seen, last_seen, "
    "coalesce(related, '') AS related_entities FROM pg LEFT JOIN g ON g.node = pg.id"
)
def search_results(spark, sf):
    """Hits as the tool gives them, with their heaviest neighbours."""
    out = _knowledge(spark, sf).knowledge_search("risk 2000").drop("similarity_score")
    return out.withColumns({"related_entities": F.array_join("related_entities", ","), "score": F.round("score", 6), "importance": F.round("importance", 6)})


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "embeddings").select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("entity_id"), "embedding", "label", "vec_id")


@query(
    f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), pool AS (SELECT 'vec:' || vec_id AS id, embedding, DATE '{D}' - (vec_id % 40)::INT AS last_seen FROM embeddings WHERE label = 3), "
    f"sc AS (SELECT *, greatest(0, 1 - date_diff('day', last_seen, DATE '{D}') / 30.0) * 0.15 AS score FROM pool), "
    "cd AS (SELECT id, score, list_cosine_similarity(embedding::DOUBLE[], q) AS rank FROM sc, q WHERE score >= 0.02 ORDER BY rank DESC, id LIMIT 18) "
    "SELECT id, round(score, 6) AS score, round(rank, 6) AS rank FROM cd ORDER BY score DESC, rank DESC, id LIMIT 5 OFFSET 1"
)
def search_page_vectors(spark, sf):
    """Nearest vectors of one type only: the filters come before the limit."""
    v = _vectors(spark, sf)
    first = v.filter("vec_id = 0").first().embedding
    e = v.select(
        F.col("entity_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("type"), F.col("entity_id").alias("name"), F.lit("").alias("summary"),
        F.lit(0.5).alias("importance"), F.date_sub(F.lit(D), (F.col("vec_id") % 40).cast("int")).alias("last_seen"), F.lit(0).cast("bigint").alias("day_count"),
    )
    know = Knowledge(t.Snapshot(entities=e, relations=t.relations(spark, sf), vectors=v.select("entity_id", "embedding")), D, embedder=lambda texts: [first for _ in texts])
    return know.hits("anything", entity_type="t3", max_results=5, min_score=0.02, offset=1).select("id", F.round("score", 6).alias("score"), F.round("rank", 6).alias("rank"))


@query(
    f"WITH {NOTE}, {_words('note')}, {_rank('license', 'version')} SELECT id, round(rank, 6) AS rank FROM note JOIN rk USING (id) ORDER BY round(rank, 9) DESC, id LIMIT 10"
)
def keyword_top10(spark, sf):
    return search.keyword(t.notes(spark, sf), "license version", 10).select("id", F.round("rank", 6).alias("rank"))


@query(
    f"WITH {NOTE}, {_words('note')}, f AS (SELECT id, 'name' AS field, unnest(a) AS term FROM wn UNION ALL SELECT id, 'summary', unnest(b) FROM wn UNION ALL SELECT id, 'type', unnest(c) FROM wn) "
    "SELECT id AS entity_id, field, term, count(*)::BIGINT AS tf FROM f GROUP BY 1, 2, 3 UNION ALL SELECT id, '', '', len FROM wl"
)
def keyword_index(spark, sf):
    """The whole inverted index of the notes."""
    return search.postings(t.notes(spark, sf)).select("entity_id", "field", "term", "tf")


@query(
    f"WITH {NOTE}, {_words('note')}, {_rank('license', 'version')} SELECT id AS entity_id, round(rank, 6) AS rank FROM rk"
)
def bm25_from_index(spark, sf):
    """The same ranks as those of a scan, from the index."""
    return search.bm25(search.postings(t.notes(spark, sf)), "license version").select("entity_id", F.round("rank", 6).alias("rank"))


@query(
    f"WITH {KNOWN}, {_words('kn')}, {_rank('customer', '400')} SELECT '{ROOT}' AS topic, '{ROOT}' AS id UNION ALL SELECT 'customer 400', (SELECT id FROM rk ORDER BY rank DESC, id LIMIT 1) "
    f"UNION ALL SELECT '%40 %', (SELECT id FROM kn WHERE {LOW.format('name')} LIKE '%%40 %%' OR {LOW.format('summary')} LIKE '%%40 %%' ORDER BY importance DESC, id LIMIT 1) UNION ALL SELECT 'nothing-here', NULL"
)
def resolve_topics(spark, sf):
    """What a topic names: an id, the first keyword hit, the first row that holds it as text."""
    know = _knowledge(spark, sf)
    topics = (ROOT, "customer 400", "%40 %", "nothing-here")
    return spark.createDataFrame([(x, know.resolve(x)) for x in topics], "topic string, id string")


_NEAR = f"b AS (SELECT '{ROOT}' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN ends USING (node) WHERE depth < 2), v AS (SELECT node AS id, min(depth)::INT AS depth FROM b GROUP BY node)"


@query(f"WITH RECURSIVE {KNOWN}, {REL}, {_NEAR} SELECT first_seen AS date, id, substr(summary, 1, 200) AS summary FROM kn JOIN v USING (id)")
def trace_timeline(spark, sf):
    """All that stands around a topic, by first day."""
    return _knowledge(spark, sf).knowledge_trace(ROOT)["timeline"]


@query(f"WITH RECURSIVE {KNOWN}, {REL}, {_NEAR} SELECT depth AS place, id, last_seen AS date, substr(summary, 1, 200) AS content FROM kn JOIN v USING (id) WHERE type = 'decision'")
def trace_decisions(spark, sf):
    return _knowledge(spark, sf).knowledge_trace(ROOT)["decisions"]


@query(f"WITH {KNOWN} SELECT id AS entity_id, type, name, summary, round(importance, 6) AS importance, day_count FROM kn WHERE id = '{ROOT}'")
def trace_entity(spark, sf):
    out = _knowledge(spark, sf).knowledge_trace(ROOT)["entity"]
    return out.select("entity_id", "type", "name", "summary", F.round("importance", 6).alias("importance"), "day_count")


@query(
    f"WITH {KNOWN}, p AS (SELECT * FROM kn WHERE type = 'project' AND {PASSED} AND last_seen >= DATE '{D}' - 30), "
    "k AS (SELECT p.id, e.id AS cid, row_number() OVER (PARTITION BY p.id ORDER BY e.importance DESC, e.id) AS i FROM p JOIN kn e ON e.type = 'task' AND e.status <> 'completed' AND contains(lower(e.name || e.summary), lower(p.name))) "
    "SELECT p.id, p.name, p.last_seen, p.day_count, CASE WHEN p.day_count >= 3 THEN 'active' ELSE 'recent' END AS status, coalesce(string_agg(cid, ',' ORDER BY i) FILTER (i <= 5), '') AS open_tasks "
    "FROM p LEFT JOIN k USING (id) GROUP BY p.id, p.name, p.last_seen, p.day_count"
)
def active_projects_tool(spark, sf):
    """Projects of the last thirty days with the open tasks that name them."""
    know = _knowledge(spark, sf)
    return know.active_projects(30, only_open=True).select("id", "name", "last_seen", "day_count", "status", F.array_join("open_tasks", ",").alias("open_tasks"))


@query(f"WITH {KNOWN} SELECT id, name, summary AS content, round(importance, 6) AS strength, first_seen, day_count FROM kn WHERE type = 'preference' AND contains(lower(name || summary), 'customer 1') AND lower(domain) = 'work'")
def preferences_tool(spark, sf):
    out = _knowledge(spark, sf).preference_lookup("Customer 1", "WORK")
    return out.select("id", "name", "content", F.round("strength", 6).alias("strength"), "first_seen", "day_count")


@query(f"WITH {KNOWN} SELECT id, round(importance, 6) AS importance FROM kn WHERE type = 'risk' ORDER BY importance DESC, id LIMIT 25")
def entities_by_type(spark, sf):
    """A report of the most important of a type."""
    return _knowledge(spark, sf).by_type("risk").limit(25).select("id", F.round("importance", 6).alias("importance"))


@query(f"WITH {KNOWN} SELECT id, type, day_count FROM kn WHERE id IN (SELECT '5-LOW:' || c_custkey FROM customer WHERE c_acctbal > 0)")
def entities_by_ids(spark, sf):
    wanted = t.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("5-LOW:"), F.col("c_custkey").cast("string")).alias("id"))
    return _knowledge(spark, sf).by_ids(wanted).select("id", "type", "day_count")


@query(f"WITH {REL} SELECT DISTINCT id, from_entity, to_entity FROM ends WHERE node = '{ROOT}'")
def entity_resource(spark, sf):
    """The edges that an entity's resource shows."""
    return _knowledge(spark, sf).entity(ROOT)[1].select("id", "from_entity", "to_entity")


@query(f"WITH {t.MANIFEST_SQL} SELECT date, source, entity_count FROM man WHERE date = DATE '2024-01-05'")
def day_resource(spark, sf):
    import datetime as dt

    know = Knowledge(t.Snapshot(entities=t.known(spark, sf), relations=t.relations(spark, sf), manifest=t.manifest(spark, sf)), D)
    return know.day(dt.date(2024, 1, 5)).select("date", "source", "entity_count")


@query(f"WITH {KNOWN}, {REL} SELECT (SELECT count(*) FROM kn)::BIGINT AS entities, (SELECT count(*) FROM rel)::BIGINT AS relations, (SELECT count(*) FROM embeddings)::BIGINT AS vectors")
def stats_totals(spark, sf):
    return _with_all(spark, sf).knowledge_stats()["totals"]


@query(f"WITH {KNOWN} SELECT source, count(*)::BIGINT AS cnt FROM kn GROUP BY source")
def stats_by_source(spark, sf):
    return _with_all(spark, sf).knowledge_stats()["by_source"]


def _with_all(spark: SparkSession, sf: str) -> Knowledge:
    tables = {"entities": t.known(spark, sf), "relations": t.relations(spark, sf), "manifest": t.manifest(spark, sf), "vectors": _vectors(spark, sf)}
    return Knowledge(t.Snapshot(**tables), D)


@query(f"WITH {KNOWN} SELECT id AS entity_id, substr(summary, 1, 500) AS summary, source, domain, status FROM kn")
def described_entities(spark, sf):
    out = described(t.known(spark, sf))
    return out.select("entity_id", "summary", *(F.col("metadata")[k].alias(k) for k in ("source", "domain", "status")))


# --- maintenance -----------------------------------------------------------------------


def _noisy_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The notes' first words as names of facts and terms, and the projects of the orders."""
    word = F.upper(F.split("name", " ")[0])
    n = t.notes(spark, sf).select("id", "doc_id", word.alias("w"))
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("09:30 UTC "), "w")).when(k == 1, F.concat(F.lit("[09:30] "), "w")).when(k == 2, F.concat("w", F.lit(" Backup"))).when(
        k == 3, F.when(F.col("doc_id") % 2 == 0, "json").otherwise(F.col("w"))
    ).otherwise(F.when(F.col("doc_id") % 2 == 0, "2024-05").otherwise("p1"))
    own = n.select("id", F.when(k < 3, "fact").otherwise("tech").alias("type"), name.alias("name"), F.lit(None).cast("date").alias("last_seen"), F.lit(1).cast("bigint").alias("day_count"))
    return own.unionByName(t.entities(spark, sf).select("id", "type", "name", "last_seen", "day_count"))


@query(
    f"WITH {t.ENTITIES_SQL}, {NOTE}, n AS (SELECT id, doc_id, doc_id % 5 AS k, upper(string_split(name, ' ')[1]) AS w FROM note) "
    "SELECT id, 'noisy_fact' AS reason FROM n WHERE k < 2 OR (k = 2 AND length(w) + 7 < 120) "
    "UNION ALL SELECT id, 'common_tech' FROM n WHERE k = 3 AND (doc_id % 2 = 0 OR w IN ('AI', 'API', 'LLM', 'CLI', 'UTC', 'JSON', 'YAML', 'HTML', 'HTTP', 'SQL', 'URL', 'CSS', 'XML', 'SSH', 'SSL', 'TLS', 'DNS', 'CPU', 'GPU', 'RAM', 'SSD', 'OS', 'IP', 'TCP', 'UDP')) "
    "UNION ALL SELECT id, 'structural_tech' FROM n WHERE k = 4 AND doc_id % 2 = 0 "
    f"UNION ALL SELECT id, 'stale_provisional' FROM ent WHERE type = 'project' AND day_count < 2 AND last_seen < DATE '{D}' - 14"
)
def noisy_reasons(spark, sf):
    """All four reasons: log lines, common and structural terms, stale projects."""
    return maintain.noisy(_noisy_entities(spark, sf), D)


@query(
    f"WITH {KNOWN}, acc AS (SELECT user_id::VARCHAR AS u, count(*) AS n FROM events GROUP BY 1) "
    f"SELECT id, round({t.score_sql(access='coalesce(acc.n, 0)')}, 6) AS importance FROM kn LEFT JOIN acc ON acc.u = string_split(id, ':')[-1]"
)
def rescored_entities(spark, sf):
    """All entities scored anew from their days and their accesses."""
    e = t.known(spark, sf).select("id", "type", "last_seen", "day_count", "importance")
    owner = e.select(F.col("id").alias("entity_id"), F.element_at(F.split("id", ":"), -1).alias("u"))
    log = t.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("u")).join(owner, "u").select("entity_id")
    # A store keeps four decimals; engines differ in how they round a half.
    return maintain.rescored(e, log, D, digits=6).select("id", "importance")


@query(
    f"WITH {KNOWN}, {REL}, gone AS (SELECT id FROM kn WHERE type = 'project' AND day_count < 2 AND last_seen < DATE '{D}' - 14) "
    "SELECT 'entities' AS name, (SELECT count(*) FROM kn)::BIGINT AS before, (SELECT count(*) FROM kn WHERE id NOT IN (SELECT id FROM gone))::BIGINT AS after "
    "UNION ALL SELECT 'relations', (SELECT count(*) FROM rel), (SELECT count(*) FROM rel WHERE from_entity NOT IN (SELECT id FROM gone) AND to_entity NOT IN (SELECT id FROM gone)) "
    "UNION ALL SELECT 'vectors', (SELECT count(*) FROM kn), (SELECT count(*) FROM kn WHERE id NOT IN (SELECT id FROM gone))"
)
def prune_report(spark, sf):
    """Sizes of entities, relations and vectors before and after the prune."""
    e = t.known(spark, sf)
    tables = {"entities": e, "relations": t.relations(spark, sf), "vectors": e.select(F.col("id").alias("entity_id"))}
    after, _ = maintain.prune_and_rescore(tables, D, prune_only=True)
    before, now = maintain.sizes(tables), maintain.sizes(after)
    return spark.createDataFrame([(n, before[n], now[n]) for n in tables], "name string, before bigint, after bigint")


# --- vectors ---------------------------------------------------------------------------


def _lengths(texts: list[str]) -> list[list[float]]:
    """Stands for an embedding service: a text's vector is its length; none for short ones."""
    return [[float(len(x))] if len(x) > 60 else [] for x in texts]


@query(
    f"WITH {NOTE}, x AS (SELECT id, length(substr(name || ' ' || summary, 1, 1000)) AS n FROM note) SELECT id AS entity_id, n::DOUBLE AS length FROM x WHERE n > 60"
)
def embedded_texts(spark, sf):
    """Name and summary of each note, at most 1000 characters, in batches to the service."""
    return embeddings.embed(t.notes(spark, sf), _lengths).select("entity_id", F.col("embedding")[0].cast("double").alias("length"))


@query(
    f"WITH {NOTE}, x AS (SELECT id, doc_id, length(substr(name || ' ' || summary, 1, 1000)) AS n FROM note) "
    "SELECT id AS entity_id, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE n END::DOUBLE AS length FROM x WHERE doc_id % 2 = 0 OR n > 60"
)
def vectors_missing(spark, sf):
    """Vectors are made for entities without one only, and put beside those there are."""
    n = t.notes(spark, sf)
    had = n.filter("doc_id % 2 = 0").select(F.col("id").alias("entity_id"), F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    out = t.Snapshot(vectors=had)
    out.write = lambda name, df: out.tables.update({name: df})
    embed_missing(out, n, _lengths)
    return out.read("vectors").select("entity_id", F.col("embedding")[0].cast("double").alias("length"))


@query(
    "SELECT coalesce(b.event_type, a.event_type) AS source, coalesce(b.d, a.d) AS date, coalesce(b.n, a.n)::BIGINT AS entity_count FROM "
    "(SELECT event_type, ts::DATE AS d, count(*) AS n FROM events WHERE ts::DATE < DATE '2024-01-20' GROUP BY 1, 2) a FULL JOIN "
    "(SELECT event_type, ts::DATE AS d, count(*) + 1 AS n FROM events WHERE ts::DATE >= DATE '2024-01-10' GROUP BY 1, 2) b ON a.event_type = b.event_type AND a.d = b.d"
)
def upsert_manifest(spark, sf):
    """Manifest rows put in or replaced by day and source."""
    m = t.manifest(spark, sf).select("date", "source", "entity_count")
    new = m.filter("date >= DATE '2024-01-10'").withColumn("entity_count", F.col("entity_count") + 1)
    return upsert(m.filter("date < DATE '2024-01-20'"), new, ["date", "source"])


@query(f"WITH {t.MENTIONS_SQL}, c AS (SELECT id, type, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT date)::BIGINT AS day_count, count(DISTINCT source) AS cats FROM men GROUP BY 1, 2) SELECT id, round({t.score_sql(categories='cats')}, 6) AS score FROM c")
def diversity_score(spark, sf):
    """The score with different categories counted."""
    e = rollup.rollup(t.mentions(spark, sf), {"distinct_categories": F.count_distinct("source")})
    return rollup.scored(e, D).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {KNOWN} SELECT domain, count(*)::BIGINT AS cnt FROM kn WHERE source = 'F' OR source = 'P' GROUP BY domain")
def metadata_filter(spark, sf):
    """Entities by a value of their metadata, after a filter on another."""
    e = t.known(spark, sf).filter(F.col("metadata")["source"].isin("F", "P")).select(F.col("metadata")["domain"].alias("domain"))
    return stats.count_by(e, "domain")
