"""Registered queries of the engine's operators over the driver's tables, with their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions import text as tx
from daybook.operators import extract, graph, link, maintain, rollup, search, stats
from daybook.plans import tables as t
from daybook.plans.consolidate import changed
from daybook.plans.tools import decision_history
from daybook.sources import notes as note_files
from daybook.sources.store import cascade_delete, put_relations, upsert
from daybook.vocab import STOPWORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL if it can be put in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


D = t.TODAY
ENT, REL, NOTE, MAN = t.ENTITIES_SQL, t.RELATIONS_SQL, t.NOTES_SQL, t.MANIFEST_SQL
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ids(df: DataFrame) -> DataFrame:
    return df.select("id")


# --- roll-up, score, gates -------------------------------------------------------------


@query(f"WITH {ENT} SELECT id, type, first_seen, last_seen, day_count FROM ent")
def entity_rollup(spark, sf):
    return t.entities(spark, sf).select("id", "type", "first_seen", "last_seen", "day_count")


@query(
    f"WITH {ENT}, log AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), acc AS (SELECT user_id::VARCHAR AS u, max(n) AS n FROM log GROUP BY 1) "
    f"SELECT id, round({t.score_sql(tags='tag_count', access='coalesce(acc.n, 0)')}, 6) AS score FROM ent LEFT JOIN acc ON acc.u = string_split(id, ':')[-1]"
)
def importance_score(spark, sf):
    log = t.table(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id").alias("entity_id"), "user_id")
    per = rollup.access_counts(log).withColumn("u", F.element_at(F.split("entity_id", ":"), -1)).groupBy("u").agg(F.max("access_count").alias("access_count"))
    e = t.entities(spark, sf).withColumn("tags", F.array_repeat(F.lit("x"), F.col("tag_count").cast("int")))
    named = e.select("id", F.element_at(F.split("id", ":"), -1).alias("u")).join(per, "u").select(F.col("id").alias("entity_id"), "access_count")
    return rollup.scored(e, D, named).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {ENT} SELECT id FROM ent WHERE NOT (type = 'project' AND day_count < 2 AND id NOT IN (SELECT '1-URGENT:' || c_custkey FROM customer WHERE c_acctbal > 9000))")
def recurrence_gate(spark, sf):
    known = t.table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("1-URGENT:"), F.col("c_custkey").cast("string")).alias("id"))
    return ids(rollup.gate(t.entities(spark, sf), known))


@query(f"WITH {ENT} SELECT id, last_seen FROM ent WHERE type = 'project' AND day_count < 2 AND last_seen < DATE '{D}' - 14")
def stale_provisional(spark, sf):
    return rollup.stale_provisional(t.entities(spark, sf), D).select("id", "last_seen")


@query(f"WITH {ENT} SELECT id, day_count, CASE WHEN day_count >= 3 THEN 'active' ELSE 'recent' END AS status FROM ent WHERE last_seen >= DATE '{D}' - 14")
def active_entities(spark, sf):
    return rollup.active(t.entities(spark, sf), D).select("id", "day_count", "status")


@query(
    f"WITH {t.MENTIONS_SQL} SELECT id, count(DISTINCT CASE WHEN date >= DATE '{D}' - 30 THEN date END)::BIGINT AS recent_day_count FROM men GROUP BY id"
)
def recent_day_count(spark, sf):
    return rollup.recent_days(t.mentions(spark, sf), D)


@query(
    f"WITH {ENT}, days AS (SELECT count(DISTINCT date) AS d FROM men WHERE date >= DATE '{D}' - 30) "
    f"SELECT id, (CASE WHEN last_seen >= DATE '{D}' - 30 AND first_seen <= DATE '{D}' THEN least(day_count, d) ELSE 0 END)::BIGINT AS recent_day_count FROM ent, days"
)
def recent_day_bound(spark, sf):
    return rollup.recent_days_bound(t.entities(spark, sf), t.mentions(spark, sf), D).select("id", "recent_day_count")


@query(f"WITH {ENT} SELECT id, round({t.score_sql()}, 6) AS score FROM ent WHERE {t.score_sql()} >= 0.3 ORDER BY score DESC, id LIMIT 50")
def top_by_score(spark, sf):
    """A report of the fifty greatest scores."""
    e = rollup.scored(t.entities(spark, sf), D).filter("score >= 0.3")
    return e.orderBy(F.desc(F.round("score", 6)), "id").limit(50).select("id", F.round("score", 6).alias("score"))


# --- counts and health -----------------------------------------------------------------


@query(f"WITH {ENT} SELECT type, count(*)::BIGINT AS cnt FROM ent GROUP BY type")
def type_counts(spark, sf):
    return stats.count_by(t.entities(spark, sf), "type")


@query(f"WITH {REL} SELECT rel_type, count(*)::BIGINT AS cnt FROM rel GROUP BY rel_type")
def relation_type_counts(spark, sf):
    return stats.count_by(t.relations(spark, sf), "rel_type")


@query("SELECT event_type || ':' || user_id AS entity_id, count(*)::BIGINT AS access_count FROM events GROUP BY 1")
def access_counts(spark, sf):
    return rollup.access_counts(t.table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("entity_id")))


@query(f"WITH {ENT}, {REL} SELECT id FROM ent WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel_type = 'DEPENDS_ON' AND (from_entity = ent.id OR to_entity = ent.id))")
def orphan_entities(spark, sf):
    """Entities at neither end of a dependency."""
    return ids(stats.orphans(t.entities(spark, sf), t.relations(spark, sf).filter("rel_type = 'DEPENDS_ON'")))


@query(
    f"WITH {ENT}, {REL}, e AS (SELECT type, count(*) AS n FROM ends JOIN ent ON ent.id = node GROUP BY type) "
    "SELECT ent.type, count(*)::BIGINT AS entities, coalesce(max(e.n), 0)::BIGINT AS edges, round(coalesce(max(e.n), 0) / count(*), 6) AS density "
    "FROM ent LEFT JOIN e USING (type) GROUP BY ent.type"
)
def density_by_type(spark, sf):
    out = stats.density_by_type(t.entities(spark, sf), t.relations(spark, sf))
    return out.withColumn("density", F.round("density", 6))


@query(
    f"WITH {ENT}, l AS (SELECT list(importance ORDER BY importance) AS s FROM ent) SELECT s[len(s) // 4 + 1] AS p25, s[len(s) // 2 + 1] AS p50, "
    's[3 * len(s) // 4 + 1] AS p75, s[1] AS least, s[-1] AS greatest, (SELECT count(DISTINCT round(importance, 4))::BIGINT FROM ent) AS "values" FROM l'
)
def importance_quartiles(spark, sf):
    return stats.quartiles(t.entities(spark, sf), "importance", groups=16)


@query(
    f"WITH {ENT}, r AS (SELECT importance AS s, row_number() OVER (ORDER BY importance, id) AS i, count(*) OVER () AS n FROM ent) "
    "SELECT round(2 * sum(i * s) / (max(n) * sum(s)) - (max(n) + 1) / max(n), 6) AS gini FROM r"
)
def gini(spark, sf):
    return stats.gini(t.entities(spark, sf), "importance", groups=16).select(F.round("gini", 6).alias("gini"))


@query(f"WITH {ENT} SELECT count(*) FILTER (importance < 0.3)::BIGINT AS noise, round(count(*) FILTER (importance < 0.3) / count(*), 6) AS noise_ratio FROM ent")
def noise_ratio(spark, sf):
    return stats.noise(t.entities(spark, sf), "importance").select("noise", F.round("noise_ratio", 6).alias("noise_ratio"))


@query(f"WITH {ENT}, {REL} SELECT round((SELECT count(*) FROM rel) / (SELECT count(*) FROM ent), 6) AS relations_per_entity")
def relations_per_entity(spark, sf):
    e = t.entities(spark, sf).agg(F.count(F.lit(1)).alias("e"))
    r = t.relations(spark, sf).agg(F.count(F.lit(1)).alias("r"))
    return e.crossJoin(r).select(F.round(F.col("r") / F.col("e"), 6).alias("relations_per_entity"))


@query("SELECT coalesce(json_extract_string(props, '$.k'), 'default') AS k, count(*)::BIGINT AS cnt FROM events WHERE props IS NULL OR json_valid(props) GROUP BY 1")
def source_counts(spark, sf):
    return stats.source_counts(t.table(spark, sf, "events"), "props", "k")


@query(
    f"WITH {MAN} SELECT count(*)::BIGINT AS days_indexed, count(DISTINCT date)::BIGINT AS dates, "
    "(SELECT processed_at FROM man ORDER BY date DESC, source DESC LIMIT 1) AS last_consolidation FROM man"
)
def manifest_stats(spark, sf):
    return stats.manifest_stats(t.manifest(spark, sf))


# --- files, lines, hashes --------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest_hash(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query(
    "WITH f AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT doc_id FROM f WHERE doc_id % 3 = 0 OR doc_id % 7 = 0"
)
def changed_files(spark, sf):
    """Of all files, those not in a manifest that lacks a third and has a seventh outdated."""
    day = F.lit(dt.date(2001, 1, 1))
    files = t.table(spark, sf, "documents").select(
        day.alias("date"), "source", F.col("doc_id").cast("string").alias("file_name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id"
    )
    known = files.filter("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("sha256")))
    return changed(files, known).select("doc_id")


@query("SELECT doc_id, i::INT AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, range(1, 100000) r(i) WHERE i <= len(string_split(coalesce(text, ''), chr(10)))")
def line_items(spark, sf):
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    return t.table(spark, sf, "documents").select("doc_id", lines.alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


@query(
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations"
)
def carry_forward_sections(spark, sf):
    """A user's turn opens a section; later turns belong to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    section = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return t.table(spark, sf, "conversations").select("conv_id", "turn", section.alias("section"))


# --- search ----------------------------------------------------------------------------


@query(f"WITH {NOTE} SELECT id FROM note WHERE {LOW.format('name')} LIKE '%then%the%' OR {LOW.format('summary')} LIKE '%wherea%'")
def like_search(spark, sf):
    n = t.notes(spark, sf)
    return ids(n.filter(tx.like_ascii(F.col("name"), "Then%The") | tx.like_ascii(F.col("summary"), "WHEREA")))


@query(f"WITH {NOTE} SELECT id, type FROM note WHERE contains(lower(name || summary), 'und')")
def topic_filter(spark, sf):
    return t.notes(spark, sf).filter(tx.about_topic("Und")).select("id", "type")


_TERMS = """w AS (SELECT id, unnest(regexp_extract_all(translate(regexp_replace(lower(name), '[\\x{0300}-\\x{036f}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')) AS term, 'name' AS field FROM note
  UNION ALL SELECT id, unnest(regexp_extract_all(translate(regexp_replace(lower(summary), '[\\x{0300}-\\x{036f}]', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')), 'summary' FROM note
  UNION ALL SELECT id, unnest(regexp_extract_all(lower(type), '[\\p{L}\\p{N}]+')), 'type' FROM note)"""


@query(
    f"WITH {NOTE}, {_TERMS}, len AS (SELECT id, count(*) AS len FROM w GROUP BY id), tot AS (SELECT count(*) AS docs, avg(len) AS al FROM len), "
    "tf AS (SELECT id, term, count(*) AS tf FROM w WHERE term IN ('license', 'version') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "ok AS (SELECT id FROM tf GROUP BY id HAVING count(*) = 2) "
    "SELECT id AS entity_id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS rank "
    "FROM tf JOIN df USING (term) JOIN len USING (id) JOIN ok USING (id), tot GROUP BY id"
)
def bm25_search(spark, sf):
    """Every note with both words, by BM25."""
    hits = search.bm25_scan(t.notes(spark, sf), "license version")
    return hits.select("entity_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {NOTE} SELECT id FROM note WHERE regexp_matches(' ' || lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')) || ' ', ' license version ') OR "
       "regexp_matches(' ' || lower(regexp_replace(summary, '[^A-Za-z0-9]+', ' ', 'g')) || ' ', ' license version ') ORDER BY id")
def phrase_search(spark, sf):
    hits = search.bm25_scan(t.notes(spark, sf), '"license version"')
    return hits.select(F.col("entity_id").alias("id"))


def _first_vector(spark, sf) -> list[float]:
    return t.table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding


_VEC = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) "


@query(_VEC + "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS value FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, sf):
    out = search.nearest(t.table(spark, sf, "embeddings"), _first_vector(spark, sf), 20, "cosine", "vec_id")
    return out.select("vec_id", F.round("value", 6).alias("value"))


@query(_VEC + "SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS value FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 20")
def vector_topk_l2(spark, sf):
    out = search.nearest(t.table(spark, sf, "embeddings"), _first_vector(spark, sf), 20, "l2", "vec_id")
    return out.select("vec_id", F.round("value", 6).alias("value"))


@query()
def search_similarity_score(spark, sf):
    """Scores of all entities for one query (the ratio has no SQL form)."""
    return t.entities(spark, sf).select("id", F.round(search.similarity_score("project 12"), 4).alias("similarity_score"))


# --- graph -----------------------------------------------------------------------------

_ROOT = "3-MEDIUM:400"


@query(
    f"WITH RECURSIVE {REL}, b AS (SELECT '{_ROOT}' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN ends USING (node) WHERE depth < 2) "
    "SELECT node, min(depth)::INT AS depth FROM b GROUP BY node"
)
def bfs_depth2(spark, sf):
    return graph.expand(t.relations(spark, sf), spark.createDataFrame([(_ROOT,)], "node string"), 2)


@query(
    f"WITH RECURSIVE {ENT}, {REL}, b AS (SELECT '{_ROOT}' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN ends USING (node) WHERE depth < 2), "
    "v AS (SELECT node, min(depth)::INT AS depth FROM b GROUP BY node), "
    f"k AS (SELECT other, rel_type, weight FROM ends WHERE node = '{_ROOT}' QUALIFY row_number() OVER (PARTITION BY other ORDER BY weight DESC, rel_type, id) = 1) "
    "SELECT ent.id, last_seen, depth, coalesce(k.rel_type, 'RELATES_TO') AS rel_type, round(coalesce(k.weight, 0.5), 6) AS weight "
    "FROM v JOIN ent ON ent.id = v.node LEFT JOIN k ON k.other = ent.id WHERE depth > 0 ORDER BY depth, coalesce(k.weight, 0.5) DESC, ent.id LIMIT 20"
)
def trace_related(spark, sf):
    out = graph.trace(t.entities(spark, sf), t.relations(spark, sf), _ROOT)
    return out.select("id", "last_seen", "depth", "rel_type", F.round("weight", 6).alias("weight"))


@query(
    f"WITH {ENT}, {REL}, n AS (SELECT node, other, max(weight) AS w FROM ends GROUP BY 1, 2), "
    "r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS i FROM n) "
    "SELECT node, string_agg(other, ',' ORDER BY i) AS related FROM r WHERE i <= 5 AND node IN (SELECT id FROM ent WHERE type = 'risk') GROUP BY node"
)
def related_top5(spark, sf):
    nodes = t.entities(spark, sf).filter("type = 'risk'").select(F.col("id").alias("node"))
    return graph.top_related(t.relations(spark, sf), nodes).select("node", F.array_join("related", ",").alias("related"))


@query(
    f"WITH {ENT}, {REL} SELECT id, from_entity, to_entity, round(weight, 8) AS weight FROM rel WHERE from_entity IN (SELECT id FROM ent WHERE type = 'task') OR to_entity IN (SELECT id FROM ent WHERE type = 'task')"
)
def edges_of_tasks(spark, sf):
    nodes = t.entities(spark, sf).filter("type = 'task'").select(F.col("id").alias("node"))
    # A weight is a price in cents over 500,000: eight decimals are exact.
    return graph.touching(t.relations(spark, sf), nodes).select("id", "from_entity", "to_entity", F.round("weight", 8).alias("weight"))


def _cross(spark, sf) -> DataFrame:
    """Edges between types: a customer's entities are linked in order of priority."""
    e = t.entities(spark, sf).select("id", "importance", F.element_at(F.split("id", ":"), -1).alias("c"))
    w = Window.partitionBy("c").orderBy("id")
    out = e.withColumn("from_entity", F.lag("id").over(w)).filter("from_entity IS NOT NULL")
    return out.select(
        F.format_string("rel:%s->%s:RELATES_TO", "from_entity", "id").alias("rid"), "from_entity", F.col("id").alias("to_entity"), F.lit("RELATES_TO").alias("rel_type"),
        F.col("importance").alias("weight"), F.lit("same").alias("evidence"),
    ).withColumnRenamed("rid", "id")


_CROSS = """cr AS (SELECT lag(id) OVER (PARTITION BY string_split(id, ':')[-1] ORDER BY id) AS f, id AS t, importance AS w FROM ent),
cends AS (SELECT f AS node, t AS other, w FROM cr WHERE f IS NOT NULL UNION ALL SELECT t, f, w FROM cr WHERE f IS NOT NULL)"""


@query(
    f"WITH {ENT}, {_CROSS}, d AS (SELECT * FROM ent WHERE type = 'decision' AND contains(lower(name || summary), 'customer 1')), "
    "k AS (SELECT node, other, type, w FROM cends JOIN ent ON ent.id = other WHERE type IN ('risk', 'task')), "
    "a AS (SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS i FROM ent WHERE type = 'risk' AND contains(lower(name || summary), 'customer 1') ORDER BY importance DESC, id LIMIT 10), "
    "lr AS (SELECT node, list(other ORDER BY w DESC, other) AS l FROM k WHERE type = 'risk' GROUP BY node), lt AS (SELECT node, list(other ORDER BY w DESC, other) AS l FROM k WHERE type = 'task' GROUP BY node), "
    "al AS (SELECT list(id ORDER BY i) AS l FROM a) "
    "SELECT d.id, d.name AS rationale, d.last_seen AS date, array_to_string((coalesce(lr.l, []) || list_filter(al.l, lambda x: NOT list_contains(coalesce(lr.l, []), x)))[1:10], ',') AS risks, "
    "array_to_string(coalesce(lt.l, [])[1:10], ',') AS follow_ups FROM d LEFT JOIN lr ON lr.node = d.id LEFT JOIN lt ON lt.node = d.id, al"
)
def decision_history_query(spark, sf):
    out = decision_history(t.entities(spark, sf), _cross(spark, sf), "Customer 1")
    return out.withColumns({"risks": F.array_join("risks", ","), "follow_ups": F.array_join("follow_ups", ",")})


@query(
    f"WITH {ENT}, p AS (SELECT *, string_split(id, ':')[-1] AS c FROM ent WHERE type = 'project' AND last_seen >= DATE '{D}' - 14), "
    "k AS (SELECT p.id, e.id AS cid, row_number() OVER (PARTITION BY p.id ORDER BY e.importance DESC, e.id) AS i FROM p JOIN ent e ON e.type = 'task' AND length(p.c) >= 2 AND contains(e.name || e.summary, ' ' || p.c)) "
    "SELECT p.id, coalesce(string_agg(cid, ',' ORDER BY i) FILTER (i <= 5), '') AS open_tasks FROM p LEFT JOIN k USING (id) GROUP BY p.id"
)
def open_tasks_attach(spark, sf):
    e = t.entities(spark, sf)
    mine = rollup.active(e.filter("type = 'project'"), D).withColumn("name", F.concat(F.lit(" "), F.element_at(F.split("id", ":"), -1)))
    out = graph.attach_by_name(mine, e.filter("type = 'task'"), 5, "open_tasks")
    return out.select("id", F.array_join("open_tasks", ",").alias("open_tasks"))


@query(
    f"WITH {NOTE}, p AS (SELECT 'item:' || item_id AS pid, lower(string_split(text, ' ')[1]) AS n FROM benchmark WHERE length(string_split(text, ' ')[1]) >= 3), "
    "h AS (SELECT id, pid FROM note, p WHERE contains(lower(name), n) OR contains(lower(summary), n)) SELECT 'rel:' || id || '->' || pid || ':DEPENDS_ON' AS id FROM h"
)
def project_dependency(spark, sf):
    """Notes that hold the first word of a benchmark item, as if it were a project's name."""
    p = t.table(spark, sf, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("id"), F.split("text", " ")[0].alias("name"))
    return ids(link.dependencies(t.notes(spark, sf), p))


# --- links -----------------------------------------------------------------------------


def _turns(spark, sf) -> DataFrame:
    """Turns as mentions: a conversation is a file, user and system turns are decisions and
    risks, the name is the first word, the summary the whole text."""
    kind = F.when(F.col("role") == "user", "decision").when(F.col("role") == "assistant", "risk").otherwise("fact")
    return t.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("section"), F.col("turn").alias("ord"),
        F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"), kind.alias("type"),
        F.split("text", " ")[0].alias("name"), F.col("text").alias("summary"),
    )


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TURNS = f"""m AS (SELECT conv_id, turn, 't:' || conv_id || ':' || turn AS id, CASE role WHEN 'user' THEN 'decision' WHEN 'assistant' THEN 'risk' ELSE 'fact' END AS type,
  string_split(text, ' ')[1] AS name, text AS summary FROM conversations),
mt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, id) AS r,
  list_filter(list_distinct(list_transform(regexp_extract_all(name || ' ' || summary, '[a-zA-Z]{{2,}}'), lambda x: lower(x))), lambda x: x NOT IN ({_STOP})) AS tok FROM m),
pr AS (SELECT a.conv_id, a.r AS ra, b.r AS rb, a.id AS f, b.id AS t, contains(a.summary, b.name) OR contains(b.summary, a.name) AS named,
  list_sort(list_intersect(a.tok, b.tok)) AS sh, a.type || '|' || b.type IN ('decision|risk', 'risk|decision') AS pair FROM mt a JOIN mt b ON a.conv_id = b.conv_id AND a.r < b.r),
ev AS (SELECT *, CASE WHEN named THEN 'name_mention' WHEN len(sh) >= 2 THEN 'shared_tokens: ' || array_to_string(sh, ',') WHEN pair THEN 'co_occurrence' END AS evidence FROM pr),
lk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ra, rb) AS i FROM ev WHERE evidence IS NOT NULL)"""


@query(f"WITH {_TURNS} SELECT 'rel:' || f || '->' || t || ':RELATES_TO' AS id, CASE WHEN evidence = 'co_occurrence' THEN 0.3 ELSE 0.5 END::DOUBLE AS weight, evidence FROM lk WHERE i <= 500")
def section_links(spark, sf):
    return link.section_links(_turns(spark, sf)).select("id", "weight", "evidence")


@query(f"WITH {_TURNS} SELECT evidence = 'co_occurrence' AS co_occurrence, count(*)::BIGINT AS cnt FROM lk WHERE i <= 500 GROUP BY 1")
def link_evidence_counts(spark, sf):
    out = link.section_links(_turns(spark, sf)).select((F.col("evidence") == "co_occurrence").alias("co_occurrence"))
    return stats.count_by(out, "co_occurrence")


@query()
def similarity_merge(spark, sf):
    """Suppliers and customers whose names are alike, by nation (the ratio has no SQL form).
    They have no days, so all count as seen on one."""

    def named(table: str, x: str, key: str) -> DataFrame:
        return t.table(spark, sf, table).select(
            F.concat(F.lit(f"{x}:"), F.col(key).cast("string")).alias("id"), F.col(f"{x}_nationkey").cast("string").alias("type"),
            F.col(f"{x}_name").alias("name"), F.lit(D).alias("first_seen"),
        )

    return link.merge_map(link.nearest_earlier(named("supplier", "s", "s_suppkey").unionAll(named("customer", "c", "c_custkey"))))


# --- terms and names -------------------------------------------------------------------

ACRONYM = r"(?<![\p{L}\p{N}_])([A-Z][A-Z0-9]{1,7})(?![\p{L}\p{N}_])"


@query(
    "SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{1,7}')))) AS term FROM documents"
)
def acronym_terms(spark, sf):
    """Acronyms of all texts; letters and digits of any script make words. In SQL whole words
    are taken first and then judged."""
    docs = t.table(spark, sf, "documents")
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ACRONYM), F.lit(1)))
    return docs.select("doc_id", F.explode(found).alias("term"))


@query()
def tech_terms(spark, sf):
    """All six passes with look-around, over all documents."""
    return extract.tech_terms(t.table(spark, sf, "documents"), "doc_id", "text")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents), s AS (SELECT doc_id, regexp_replace(regexp_replace(l, '^[\\s\\v]+', ''), '[\\s\\v]+$', '') AS s FROM l) "
    "SELECT doc_id, CASE WHEN strpos(s, '。') - 1 BETWEEN 5 AND 40 THEN substr(s, 1, strpos(s, '。') - 1) WHEN strpos(s, ', ') - 1 > 4 AND strpos(s, ', ') - 1 <= 40 THEN substr(s, 1, strpos(s, ', ') - 1) "
    "WHEN strpos(s, '; ') - 1 > 4 AND strpos(s, '; ') - 1 <= 40 THEN substr(s, 1, strpos(s, '; ') - 1) WHEN length(s) > 40 THEN substr(s, 1, 39) || '…' ELSE s END AS name FROM s"
)
def clause_compact(spark, sf):
    """Names from every line of every text."""
    lines = t.table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.select("doc_id", tx.compact_name(F.col("line")).alias("name"))


@query("SELECT p_partkey, 'tech:' || substr(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 30) AS id FROM part")
def slugify(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", tx.entity_id(F.lit("tech"), F.concat_ws(" / ", "p_name", "p_brand")).alias("id"))


# --- store -----------------------------------------------------------------------------


@query(
    f"WITH {ENT}, o AS (SELECT id, first_seen, day_count FROM ent WHERE type <> 'risk'), n AS (SELECT id, last_seen AS first_seen, day_count + 1 AS day_count FROM ent WHERE type IN ('risk', 'task')) "
    "SELECT coalesce(o.id, n.id) AS id, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.day_count, o.day_count)::BIGINT AS day_count FROM o FULL JOIN n ON o.id = n.id"
)
def upsert_entities(spark, sf):
    e = t.entities(spark, sf)
    old = e.filter("type <> 'risk'").select("id", "first_seen", "day_count")
    new = e.filter("type IN ('risk', 'task')").select("id", F.col("last_seen").alias("first_seen"), (F.col("day_count") + 1).alias("day_count"))
    return upsert(old, new, ["id"], keep=("first_seen",))


@query(f"WITH {ENT}, {_CROSS} SELECT 'rel:' || f || '->' || t || ':RELATES_TO' AS id, max(w * 2) AS weight FROM cr WHERE f IS NOT NULL GROUP BY 1")
def dedup_relations(spark, sf):
    edges = _cross(spark, sf)
    twice = edges.withColumn("weight", F.col("weight") * 2)
    loops = edges.withColumn("to_entity", F.col("from_entity"))
    return put_relations(edges, edges.unionAll(twice).unionAll(loops)).select("id", "weight")


_GONE = f"gone AS (SELECT id FROM ent WHERE type = 'project' AND day_count < 2 AND last_seen < DATE '{D}' - 14)"


@query(f"WITH {ENT}, {_CROSS}, {_GONE} SELECT f AS from_entity, t AS to_entity FROM cr WHERE f IS NOT NULL AND f NOT IN (SELECT id FROM gone) AND t NOT IN (SELECT id FROM gone)")
def cascade_delete_query(spark, sf):
    e = t.entities(spark, sf)
    out = cascade_delete({"entities": e, "relations": _cross(spark, sf)}, rollup.stale_provisional(e, D))
    return out["relations"].select("from_entity", "to_entity")


@query(f"WITH {ENT}, {_GONE} SELECT id, 'stale_provisional' AS reason FROM gone")
def noisy_entities(spark, sf):
    return maintain.noisy(t.entities(spark, sf), D)


@query(f"WITH {REL} SELECT id FROM rel WHERE NOT (rel_type = 'RELATES_TO' AND weight < 0.9)")
def weak_relations(spark, sf):
    weak = F.when(F.col("weight") < 0.9, "核心要点").otherwise(F.col("evidence"))
    return ids(maintain.without_weak(t.relations(spark, sf).withColumn("evidence", weak)))


# --- notes from text to mentions -------------------------------------------------------

#: A file of the note format, written for this query.
NOTE_TEXT = """---
title: "A day"
date: "2026-03-01"
---
## 09:10
**决策与结论**
- 09:12 - 决定使用PostgreSQL存储，旧库停用
  因为查询更快
**风险与注意事项**
- 磁带备份存在丢失风险，需要每周演练
### 原始细节
- 未整理的 MQTT 细节
### 摘要
[已完成] 部署了ESP32网关，运行稳定
## 待办与计划
- 计划迁移HomeBrain项目的日志
"""


def note_files_frame(spark, sf) -> DataFrame:
    row = ("lab", dt.date(2026, 3, 1), "2026-03-01.md", "/2026-03-01.md", "x", NOTE_TEXT)
    return spark.createDataFrame([row], "source string, date date, file_name string, path string, sha256 string, content string")


@query(
    """SELECT * FROM (VALUES ('决策与结论', 'decision', '决定使用PostgreSQL存储，旧库停用 因为查询更快', '09:12', 7::INT, 8::INT, false, NULL),
    ('风险与注意事项', 'risk', '磁带备份存在丢失风险，需要每周演练', NULL, 10, 10, false, NULL), ('风险与注意事项', 'risk', '未整理的 MQTT 细节', NULL, 12, 12, true, NULL),
    ('已完成事项', 'task', '部署了ESP32网关，运行稳定', NULL, 14, 14, false, '已完成'), ('待办与计划', 'task', '计划迁移HomeBrain项目的日志', NULL, 16, 16, false, NULL))
    AS v(section_title, category, text, time, line_start, line_end, skip_extraction, tag)"""
)
def parse_note(spark, sf):
    return note_files.parse(note_files_frame(spark, sf)).select("section_title", "category", "text", "time", "line_start", "line_end", "skip_extraction", "tag")


@query(
    """SELECT id, type, name, status, nth::INT AS nth FROM (VALUES ('decision:shiyongpostgresqlcunchu', 'decision', '使用PostgreSQL存储', NULL, 1), ('decision:shiyongpostgresqlcunchu', 'decision', '使用PostgreSQL存储', NULL, 2),
    ('tech:postgresql', 'tech', 'PostgreSQL', NULL, 1), ('risk:cidaibeifencunzaidiushi', 'risk', '磁带备份存在丢失', NULL, 1), ('risk:cidaibeifencunzaidiushi', 'risk', '磁带备份存在丢失', NULL, 2),
    ('task:wancheng_esp32wangguan', 'task', 'ESP32网关', 'completed', 1), ('tech:esp32', 'tech', 'ESP32', NULL, 1), ('task:esp32wangguan', 'task', 'ESP32网关', 'completed', 1),
    ('task:jihua_qianyihomebrainxiangmude', 'task', '迁移HomeBrain项目的日志', 'todo', 1), ('proj:homebrain', 'project', 'HomeBrain', NULL, 1), ('tech:homebrain', 'tech', 'HomeBrain', NULL, 1),
    ('task:qianyihomebrainxiangmuderizhi', 'task', '迁移HomeBrain项目的日志', NULL, 1)) AS v(id, type, name, status, nth)"""
)
def extract_note(spark, sf):
    return extract.mentions(note_files.parse(note_files_frame(spark, sf))).select("id", "type", "name", "status", "nth")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: entities that pass the gate, scored for today, with their neighbours."""
    passed = rollup.gate(rollup.scored(t.entities(spark, sf_dir), D))
    near = graph.top_related(t.relations(spark, sf_dir), passed.select(F.col("id").alias("node")))
    out = passed.join(near.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "type", "first_seen", "last_seen", "day_count", F.round("score", 6).alias("score"), "related")
