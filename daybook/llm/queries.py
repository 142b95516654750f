"""The corpus operators' queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import chat_format, decontaminate, language_model, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, url_filter
from daybook.llm.common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(read_table(spark, sf_dir, "documents"))
    out = decontaminate.summarize(index, read_table(spark, sf_dir, "benchmark"), window=13)
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack(read_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), window=4096, end_id=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read_table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version",
    )


#: The rules of the URL query (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(quality_classifier.id_crc(), F.lit(4)) == 2
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"), sample=3000, keep=~held_out)
    out = quality_classifier.score(docs, model, threshold=0.7)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"), modulus=7, held=2)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], table.schema)
    return chat_format.read_back(chat_format.format_turns(table.unionByName(extra)))


QUERIES = {
    "op7_quality_classifier": op7_quality_classifier,
    "op8_near_dedup": op8_near_dedup,
    "op9_lm_score": op9_lm_score,
    "op6_url_filter": op6_url_filter,
    "op10_chat_format": op10_chat_format,
    "op2_packing": op2_packing,
    "op1_decontaminate": op1_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
}

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
      FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT rid, i, dw.n, item_id FROM dw JOIN iw ON dw.w = iw.w AND dw.n = iw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

_OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(text) + len(regexp_extract_all(text, '</?s>|\[/?(INST|SYS|ROLE)\]|\[(OUT|TEXT)\]'))
   + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 11
     ELSE 7 + length(role) + 8 + 8 + len(regexp_extract_all(role, '</?s>|\[/?(INST|SYS|ROLE)\]|\[(OUT|TEXT)\]')) END))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP8 = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS x
   FROM (SELECT rid, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (rid) JOIN (SELECT r.a, min(o.doc_id) AS c FROM r JOIN w o ON o.rid = r.b GROUP BY 1) m ON m.a = w.rid
"""

_OP3 = r"""
WITH d AS (SELECT *, coalesce(text, '') AS t, coalesce('=' || source, '-') AS host FROM documents),
r AS (SELECT row_number() OVER () AS rid, * FROM d),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM r),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS tri FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY rid),
base AS (SELECT w.rid, doc_id, len(ws) AS n_words,
   length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
   FROM w LEFT JOIN rep USING (rid)),
l AS (SELECT rid, host, doc_id, translate(regexp_replace(regexp_replace(ln, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT rid, host, doc_id, unnest(string_split(t, chr(10))) AS ln FROM r)),
hn AS (SELECT host, count(*) AS docs FROM (SELECT DISTINCT host, doc_id FROM r) GROUP BY host),
f AS (SELECT host, k FROM (SELECT DISTINCT host, k, doc_id FROM l WHERE length(k) > 0) JOIN hn USING (host) GROUP BY host, k, docs
      HAVING count(*) >= 10 AND 100 * count(*) >= docs),
x AS (SELECT rid, sum(length(l.k)) AS chars, coalesce(sum(length(l.k)) FILTER (f.k IS NOT NULL), 0) AS gone FROM l LEFT JOIN f USING (host, k) GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
   n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (gone > 0 AND 100 * (chars - gone) < 80 * chars) AS kept
FROM base JOIN x USING (rid)
"""

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS ln, translate(regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
   sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN ln END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY rid, doc_id
"""

ORACLES = {"op8_near_dedup": _OP8, "op10_chat_format": _OP10, "op1_decontaminate": _OP1, "op3_quality_rules": _OP3, "op4_line_dedup": _OP4}
