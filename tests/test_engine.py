"""The note engine: parsing, extraction, scores, links, search, graph, store, ingestion."""

import datetime as dt
import difflib
import io
import json
import os
import random
import re
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.functions import scoring
from daybook.functions import text as tx
from daybook.operators import extract, graph, link, maintain, rollup, search, stats
from daybook.plans import queries, queries_notes, server
from daybook.plans.consolidate import consolidate, embed_again
from daybook.plans.tables import Snapshot
from daybook.plans.tools import Knowledge, clamp
from daybook.sources import notes, registry
from daybook.sources.embeddings import embed, from_environment
from daybook.sources.store import Store, cascade_delete, put_relations, upsert

TODAY = dt.date(2026, 6, 1)
ENTITY = "id string, type string, name string, summary string, importance double, first_seen date, last_seen date, day_count bigint"


def one(spark, column, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def entity(id_, kind, name="n", summary="s", importance=0.5, days=0, count=2):
    seen = TODAY - dt.timedelta(days=days)
    return (id_, kind, name, summary, importance, seen, seen, count)


class TestParsing:
    def test_sections_times_and_continuations(self):
        rows = notes.items_of(queries.NOTE_TEXT)
        assert [(r["section_title"], r["time"], r["line_start"], r["line_end"]) for r in rows] == [
            ("决策与结论", "09:12", 7, 8), ("风险与注意事项", None, 10, 10), ("风险与注意事项", None, 12, 12), ("已完成事项", None, 14, 14), ("待办与计划", None, 16, 16),
        ]
        assert [r["skip_extraction"] for r in rows] == [False, False, True, False, False]
        assert rows[3]["tag"] == "已完成" and rows[0]["text"].endswith("因为查询更快")

    def test_unknown_heading_is_a_fact_section(self):
        assert notes.items_of("## 别的\n- 一件事情")[0]["category"] == "fact"

    @pytest.mark.parametrize("text", ["", "---\n", "- before any section", "## 09:00\n- after a clock only", "### 摘要\nplain\n[未知] x"])
    def test_nothing_to_find(self, text):
        assert notes.items_of(text) == []

    def test_second_level_heading_ends_raw_mode(self):
        rows = notes.items_of("## 核心要点\n### raw\n- a b c\n## 核心要点\n- d e f")
        assert [r["skip_extraction"] for r in rows] == [True, False]

    def test_source_list(self):
        assert notes.parse_source_list("a=/x:/y/z") == [("a", "/x"), ("z", "/y/z")]
        assert notes.parse_source_list(None) == [("notes", "notes")]

    def test_frontmatter(self, spark):
        title, date = notes.frontmatter("v")
        df = spark.createDataFrame([(queries.NOTE_TEXT,), ("x",)], "v string").select(title, date)
        assert [tuple(r) for r in df.collect()] == [("A day", "2026-03-01"), ("", "")]


class TestExtraction:
    @pytest.mark.parametrize(
        "text, want",
        [("推进心连心项目", ["心连心"]), ("ExampleProject项目上线", ["ExampleProject"]), ("the HomeBrain project", ["HomeBrain"]), ("按照必须的项目", []), ("无", [])],
    )
    def test_projects(self, spark, text, want):
        assert [c.name for c in one(spark, extract.projects(F.col("v")), text)] == want

    @pytest.mark.parametrize(
        "text, want",
        [("使用Python开发，MQTT 通信", {"Python", "MQTT"}), ("see `nginx.conf` and HomeAssistant", {"nginx.conf", "HomeAssistant"}), ("API and THE 2026-05", set())],
    )
    def test_tech(self, spark, text, want):
        got = extract.tech_terms(spark.createDataFrame([(1, text)], "k int, v string"), "k", "v")
        assert {r.term for r in got.collect()} == want

    def test_tasks_and_risks(self, spark):
        assert [(c.name, c.status, c.seed) for c in one(spark, extract.tasks(F.col("v")), "完成了迁移，后续写文档")] == [
            ("迁移", "completed", "完成_迁移"), ("写文档", "todo", "计划_写文档"),
        ]
        assert "磁盘满" in {c.name for c in one(spark, extract.risks(F.col("v")), "磁盘满风险")}

    @pytest.mark.parametrize("text", ["心跳轮询正常", "HEARTBEAT ok", "X-ERR: timeout", "无", "ab", "daily_memory cron 已更新", "磁盘使用 37%"])
    def test_garbage(self, spark, text):
        assert one(spark, tx.is_garbage_text(F.col("v")), text)

    @pytest.mark.parametrize("name", ["15:20 UTC x", "[01:03] y", "3.14", "2h", "**x", "，。", "x", "任务"])
    def test_garbage_names(self, spark, name):
        assert one(spark, tx.is_garbage_name(F.col("v")), name)

    def test_compact(self, spark):
        assert one(spark, tx.compact_name(F.col("v")), "一二三四五，六七。八九") == "一二三四五，六七"
        assert one(spark, tx.compact_name(F.col("v"), 10), "abcdefghijklmnop") == "abcdefghi…"

    def test_slugs(self, spark):
        assert one(spark, tx.entity_id(F.lit("project"), F.col("v")), "家庭大脑") == "proj:jiatingdanao"
        assert one(spark, tx.entity_id(F.lit("tech"), F.col("v")), " ESP32-S3! ") == "tech:esp32_s3"

    def test_mentions_of_empty_items(self, spark):
        assert extract.mentions(notes.parse(queries.note_files_frame(spark, "").filter("false"))).count() == 0


class TestScores:
    @pytest.mark.parametrize("days, want", [(0, 1.0), (15, 0.5), (30, 0.0), (99, 0.0)])
    def test_freshness(self, spark, days, want):
        assert one(spark, scoring.freshness(F.col("v")), days, "v int") == pytest.approx(want)

    @pytest.mark.parametrize("n, days, want", [(7, 0, 1.0), (0, 0, 0.0), (7, 75, 0.5), (7, 999, 0.3)])
    def test_frequency(self, spark, n, days, want):
        assert one(spark, scoring.frequency(F.col("v"), F.lit(days)), n, "v int") == pytest.approx(want)

    def test_composite(self, spark):
        df = spark.createDataFrame([("decision", TODAY, 7), ("fact", None, 0), (None, TODAY, None)], "type string, last_seen date, day_count int")
        got = [r[0] for r in df.select(scoring.importance(F.col("type"), F.col("last_seen"), F.col("day_count"), TODAY)).collect()]
        assert got == pytest.approx([0.15 + 0.30 + 0.28, 0.0, 0.15])

    def test_gate(self, spark):
        rows = [entity("a", "project", count=1), entity("b", "project", count=2), entity("c", "fact", count=1), entity("d", "project", count=1)]
        df = spark.createDataFrame(rows, ENTITY)
        known = spark.createDataFrame([("d",), ("d",)], "id string")
        assert {r.id for r in rollup.gate(df, known).collect()} == {"b", "c", "d"}

    def test_rollup_counts_days_once(self, spark):
        m = spark.createDataFrame([("a", "fact", TODAY), ("a", "fact", TODAY), ("a", "fact", TODAY - dt.timedelta(days=40))], "id string, type string, date date")
        assert rollup.rollup(m).first().day_count == 2 and rollup.recent_days(m, TODAY).first().recent_day_count == 1


class TestLinks:
    def test_rules_in_order(self, spark):
        rows = [("f", 0, 1, "a", "decision", "alpha", "uses beta"), ("f", 0, 2, "b", "fact", "beta", "plain"), ("f", 0, 3, "c", "risk", "gamma", "other"), ("f", 1, 4, "d", "risk", "beta", "far")]
        df = spark.createDataFrame(rows, "file string, section int, ord int, id string, type string, name string, summary string")
        got = {(r.from_entity, r.to_entity): (r.weight, r.evidence) for r in link.section_links(df).collect()}
        assert got == {("a", "b"): (0.5, "name_mention"), ("a", "c"): (0.3, "co_occurrence")}

    def test_contradiction(self, spark):
        rows = [("f", 0, 1, "a", "decision", "x", "采用 Postgres"), ("f", 3, 2, "b", "decision", "y", "放弃 postgres"), ("f", 0, 3, "c", "decision", "z", "放弃 mysql")]
        df = spark.createDataFrame(rows, "file string, section int, ord int, id string, type string, name string, summary string")
        assert [(r.from_entity, r.to_entity, r.evidence) for r in link.contradictions(df).collect()] == [("a", "b", "opposing_stance: postgres")]

    @pytest.mark.parametrize("sent", [2000, 0])
    def test_names_inside_texts(self, spark, monkeypatch, sent):
        """Sent to the texts, or met through their rarest letters: the same pairs."""
        monkeypatch.setattr(link, "SENT_NAMES", sent)
        texts = [(i, t) for i, t in enumerate(["the HomeBrain and homelab", "homelab", "nothing", "", None, "brainhome HOMEBRAIN", "家庭大脑上线"])]
        names = [("a", "homebrain"), ("b", "HomeLab"), ("c", "home"), ("d", "大脑上"), ("e", "zzz")]
        got = link.names_inside(spark.createDataFrame(texts, "n int, text string"), spark.createDataFrame(names, "id string, name string")).select("n", "id").collect()
        assert sorted(map(tuple, got)) == sorted((i, x) for i, t in texts for x, name in names if name.lower() in (t or "").lower())

    @pytest.mark.parametrize("threshold", [0.85, 0.9])
    def test_similar_names_against_all_pairs(self, spark, threshold):
        """No pair is lost by the rare grams, whatever the letters and days."""
        rng = random.Random(7)
        words = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(60)]
        for w in words[:40]:
            at = rng.randrange(len(w) + 1)
            words.append(w[:at] + rng.choice("abcdx") + w[at + rng.randint(0, 1) :])
        rows = [entity(f"{i:03}", rng.choice(["fact", "risk"]), w, days=rng.randrange(60)) for i, w in enumerate(words)] + [entity(x, "fact", "aaaaaaaa" + "b" * k) for k, x in enumerate("xyz")]
        rows += [entity(f"L{i}", "fact", "Supplier#0000000" + f"{i:02}") for i in range(12)]
        got = link.similar_names(spark.createDataFrame(rows, ENTITY), threshold).collect()
        want = set()
        for a in rows:
            for b in rows:
                near = 0 <= (b[5] - a[5]).days <= 30 and (a[5], a[0]) < (b[5], b[0])
                if a[1] == b[1] and near and difflib.SequenceMatcher(None, b[2].lower(), a[2].lower()).ratio() >= threshold:
                    want.add((a[0], b[0]))
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 60

    def test_dependencies_skip_short_names(self, spark):
        e = spark.createDataFrame([entity("t", "task", "deploy HomeBrain"), entity("u", "task", "ab 系统")], ENTITY)
        p = spark.createDataFrame([("p", "homebrain"), ("q", "ab"), ("r", "系统")], "id string, name string")
        assert [(r.from_entity, r.to_entity) for r in link.dependencies(e, p).collect()] == [("t", "p")]

    @pytest.mark.parametrize("short", [20, 5])
    def test_nearest_earlier_is_the_best_of_all_pairs(self, spark, monkeypatch, short):
        """Whatever stage a name is met in, and with copies of names on one day and on several."""
        monkeypatch.setattr(link, "SHORT_NAME", short)
        rng = random.Random(11)
        words = [f"Customer#{rng.randrange(3000):06}" for _ in range(50)] + ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(50)]
        for w in words[30:90] * 2:
            at = rng.randrange(len(w) + 1)
            words.append(w[:at] + "".join(rng.choices("abX", k=rng.randint(0, 3))) + w[at + rng.randint(0, 3) :])
        rows = [entity(f"{i:03}", rng.choice(["fact", "risk"]), w, days=rng.choice([0, 0, 5, 29, 45, 70])) for i, w in enumerate(words + words[:60] + [""])]
        want = {}
        for b in rows:
            near = [a for a in rows if a[1] == b[1] and a[2] and 0 <= (b[5] - a[5]).days <= 30 and (a[5], a[0]) < (b[5], b[0])]
            ratios = [(difflib.SequenceMatcher(None, b[2].lower(), a[2].lower()).ratio(), a[0]) for a in near]
            best = min(((-r, a) for r, a in ratios if r >= 0.85), default=None)
            if b[2] and best:
                want[b[0]] = (best[1], -best[0])
        got = link.nearest_earlier(spark.createDataFrame(rows, ENTITY)).collect()
        assert {r.b: (r.a, r.ratio) for r in got} == want and len(got) == len(want) > 60

    def test_nearest_earlier_makes_no_pairs_of_all_copies(self, spark, monkeypatch):
        """Names numbered in one form: few pairs are compared, and one row comes out for each."""
        compared = spark.sparkContext.accumulator(0)

        @F.pandas_udf("double")
        def counted(a: pd.Series, b: pd.Series) -> pd.Series:
            compared.add(len(a))
            return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

        monkeypatch.setattr(link, "matching_ratio", counted)
        rows = [entity(f"{i:04}", "fact", f"Customer#{i % 400:09}") for i in range(2000)]
        got = link.nearest_earlier(spark.createDataFrame(rows, ENTITY)).collect()
        assert len(got) == 1999 and compared.value < 20_000  # of 79,800 pairs of names and 1,999,000 of rows

    @pytest.mark.parametrize("sent", [2000, 0])
    def test_dependencies_stand_in_one_field(self, spark, monkeypatch, sent):
        """A name that goes on over a line's end is not put together from name and summary."""
        monkeypatch.setattr(link, "SENT_NAMES", sent)
        e = spark.createDataFrame([entity("t", "task", "to Home", "Brain x"), entity("u", "task", "x", "a home\nbrain"), entity("v", "task", "home\nbrain", None)], ENTITY)
        p = spark.createDataFrame([("p", "Home\nBrain")], "id string, name string")
        assert {r.from_entity for r in link.dependencies(e, p).collect()} == {"u", "v"}

    def test_similar_names_chain(self, spark):
        rows = [entity("a", "fact", "database backup plan", days=3), entity("b", "fact", "database backup plans", days=2), entity("c", "fact", "unrelated"), entity("d", "task", "database backup plan")]
        pairs = link.similar_names(spark.createDataFrame(rows, ENTITY))
        assert {(r.id, r.canonical) for r in link.merge_map(pairs).collect()} == {("b", "a")}

    def test_similar_names_in_any_case(self, spark):
        rows = [entity("a", "project", "HomeBrain", days=3), entity("b", "project", "homebrain", days=2)]
        pairs = link.similar_names(spark.createDataFrame(rows, ENTITY)).collect()
        assert [tuple(r) for r in pairs] == [("a", "b", 1.0)]

    def test_merges_are_followed_to_the_end(self, spark):
        pairs = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}", 0.9) for i in range(40)], "a string, b string, ratio double")
        assert {tuple(r) for r in link.merge_map(pairs).collect()} == {(f"{i:03}", "000") for i in range(1, 41)}

    def test_similarity_merge_reads_both_tables(self, spark, tmp_path):
        spark.createDataFrame([(1, "ACME Tools", 5)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
        spark.createDataFrame([(7, "Acme tool", 5), (8, "Acme tool", 6)], "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
        assert [tuple(r) for r in queries.QUERIES["similarity_merge"](spark, str(tmp_path)).collect()] == [("s:1", "c:7")]

    def test_ratio_is_not_symmetric(self, spark):
        df = spark.createDataFrame([("tide", "diet")], "a string, b string").select(tx.matching_ratio("a", "b").alias("x"), tx.matching_ratio("b", "a").alias("y"))
        assert tuple(df.first()) == (0.25, 0.5)


class TestWholeTables:
    def test_acronyms_of_texts_in_any_script(self, spark, tmp_path):
        texts = ["the API and XML2", "é API, ÉTAT ÉAB XÉ 中文HTTP SQL。 a_ID ID_ NASA", None, "A TOOLONGNAME ok"]
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
        want = {(i, x) for i, text in enumerate(texts) for x in re.findall(r"\b[A-Z][A-Z0-9]{1,7}\b", text or "")}
        got = queries.QUERIES["acronym_terms"](spark, str(tmp_path)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) and {(1, "API"), (1, "NASA")} <= want

    def test_links_from_far_inside_a_turn(self, spark, tmp_path):
        far = "x " * 150
        rows = [(1, 0, "user", "aa " + far + "zebra"), (1, 1, "system", "zebra b"), (2, 0, "user", "cc " + far + "copper kettle"), (2, 1, "system", "dd " + far + "copper kettle")]
        spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
        got = queries.QUERIES["section_links"](spark, str(tmp_path)).collect()
        assert {(r.id, r.weight, r.evidence) for r in got} == {
            ("rel:t:1:0->t:1:1:RELATES_TO", 0.5, "name_mention"), ("rel:t:2:0->t:2:1:RELATES_TO", 0.5, "shared_tokens: copper,kettle")
        }
        counts = queries.QUERIES["link_evidence_counts"](spark, str(tmp_path)).collect()
        assert [(r.co_occurrence, r.cnt) for r in counts] == [(False, 2)]


class TestSearch:
    @pytest.fixture(scope="class")
    def pool(self, spark):
        rows = [entity("a", "tech", "rule engine", "fast rules"), entity("b", "tech", "engine room", "slow"), entity("c", "fact", "résumé", "规则引擎决策"), entity("d", "fact", "none", "")]
        return spark.createDataFrame(rows, ENTITY).cache()

    @pytest.mark.parametrize(
        "query, want",
        [("rule engine", {"a"}), ("rule OR slow", {"a", "b"}), ("name:engine", {"a", "b"}), ("rules NOT engine", set()), ('"rule engine"', {"a"}), ('"engine rule"', set()), ("fast*", {"a"}), ("type:tech NOT slow", {"a"}), ("resume", {"c"})],
    )
    def test_grammar(self, pool, query, want):
        from_index = {r.entity_id: r.rank for r in search.bm25(search.postings(pool), query).collect()}
        assert set(from_index) == want
        assert {r.entity_id: r.rank for r in search.bm25_scan(pool, query).collect()} == pytest.approx(from_index)

    def test_index_of_odd_rows(self, spark):
        """Empty and null fields, words found again, and ids in several rows, null too."""
        rows = [("a", "x", "b a b", ""), ("b", None, None, None), ("c", "Z z", "q", "t"), ("c", "z", "q r", "t"), (None, "n", "n", "n"), (None, "n", "", ""), ("d", "", "", "")]
        got = search.postings(spark.createDataFrame(rows, "id string, name string, summary string, type string")).collect()
        want, lens, most = {}, [], {}
        for id_, *texts in rows:
            lens.append((id_, sum(len((x or "").split()) for x in texts)))
            most[id_] = max(most.get(id_, 0), lens[-1][1])
            for field, text in zip(search.FIELDS, texts, strict=True):
                for i, w in enumerate((text or "").lower().split()):
                    want.setdefault((id_, field, w), []).append(i)
        key = lambda x: str(x)
        assert {(r.entity_id, r.field, r.term): (r.tf, r.positions, r.len) for r in got if r.term} == {k: (len(v), sorted(v), most[k[0]]) for k, v in want.items()}
        assert sum(bool(r.term) for r in got) == len(want)
        assert sorted(((r.entity_id, r.tf) for r in got if not r.term), key=key) == sorted(lens, key=key)

    def test_index_shuffles_no_words(self, pool):
        plan = search.postings(pool)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan

    @pytest.mark.parametrize("query", ["", "rule-engine", "proj:a", "50%", "NOT x"])
    def test_not_a_query(self, query):
        with pytest.raises(SyntaxError):
            search.Query(query)

    def test_falls_back_to_text(self, pool):
        assert [r.id for r in search.keyword(pool, "规则引擎", 5, search.postings(pool)).collect()] == ["c"]

    def test_like_folds_ascii_only(self, spark):
        assert one(spark, tx.like_ascii(F.col("v"), "AB_d"), "xxaBCDxx") and not one(spark, tx.like_ascii(F.col("v"), "É"), "é")

    def test_nearest(self, spark):
        v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "entity_id string, embedding array<float>")
        assert [(r.entity_id, r.value) for r in search.nearest(v, [1.0, 0.0], 2).collect()] == [("a", 1.0), ("b", 0.0)]
        assert search.nearest(v, [0.0, 2.0], 1, "l2").first().entity_id == "b"


class TestGraphAndStats:
    def edges(self, spark, *pairs):
        rows = [(f"{a}{b}", a, b, "RELATES_TO", w, "e") for a, b, w in pairs]
        return spark.createDataFrame(rows, "id string, from_entity string, to_entity string, rel_type string, weight double, evidence string")

    def test_expand_and_trace(self, spark):
        rel = self.edges(spark, ("a", "b", 0.4), ("c", "b", 0.9), ("c", "d", 0.1))
        start = spark.createDataFrame([("a",)], "node string")
        assert {(r.node, r.depth) for r in graph.expand(rel, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
        e = spark.createDataFrame([entity(x, "fact") for x in "abcd"], ENTITY)
        assert [(r.id, r.depth, r.weight) for r in graph.trace(e, rel, "a", 3).collect()] == [("b", 1, 0.4), ("c", 2, 0.5), ("d", 3, 0.5)]

    def test_top_related(self, spark):
        rel = self.edges(spark, ("a", "b", 0.4), ("c", "a", 0.9), ("a", "a", 1.0))
        assert graph.top_related(rel, spark.createDataFrame([("a",)], "node string")).first().related == ["c", "b"]

    def test_density_and_orphans(self, spark):
        e = spark.createDataFrame([entity("a", "x"), entity("b", "x"), entity("c", "y")], ENTITY)
        rel = self.edges(spark, ("a", "b", 1.0), ("a", "a", 1.0))
        assert {(r.type, r.edges) for r in stats.density_by_type(e, rel).collect()} == {("x", 3), ("y", 0)}
        assert [r.id for r in stats.orphans(e, rel).collect()] == ["c"]

    @pytest.mark.parametrize("values", [[1, 2, 3, 4, 5, 6, 7, 8], [5], [2, 2, 2, 9], [0, 0]])
    def test_quartiles_and_gini(self, spark, values):
        s, n = sorted(map(float, values)), len(values)
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        q = stats.quartiles(df, "v", 3).first()
        assert (q.p25, q.p50, q.p75) == (s[n // 4], s[n // 2], s[3 * n // 4])
        want = 2 * sum(i * x for i, x in enumerate(s, 1)) / (n * sum(s)) - (n + 1) / n if n > 1 and sum(s) else 0.0
        assert stats.gini(df, "v", 3).first().gini == pytest.approx(want)

    def test_empty(self, spark):
        assert stats.gini(spark.createDataFrame([], "v double"), "v").first().gini == 0.0

    def test_source_counts_drop_malformed(self, spark):
        df = spark.createDataFrame([('{"source":"a"}',), ("{}",), ("{bad",), (None,)], "metadata string")
        assert {(r.source, r.cnt) for r in stats.source_counts(df).collect()} == {("a", 1), ("default", 2)}


class TestStore:
    def test_upsert_keeps(self, spark):
        old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, x int, y int")
        new = spark.createDataFrame([("b", 2, 2), ("c", 2, None)], "id string, x int, y int")
        assert {tuple(r) for r in upsert(old, new, ["id"], keep=("x",)).collect()} == {("a", 1, 1), ("b", 1, 2), ("c", 2, None)}

    def test_relations_and_cascade(self, spark):
        rel = TestGraphAndStats().edges(spark, ("a", "b", 0.4), ("b", "b", 1.0), ("b", "c", 0.3))
        kept = put_relations(rel.limit(0), rel.unionAll(rel))
        assert {r.id for r in kept.collect()} == {"ab", "bc"}
        e = spark.createDataFrame([entity(x, "fact") for x in "abc"], ENTITY)
        out = cascade_delete({"entities": e, "relations": kept}, spark.createDataFrame([("a",), ("a",)], "id string"))
        assert {r.id for r in out["relations"].collect()} == {"bc"} and out["entities"].count() == 2

    def test_noise(self, spark):
        rows = [entity("a", "fact", "15:20 UTC up"), entity("b", "tech", "json"), entity("c", "tech", "2026-05"), entity("d", "project", days=15, count=1), entity("e", "project", days=14, count=1)]
        got = {(r.id, r.reason) for r in maintain.noisy(spark.createDataFrame(rows, ENTITY), TODAY).collect()}
        assert got == {("a", "noisy_fact"), ("b", "common_tech"), ("c", "structural_tech"), ("d", "stale_provisional")}


class TestRegistry:
    TEXT = "# x\n## 项目标准\n### 进行中（active）\n<!-- - **Hidden** -->\n- **家庭大脑** `slug: other`\n  - 别名: 家居大脑、HB\n  - 预算: 1 🔒\n### 已归档\n- **Old**\n  - 状态: paused\n## next\n- **No**\n"

    def test_entries(self):
        got = registry.parse_registry(self.TEXT)
        assert [(p.canonical_name, p.slug, p.aliases, p.status) for p in got] == [("家庭大脑", "other", ["家居大脑", "HB"], "active"), ("Old", "", [], "paused")]
        assert "预算" not in registry.lexicon_json(got)

    def test_ids(self, spark):
        got = {r.id for r in registry.registered_ids(spark, registry.parse_registry(self.TEXT)).collect()}
        assert got == {"proj:jiatingdanao", "proj:jiajudanao", "proj:hb", "proj:old"}


class TestIngestion:
    def test_end_to_end(self, spark, tmp_path):
        folder = tmp_path / "notes"
        folder.mkdir()
        (folder / "2026-03-01.md").write_text(queries.NOTE_TEXT, encoding="utf-8")
        (folder / "sample_2026-03-02.md").write_text("## 决策与结论\n- 决定使用PostgreSQL存储，已确认\n", encoding="utf-8")
        (folder / "2026-03-03.md").write_text("nothing here\n", encoding="utf-8")
        (folder / "readme.md").write_text("## 决策与结论\n- 不是日记\n", encoding="utf-8")
        store = Store(spark, str(tmp_path / "store"))
        run = consolidate(store, [("lab", str(folder))], TODAY, embedder=None)
        assert (run.processed, run.skipped, run.status) == (3, 0, "ok"), run
        first = {r.id: r for r in store.read("entities").collect()}
        assert first["decision:shiyongpostgresqlcunchu"].day_count == 2
        again = consolidate(store, [("lab", str(folder))], TODAY)
        assert (again.processed, again.skipped) == (1, 2)  # the file without items comes back
        tools = Knowledge(store, TODAY)
        hits = tools.knowledge_search("50%", entity_type="decision", log=True).collect()
        assert hits == []
        hits = tools.knowledge_search("使用PostgreSQL", entity_type="decision", log=True).collect()
        assert [h.entity_id for h in hits] == ["decision:shiyongpostgresqlcunchu"]
        assert store.read("access_log").count() == 1
        assert {r.status for r in tools.day(dt.date(2026, 3, 3)).collect()} == {"empty"}
        assert tools.knowledge_stats()["totals"].first().entities == len(first)
        assert {k: df.count() for k, df in tools.knowledge_trace("nowhere at all").items()} == dict.fromkeys(("entity", "timeline", "related", "decisions"), 0)
        found = tools.knowledge_trace("decision:shiyongpostgresqlcunchu")
        assert found["timeline"].first().date == dt.date(2026, 3, 1) and [r.place for r in found["decisions"].collect()] == [0]
        self.served(store, folder)
        self.pruned(store)

    def served(self, store, folder):
        """The same through the server: JSON, clamps, errors."""
        tools = server.Tools(store, lambda: TODAY, [("lab", str(folder))])
        said = [
            {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
            {"id": 3, "method": "tools/call", "params": {"name": "knowledge_search", "arguments": {"query": "PostgreSQL", "max_results": 999, "offset": -3}}},
            {"id": 4, "method": "tools/call", "params": {"name": "knowledge_consolidate"}}, {"id": 5, "method": "tools/call", "params": {"name": "none"}},
            {"id": 6, "method": "resources/read", "params": {"uri": "knowledge://entity/decision:shiyongpostgresqlcunchu"}},
            {"id": 7, "method": "resources/read", "params": {"uri": "knowledge://days/2026-03-01"}}, {"id": 8, "method": "nothing"},
            {"id": 9, "method": "tools/call", "params": {"name": "knowledge_trace", "arguments": {"topic": "nowhere at all", "max_depth": 99}}},
            {"id": 10, "method": "tools/call", "params": {"name": "knowledge_stats"}}, {"id": 11, "method": "resources/read", "params": {"uri": "knowledge://days/soon"}},
        ]
        out = io.StringIO()
        server.serve(tools, io.StringIO("\n".join([*map(json.dumps, said), "", "not json"])), out)
        got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
        text = lambda i: json.loads(got[i]["result"]["content"][0]["text"])
        assert set(got) == {1, *range(2, 12), None} and got[None]["error"]["code"] == -32700
        assert {t["name"] for t in got[2]["result"]["tools"]} == set(server.NAMES) and len(server.NAMES) == 7
        assert [r["entity_id"] for r in text(3)["results"]] == ["tech:postgresql"] and text(3)["total_hits"] == 1
        assert got[4]["result"]["isError"] and text(4)["isError"] and got[5]["result"]["isError"] and "error" in text(5)
        assert {r["from_entity"] for r in json.loads(got[6]["result"]["contents"][0]["text"])["relations"]} == {"decision:shiyongpostgresqlcunchu"}
        assert len(json.loads(got[7]["result"]["contents"][0]["text"])["files"]) == 1 and got[8]["error"]["code"] == -32601
        assert text(9) == {"entity": None, "timeline": [], "related": [], "decisions": []}
        assert text(10)["entities"] == store.read("entities").count() and text(10)["size_mb"] > 0
        assert json.loads(got[11]["result"]["contents"][0]["text"])["isError"]

    def pruned(self, store):
        """A dry run writes nothing; a run removes stale projects for good."""
        before = store.version("entities")
        assert maintain.maintain(store, TODAY, dry_run=True)["ids"] == 1 and store.version("entities") == before
        report = maintain.maintain(store, TODAY)
        assert report["reasons"] == {"stale_provisional": 1}
        assert report["after"]["entities"] == report["before"]["entities"] - 1
        assert not {"proj:homebrain"} & {r.id for r in store.read("mentions").collect()}
        assert embed_again(store, lambda texts: [[1.0] for _ in texts]) == report["after"]["entities"]

    def test_search_filters_before_limits(self, spark):
        """Fifty facts nearer, and better, than ten risks: five risks are five risks."""
        rows = [entity(f"f{i:02}", "fact", "alpha", "beta", 0.9, count=9) for i in range(50)] + [entity(f"r{i}", "risk", "alpha", "beta gamma", 0.1) for i in range(10)]
        rows += [entity(f"p{i}", "project", "alpha", "beta", count=1) for i in range(30)]
        e = spark.createDataFrame(rows, ENTITY).withColumn("metadata", F.create_map(F.lit("source"), F.when(F.col("id") == "r7", "lab").otherwise("home")))
        near = spark.createDataFrame([(r[0], [1.0, 0.0 if r[1] != "risk" else 0.5]) for r in rows], "entity_id string, embedding array<float>")
        tables = Snapshot(entities=e, relations=TestGraphAndStats().edges(spark, ("r1", "r2", 0.5)), vectors=near)
        for embedder in (None, lambda texts: [[1.0, 0.0]]):
            know = Knowledge(tables, TODAY, embedder=embedder)
            ids = lambda **kw: [r.id for r in know.hits("alpha", **kw).collect()]
            assert len(ids(entity_type="risk", max_results=5)) == 5
            assert ids(source="lab", max_results=5) == ["r7"]
            assert not any(i.startswith("p") for i in ids(max_results=100)) and len(ids(max_results=100)) == 60
            score = {r.id: r.score for r in know.hits("alpha", max_results=100).collect()}
            assert score["f00"] > score["r0"] > 0.3 or score["r0"] > score["f00"]
            low, high = sorted((score["f00"], score["r0"]))
            best = {i[0] for i in ids(min_score=(low + high) / 2, max_results=5)}
            assert len(best) == 1 and len(ids(min_score=(low + high) / 2, max_results=5)) == 5
            assert ids(entity_type="risk", max_results=3, offset=8) == ["r8", "r9"]

    def test_edited_files_lose_their_links(self, spark, tmp_path):
        folder = tmp_path / "notes"
        folder.mkdir()
        (folder / "2026-03-01.md").write_text(queries.NOTE_TEXT, encoding="utf-8")
        (folder / "2026-03-02.md").write_bytes(b"## \xff\xfe")
        store = Store(spark, str(tmp_path / "store"))
        run = consolidate(store, [("lab", str(folder))], TODAY)
        assert (run.processed, run.failed, run.status) == (1, 1, "partial") and "2026-03-02.md" in run.errors[0]
        assert store.read("relations").count() > 3
        (folder / "2026-03-01.md").write_text("## 决策与结论\n- 决定使用PostgreSQL存储，已确认\n", encoding="utf-8")
        (folder / "2026-03-02.md").write_text("## 风险与注意事项\n- 磁带备份存在丢失风险，需要复查\n", encoding="utf-8")
        run = consolidate(store, [("lab", str(folder))], TODAY)
        assert (run.processed, run.failed, run.status) == (2, 0, "ok")
        assert [r.id for r in store.read("relations").collect()] == ["rel:decision:shiyongpostgresqlcunchu->tech:postgresql:RELATES_TO"]

    def test_tools_do_not_need_an_item(self, spark, tmp_path):
        """An empty store answers with empty results."""
        tools = server.Tools(Store(spark, str(tmp_path / "none")), lambda: TODAY, [])
        for name, args in (("knowledge_search", {"query": "x"}), ("active_projects", {}), ("preference_lookup", {}), ("decision_history", {"topic": "x"})):
            text, bad = server.call(tools, name, args)
            assert not bad and not any(v for v in json.loads(text).values()), text

    def test_missing_folder(self, spark, tmp_path):
        assert consolidate(Store(spark, str(tmp_path / "s")), [("x", str(tmp_path / "none"))], TODAY).processed == 0

    def test_embedding(self, spark):
        df = spark.createDataFrame([entity("a", "fact", "ok"), entity("b", "fact", "bad")], ENTITY)
        got = embed(df, lambda texts: [[0.5] if t.startswith("ok") else [] for t in texts]).collect()
        assert [(r.entity_id, r.embedding) for r in got] == [("a", [0.5])]
        assert from_environment({}) is None
        assert from_environment({"EMBEDDING_API_URL": "http://localhost:1", "EMBEDDING_MODEL": "m"}).local
        assert from_environment({"EMBEDDING_API_URL": "http://far", "EMBEDDING_MODEL": "m"}) is None

    def test_clamp(self):
        assert [clamp(x, 1, 5) for x in (-1, 3, 9)] == [1, 3, 5]


def test_entry(spark):
    assert queries.entry(spark, "/root/testdata/sf0.001").count() > 0


def _alone(code: str) -> str:
    """What ``code`` prints in a process of its own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_without_the_corpus_operators():
    """The entry point works without the optional modules, and hides no other fault."""
    absent = "class No:\n  def find_spec(s, name, *a):\n    if name in ('corpus_pipeline', 'daybook.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n"
    count = "import __spark_entry__ as e\nprint(len([q for q in e.queries() if q[:2] == 'op' and q[2].isdigit() or q == 'pipeline']), len(e.queries()) > 80)"
    assert _alone("import sys\n" + absent + count).split() == ["0", "True"]
    broken = "class No:\n  def find_spec(s, name, *a):\n    if name == 'xxhash': raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\n"
    said = _alone("import sys\n" + broken + "try:\n  import __spark_entry__\n  print('hidden')\nexcept ModuleNotFoundError as e:\n  print('told')")
    import importlib.util

    if importlib.util.find_spec("daybook.llm") is not None:
        assert said.strip() == "told"


def test_tables_of_expected_values_are_complete():
    assert {r[0] for r in queries_notes._MENTIONS} == {r[0] for r in queries_notes.ITEMS} - {13, 14}
