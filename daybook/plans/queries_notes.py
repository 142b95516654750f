"""Registered queries of the note format: files, items, mentions, registry, ingestion. The
driver's tables hold no notes, so these run over notes written here; what they must give is
worked out from the rules and stands in the SQL as values."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import text as tx
from daybook.operators import extract, link, search
from daybook.plans.consolidate import consolidate
from daybook.plans.queries import NOTE_TEXT, query
from daybook.sources import registry
from daybook.sources.notes import parse_source_list, read_files
from daybook.sources.scratch import shared_folder
from daybook.sources.store import Store

TODAY = dt.date(2026, 4, 1)
#: A note of the day after, before and after it is edited.
SECOND = "## 决策与结论\n- 决定使用PostgreSQL存储，已确认\n## 风险与注意事项\n- 磁带备份存在丢失风险，需要复查\n"
EDITED = "## 决策与结论\n- 决定使用PostgreSQL存储，已确认\n"
FILES = {
    "lab/2026-03-01.md": NOTE_TEXT.encode(),
    "lab/sample_2026-03-02.md": SECOND.encode(),
    "lab/2026-03-03.md": b"nothing here\n",
    "lab/2026-03-04.md": b"## \xff\xfe\n",
    "lab/readme.md": SECOND.encode(),
    "home/2026-03-02.md": "---\ntitle: 'At home'\ndate: 2026-02-28\n---\n## 用户偏好与习惯\n- 用户偏好深色主题，不要弹窗\n".encode(),
}


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


def _folder(spark: SparkSession) -> str:
    """A new folder with the files above."""
    root = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    for name, data in FILES.items():
        _put(spark, f"{root}/{name}", data)
    return root


def _sources(root: str) -> list[tuple[str, str]]:
    # The list's separator stands in urls too: names first, folders after.
    return [(name, f"{root}/{folder}") for name, folder in parse_source_list("lab=lab:home:gone=none")]


_made: dict[str, tuple[Store, list]] = {}


def _ingested(spark: SparkSession) -> tuple[Store, list]:
    """A store after three runs: all files, nothing new, one file edited. Made once a session."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        root = _folder(spark)
        store, runs = Store(spark, f"{root}/store"), []
        for edit in (False, False, True):
            if edit:
                _put(spark, f"{root}/lab/sample_2026-03-02.md", EDITED.encode())
            runs.append(consolidate(store, _sources(root), TODAY))
        _made[app] = (store, runs)
    return _made[app]


def _text(data: bytes) -> str:
    return "'" + data.decode().replace("'", "''") + "'"


@query(
    "SELECT source, date::DATE AS date, file_name, sha256, error, title, stated_date::DATE AS stated_date FROM (VALUES "
    f"('lab', '2026-03-01', '2026-03-01.md', sha256({_text(FILES['lab/2026-03-01.md'])}), NULL, 'A day', '2026-03-01'), "
    f"('lab', '2026-03-02', 'sample_2026-03-02.md', sha256({_text(FILES['lab/sample_2026-03-02.md'])}), NULL, '', NULL), "
    f"('lab', '2026-03-03', '2026-03-03.md', sha256({_text(FILES['lab/2026-03-03.md'])}), NULL, '', '2026-03-03'), "
    "('lab', '2026-03-04', '2026-03-04.md', sha256('## \\xFF\\xFE\\x0A'::BLOB), 'malformed UTF-8', NULL, '2026-03-04'), "
    f"('home', '2026-03-02', '2026-03-02.md', sha256({_text(FILES['home/2026-03-02.md'])}), NULL, 'At home', '2026-02-28')) v(source, date, file_name, sha256, error, title, stated_date)"
)
def note_file_list(spark, sf):
    """Note files of two folders and a missing one: dates, hashes, titles, errors."""
    return read_files(spark, _sources(_folder(spark))).select("source", "date", "file_name", "sha256", "error", "title", "stated_date")


@query(
    "SELECT * FROM (VALUES (1, 4::BIGINT, 0::BIGINT, 1::BIGINT, 'partial', 'lab/2026-03-04.md'), (2, 1, 3, 1, 'partial', 'lab/2026-03-04.md'), (3, 2, 2, 1, 'partial', 'lab/2026-03-04.md')) "
    "v(run, processed, skipped, failed, status, bad)"
)
def ingest_runs(spark, sf):
    """The counters of three runs. The file without items comes back each time, and so does
    the one that cannot be read, which stops no other."""
    rows = [(i, r.processed, r.skipped, r.failed, r.status, r.errors[0].split(": ")[0]) for i, r in enumerate(_ingested(spark)[1], 1)]
    return spark.createDataFrame(rows, "run int, processed bigint, skipped bigint, failed bigint, status string, bad string")


#: Items as (number, section, tag, text), written for this query.
ITEMS = [
    (1, "决策与结论", None, "决定使用PostgreSQL存储，旧库停用"),
    (2, "决策与结论", None, "采用双写方案，放弃旧接口。选择RabbitMQ，下周开始"),
    (3, "用户偏好与习惯", None, "用户偏好深色主题，不要弹窗"),
    (4, "用户偏好与习惯", None, "用户要求每周汇报进度；周五发送"),
    (5, "风险与注意事项", None, "磁带备份存在丢失风险，需要每周演练"),
    (6, "风险与注意事项", None, "升级可能导致服务中断"),
    (7, "已完成事项", None, "完成了ESP32网关迁移，运行稳定"),
    (8, "待办与计划", None, "计划迁移HomeBrain 项目的日志，后续编写文档"),
    (9, "核心要点", None, "讨论了 XiaomiDriver、WebSocket 的实现，按照必须的项目推进"),
    (10, "技术/项目要点", None, "see `nginx.conf` and config.yaml for v2.1 details"),
    (11, "核心要点", "待办", "整理实验室的线缆，周末处理"),
    (12, "核心要点", "关键风险", "磁盘老化，注意备份"),
    (13, "核心要点", None, "心跳轮询正常"),
    (14, "核心要点", None, "简短的一句话"),
    (15, "创意与想法", None, "用语音控制窗帘。先做一个样机"),
    (16, "完全别的标题", None, "心连心项目进展顺利，团队满意"),
]


def _items(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(ITEMS, "n int, section_title string, tag string, text string")
    return own.selectExpr(
        "'lab' AS source", "DATE '2026-01-01' AS date", "concat('f', n, '.md') AS file_name", "0 AS section_ord", "section_title", "'' AS category", "n AS item_ord",
        "text", "CAST(NULL AS string) AS time", "n AS line_start", "n + 1 AS line_end", "n = 17 AS skip_extraction", "tag",
    )


_T = "技术栈关键词: "
_MENTIONS = [
    (1, "decision:shiyongpostgresqlcunchu", "使用PostgreSQL存储", None, ITEMS[0][3]), (1, "tech:postgresql", "PostgreSQL", None, _T + "PostgreSQL"),
    (2, "decision:shuangxie", "双写", None, ITEMS[1][3]), (2, "decision:jiujiekou", "旧接口", None, ITEMS[1][3]), (2, "decision:rabbitmq", "RabbitMQ", None, ITEMS[1][3]),
    (2, "tech:rabbitmq", "RabbitMQ", None, _T + "RabbitMQ"), (3, "pref:shensezhuti", "深色主题", None, ITEMS[2][3]), (4, "pref:meizhouhuibaojindu", "每周汇报进度", None, ITEMS[3][3]),
    (5, "risk:cidaibeifencunzaidiushi", "磁带备份存在丢失", None, ITEMS[4][3]), (6, "risk:shengji_fuwuzhongduan", "升级：服务中断", None, ITEMS[5][3]),
    (7, "task:wancheng_esp32wangguanqianyi", "ESP32网关迁移", "completed", ITEMS[6][3]), (7, "tech:esp32", "ESP32", None, _T + "ESP32"), (7, "task:esp32wangguanqianyi", "ESP32网关迁移", None, ITEMS[6][3]),
    (8, "task:jihua_bianxiewendang", "编写文档", "todo", ITEMS[7][3]), (8, "task:jihua_qianyihomebrain_xiangmud", "迁移HomeBrain 项目的日志", "todo", ITEMS[7][3]),
    (8, "proj:homebrain", "HomeBrain", None, ITEMS[7][3]), (8, "task:bianxiewendang", "编写文档", None, ITEMS[7][3]),
    (9, "tech:xiaomidriver", "XiaomiDriver", None, _T + "XiaomiDriver"), (9, "tech:websocket", "WebSocket", None, _T + "WebSocket"),
    (9, "fact:taolunle_xiaomidriver_websocke", "讨论了 XiaomiDriver、WebSocket 的实现", None, ITEMS[8][3]),
    (10, "tech:nginx_conf", "nginx.conf", None, _T + "nginx.conf"), (10, "tech:config_yaml", "config.yaml", None, _T + "config.yaml"), (10, "tech:v2_1", "v2.1", None, _T + "v2.1"),
    (11, "task:zhenglishiyanshidexianlan", "整理实验室的线缆", "todo", ITEMS[10][3]), (12, "risk:cipanlaohua", "磁盘老化，", None, ITEMS[11][3]),
    (15, "idea:yongyuyinkongzhichuanglian", "用语音控制窗帘", None, ITEMS[14][3]),
    (16, "proj:xinlianxin", "心连心", None, ITEMS[15][3]), (16, "fact:xinlianxinxiangmujinzhanshunli", "心连心项目进展顺利", None, ITEMS[15][3]),
]


def _values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({names})"


@query(f"SELECT n::INT AS item_ord, id, name, status, summary, 'f' || n || '.md:' || n || ':' || (n + 1) AS source_line FROM {_values(_MENTIONS, 'n, id, name, status, summary')}")
def extract_items(spark, sf):
    """Mentions by every rule: decisions, preferences, risks, tasks, projects, terms, tags,
    sections, the item itself; heartbeat noise and items that repeat their text give none."""
    return extract.mentions(_items(spark)).filter("nth = 1").select("item_ord", "id", "name", "status", "summary", "source_line")


@query(f"SELECT * FROM {_values([(i, x in (13,)) for i, x in ((r[0], r[0]) for r in ITEMS)], 'n, garbage')}")
def garbage_items(spark, sf):
    return spark.createDataFrame(ITEMS, "n int, section_title string, tag string, text string").select("n", tx.is_garbage_text(F.col("text")).alias("garbage"))


_NAMES = [("15:20 UTC up", True), ("[01:03] x", True), ("3.14", True), ("2h", True), ("**x", True), ("：x", True), ("，。", True), ("x", True), ("任务", True), ("  ", True), ("HomeBrain", False), ("规则引擎", False), ("v2.1", False), ("P0", False)]


@query(f"SELECT * FROM {_values(_NAMES, 'name, garbage')}")
def garbage_names(spark, sf):
    return spark.createDataFrame([(n,) for n, _ in _NAMES], "name string").select("name", tx.is_garbage_name(F.col("name")).alias("garbage"))


_PROJECTS = [
    ("推进心连心项目", "心连心"), ("HomeBrain 项目上线", "HomeBrain"), ("Esp32 项目启动", "Esp32"), ("the HomeBrain project shipped", "HomeBrain"),
    ("归其他工作分类而非新建项目", None), ("任务归属匹配已有项目", None), ("无成熟项目", None), ("这是一个项目", None), ("修改全部项目", None), ("工作记录必须按项目归属分组", None),
]


@query(f"SELECT * FROM {_values(_PROJECTS, 'text, name')}")
def project_names(spark, sf):
    """Project names by their marks, and phrases that only look like names."""
    own = spark.createDataFrame([(x,) for x, _ in _PROJECTS], "text string")
    return own.select("text", F.array_join(F.transform(extract.projects(F.col("text")), lambda c: c["name"]), ",").alias("name")).withColumn("name", F.nullif("name", F.lit("")))


# --- names and stances -----------------------------------------------------------------

_RATIOS = [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("abcd", "bcde", 0.75), ("", "", 1.0), ("a", "", 0.0), ("homebrain", "homebrain", 1.0), ("abxcd", "abcd", 8 / 9)]


@query(f"SELECT a, b, round(ratio, 6) AS ratio FROM {_values(_RATIOS, 'a, b, ratio')}")
def matching_ratios(spark, sf):
    """2M / (la + lb) by hand: of 'tide' and 'diet' one letter matches one way, two the other."""
    own = spark.createDataFrame([r[:2] for r in _RATIOS], "a string, b string")
    return own.select("a", "b", F.round(tx.matching_ratio("a", "b"), 6).alias("ratio"))


_SCORED = [("abcd", "has ABCD inside", 0.4, 0.7), ("bcde", "nothing", 1.0, 0.725), ("abcd", "abcd", 1.0, 1.0), ("zz", None, 0.0, 0.0)]


@query(f"SELECT row_number() OVER (ORDER BY n) ::INT AS n, round(score, 6) AS score FROM {_values([(i, r[3]) for i, r in enumerate(_SCORED)], 'n, score')}")
def similarity_scores(spark, sf):
    """Half the importance, 0.3 of the ratio, 0.2 for the words inside; at most 1."""
    own = spark.createDataFrame([(i + 1, *r[:3]) for i, r in enumerate(_SCORED)], "n int, name string, summary string, importance double")
    return own.select("n", F.round(search.similarity_score("ABCD"), 6).alias("score"))


_ALIKE = [
    ("a", "fact", "Database Backup Plan", "2026-01-01", [1.0, 0.0]), ("b", "fact", "database backup plans", "2026-01-20", [1.0, 0.0]), ("c", "fact", "database backups plans", "2026-02-10", [1.0, 0.0]),
    ("d", "task", "database backup plan", "2026-01-02", [1.0, 0.0]), ("e", "fact", "kitchen lights", "2026-01-01", [1.0, 0.0]), ("f", "fact", "kitchen light on", "2026-01-03", [1.0, 0.1]),
    ("g", "fact", "kitchen ligature", "2026-01-05", [0.0, 1.0]), ("i", "fact", "kitchen lightning", "2026-01-06", [1.0, 0.0]), ("h", "fact", "database backup plan", "2026-06-01", [1.0, 0.0]),
]


def _alike(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    own = spark.createDataFrame(_ALIKE, "id string, type string, name string, day string, embedding array<float>")
    return own.select("id", "type", "name", F.to_date("day").alias("first_seen")), own.select(F.col("id").alias("entity_id"), "embedding")


@query(f"SELECT * FROM {_values([('b', 'a'), ('c', 'a'), ('f', 'e'), ('i', 'e')], 'id, canonical')}")
def merged_names(spark, sf):
    """b is a (0.98), c is b and so a; f is e, alike by 0.87; i is f, alike by
    0.85 less a little, as their vectors agree. Not merged: another type (d), too late (h), and
    g, alike to e by 0.73, whose vector is another."""
    entities, vectors = _alike(spark)
    return link.merge_map(link.confirmed_by_vectors(link.similar_names(entities, 0.70), vectors))


_STANCES = [
    ("f", 0, 1, "a", "decision", "x", "采用 Postgres"), ("f", 3, 2, "b", "decision", "y", "放弃 postgres"), ("f", 0, 3, "c", "decision", "z", "放弃 mysql"),
    ("f", 0, 4, "d", "risk", "r", "放弃 postgres"), ("g", 0, 1, "e", "decision", "x", "升级 kafka broker"), ("g", 0, 2, "k", "decision", "y", "回退 broker kafka zookeeper"), ("h", 0, 1, "m", "decision", "x", "放弃 postgres"),
]


@query(f"SELECT * FROM {_values([('rel:a->b:CONTRADICTS', 0.7, 'opposing_stance: postgres'), ('rel:e->k:CONTRADICTS', 0.7, 'opposing_stance: broker,kafka')], 'id, weight, evidence')}")
def contradicting_decisions(spark, sf):
    """Decisions of one file, of any section, that take opposing stances on a shared word."""
    own = spark.createDataFrame(_STANCES, "file string, section int, ord int, id string, type string, name string, summary string")
    return link.contradictions(own).select("id", "weight", "evidence")


# --- registry --------------------------------------------------------------------------

#: A registry file, written for this query.
REGISTRY = """# 记忆
## 项目标准
### 进行中（active）
<!-- - **Hidden** `slug: hidden` -->
- **家庭大脑** `slug: other`
  - 别名: 家居大脑、HB
  - 预算: 1 🔒
### 已归档
- **Old**
  - 状态: paused
### 其他
- **Rule Engine**
## 其他
- **No**
"""


def _registry(spark: SparkSession) -> list:
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}.md"
    _put(spark, path, REGISTRY.encode())
    return registry.load(spark, path)


@query(f"SELECT * FROM {_values([('家庭大脑', 'other', '家居大脑,HB', 'active'), ('Old', '', '', 'paused'), ('Rule Engine', '', '', 'active')], 'name, slug, aliases, status')}")
def registry_entries(spark, sf):
    return spark.createDataFrame([(p.canonical_name, p.slug, ",".join(p.aliases), p.status) for p in _registry(spark)], "name string, slug string, aliases string, status string")


@query(f"SELECT * FROM {_values([(x,) for x in ('proj:jiatingdanao', 'proj:jiajudanao', 'proj:hb', 'proj:old', 'proj:rule_engine')], 'id')}")
def registry_ids(spark, sf):
    """Ids of names and aliases; the hand-written slug is none."""
    return registry.registered_ids(spark, _registry(spark))


@query(f"SELECT * FROM {_values([('家庭大脑', '家居大脑,HB', 'active'), ('Old', '', 'paused'), ('Rule Engine', '', 'active')], 'canonical, aliases, status')}")
def registry_lexicon(spark, sf):
    """What may be shown of the registry: no other field."""
    rows = [(x["canonical"], ",".join(x["aliases"]), x["status"]) for x in registry.lexicon(_registry(spark))]
    return spark.createDataFrame(rows, "canonical string, aliases string, status string")


_SLUGS = [("心连心", "proj:xinlianxin"), ("家庭大脑", "proj:jiatingdanao"), ("ESP32-S3 网关!", "proj:esp32_s3_wangguan"), ("___", "proj:"), ("A" * 40, "proj:" + "a" * 30)]


@query(f"SELECT * FROM {_values(_SLUGS, 'name, id')}")
def slugs_of_any_script(spark, sf):
    return spark.createDataFrame([(n,) for n, _ in _SLUGS], "name string").select("name", tx.entity_id(F.lit("project"), F.col("name")).alias("id"))


# --- ingestion -------------------------------------------------------------------------

_F, _S = "2026-03-01.md", "sample_2026-03-02.md"
_ENTITIES = [
    ("decision:shiyongpostgresqlcunchu", "decision", "使用PostgreSQL存储", "2026-03-01", "2026-03-02", 2, f"{_F}:7:8,{_S}:2:2", None),
    ("pref:shensezhuti", "preference", "深色主题", "2026-03-02", "2026-03-02", 1, "2026-03-02.md:6:6", None),
    ("proj:homebrain", "project", "HomeBrain", "2026-03-01", "2026-03-01", 1, f"{_F}:16:16", None),
    ("risk:cidaibeifencunzaidiushi", "risk", "磁带备份存在丢失", "2026-03-01", "2026-03-01", 1, f"{_F}:10:10", None),
    ("task:esp32wangguan", "task", "ESP32网关", "2026-03-01", "2026-03-01", 1, f"{_F}:14:14", "completed"),
    ("task:jihua_qianyihomebrainxiangmude", "task", "迁移HomeBrain项目的日志", "2026-03-01", "2026-03-01", 1, f"{_F}:16:16", "todo"),
    ("tech:esp32", "tech", "ESP32", "2026-03-01", "2026-03-01", 1, f"{_F}:14:14", None),
    ("tech:homebrain", "tech", "HomeBrain", "2026-03-01", "2026-03-01", 1, f"{_F}:16:16", None),
    ("tech:postgresql", "tech", "PostgreSQL", "2026-03-01", "2026-03-02", 2, f"{_F}:7:8,{_S}:2:2", None),
]


@query(
    f"SELECT id, type, name, first_seen::DATE AS first_seen, last_seen::DATE AS last_seen, day_count::BIGINT AS day_count, source_lines, status FROM {_values(_ENTITIES, 'id, type, name, first_seen, last_seen, day_count, source_lines, status')}"
)
def ingested_entities(spark, sf):
    """Entities after three runs: the days of two notes counted once, the edit's loss gone,
    source lines in order of days. A task and its item have one name and so are one."""
    out = _ingested(spark)[0].read("entities")
    return out.select("id", "type", "name", "first_seen", "last_seen", "day_count", F.array_join("source_lines", ",").alias("source_lines"), F.col("metadata")["status"].alias("status"))


_RELATIONS = [
    ("rel:decision:shiyongpostgresqlcunchu->tech:postgresql:RELATES_TO", 0.5), ("rel:proj:homebrain->task:jihua_qianyihomebrainxiangmude:RELATES_TO", 0.5),
    ("rel:proj:homebrain->tech:homebrain:RELATES_TO", 0.5), ("rel:task:esp32wangguan->tech:esp32:RELATES_TO", 0.5),
    ("rel:task:jihua_qianyihomebrainxiangmude->proj:homebrain:DEPENDS_ON", 0.8), ("rel:task:jihua_qianyihomebrainxiangmude->tech:homebrain:RELATES_TO", 0.5), ("rel:tech:homebrain->proj:homebrain:DEPENDS_ON", 0.8),
]


@query(f"SELECT id, weight::DOUBLE AS weight, 'name_mention' AS evidence FROM {_values(_RELATIONS, 'id, weight')}")
def ingested_relations(spark, sf):
    """Relations after the edit: those of the text that went are gone."""
    return _ingested(spark)[0].read("relations").select("id", "weight", "evidence")


_MANIFEST = [("2026-03-01", "lab", _F, 10, "ok", "A day"), ("2026-03-02", "home", "2026-03-02.md", 1, "ok", "At home"), ("2026-03-02", "lab", _S, 2, "ok", ""), ("2026-03-03", "lab", "2026-03-03.md", 0, "empty", "")]


@query(f"SELECT date::DATE AS date, source, file_name, entity_count::BIGINT AS entity_count, status, title FROM {_values(_MANIFEST, 'date, source, file_name, entity_count, status, title')}")
def ingested_manifest(spark, sf):
    return _ingested(spark)[0].read("manifest").select("date", "source", "file_name", "entity_count", "status", "title")


@query(f"SELECT * FROM {_values([(1, 'knowledge_search', 'PostgreSQL')], 'hits, tool, query')}".replace("SELECT *", "SELECT hits::BIGINT AS hits, tool, query"))
def logged_accesses(spark, sf):
    """A search that is logged appends a row for each hit, here to a copy of the store. A run of
    letters of any script is one word, so the term is found and the decision's name is not."""
    from daybook.plans.tools import Knowledge

    store = _ingested(spark)[0]
    own = Store(spark, f"{shared_folder(spark)}/log-{uuid.uuid4().hex}")
    for name in ("entities", "relations", "postings"):
        own.write(name, store.read(name))
    Knowledge(own, TODAY).knowledge_search("PostgreSQL", log=True)
    return own.read("access_log").groupBy("tool", "query").agg(F.count(F.lit(1)).alias("hits"))
