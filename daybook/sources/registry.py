"""The project registry: a hand-written section of one markdown file, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import entity_id

#: The section's heading, status words, and the fields that count.
SECTION = "项目标准"
STATUS_WORDS = {"进行中": "active", "已完成": "completed", "已归档": "archived"}
ALIASES, STATUS = "别名", "状态"


@dataclass
class Project:
    canonical_name: str
    slug: str = ""
    aliases: list[str] = field(default_factory=list)
    status: str = "active"


def parse_registry(text: str) -> list[Project]:
    """Projects of the section, HTML comments removed; unknown fields are left out."""
    body = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    found = re.search(rf"^##[ \t]+{SECTION}[ \t]*$(.*?)(?=^##[ \t]|\Z)", body, flags=re.M | re.S)
    out: list[Project] = []
    status = "active"
    for line in (found[1] if found else "").splitlines():
        if m := re.match(r"###\s+(.*)", line):
            word = re.search(r"[(（]\s*(\w+)\s*[)）]", m[1])
            status = word[1].lower() if word else next((s for w, s in STATUS_WORDS.items() if w in m[1]), "active")
        elif m := re.match(r"-\s+\*\*(.+?)\*\*(?:.*?`\s*slug:\s*([^`]*?)\s*`)?", line):
            out.append(Project(m[1].strip(), m[2] or "", [], status))
        elif out and (m := re.match(r"\s+-\s+([^:：]+)[:：]\s*(.*)", line)):
            value = m[2].replace("🔒", "").strip()
            if m[1].strip() == ALIASES:
                out[-1].aliases += [a.strip() for a in re.split("[,、，]", value) if a.strip()]
            elif m[1].strip() == STATUS and value:
                out[-1].status = STATUS_WORDS.get(value, value)
    return out


def load(spark: SparkSession, path: str) -> list[Project]:
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    return [p for r in rows for p in parse_registry(r.value)]


def lexicon(projects: list[Project]) -> list[dict]:
    """What may be shown of the registry: names, aliases and status."""
    return [{"canonical": p.canonical_name, "aliases": p.aliases, "status": p.status} for p in projects]


def lexicon_json(projects: list[Project]) -> str:
    return json.dumps(lexicon(projects), ensure_ascii=False)


def registered_ids(spark: SparkSession, projects: list[Project]) -> DataFrame:
    """(id): ids that the names and aliases get as projects; the hand-written slug is no id."""
    names = [(n,) for p in projects for n in (p.canonical_name, *p.aliases)]
    return spark.createDataFrame(names, "name string").select(entity_id(F.lit("project"), F.col("name")).alias("id")).distinct()
