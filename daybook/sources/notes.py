"""Daily note files as DataFrames: files, and the items inside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.schemas import ITEMS
from daybook.vocab import RAW_TITLES, SECTION_TYPES, SUMMARY_TITLES, TAG_TYPES

FILE_NAME = r"^(?:sample_)?(\d{4}-\d{2}-\d{2})\.md$"
#: A name that dates a file without frontmatter; samples have no date of their own.
DATED_NAME = r"^(\d{4}-\d{2}-\d{2})\.md$"


def parse_source_list(text: str | None, default: str = "notes") -> list[tuple[str, str]]:
    """``name=path:path2`` as (name, path) pairs; a path without a name has its last part's."""
    out = []
    for part in filter(None, (p.strip() for p in (text or default).split(":"))):
        name, eq, path = part.partition("=")
        out.append((name.strip(), path.strip()) if eq else (part.rstrip("/").rsplit("/", 1)[-1], part))
    return out


def read_files(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """All note files of (name, folder) pairs: source, date, file_name, path, sha256, content,
    error, title, stated_date. Other file names and hidden files are passed over; a missing
    folder has no files. A file that is not UTF-8 has an ``error`` and no content. The stated
    date is the frontmatter's, or else that of the name, unless it is a sample's."""
    out = None
    for name, folder in sources:
        got = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("ignoreMissingFiles", "true").load(folder)
            if _exists(spark, folder)
            else spark.createDataFrame([], "path string, content binary")
        )
        own = (
            got.select("path", "content")
            .withColumn("file_name", F.element_at(F.split("path", "/"), -1))
            .filter(F.col("file_name").rlike(FILE_NAME))
            .select(
                F.lit(name).alias("source"),
                F.try_to_date(F.regexp_extract("file_name", FILE_NAME, 1)).alias("date"),
                "file_name",
                "path",
                F.sha2("content", 256).alias("sha256"),
                F.col("content").cast("string").alias("content"),
            )
            .withColumn("error", F.when(~F.is_valid_utf8("content"), "malformed UTF-8"))
            .withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
        )
        title, stated = frontmatter("content")
        by_name = F.try_to_date(F.nullif(F.regexp_extract("file_name", DATED_NAME, 1), F.lit("")))
        own = own.withColumns({"title": title, "stated_date": F.coalesce(F.try_to_date(F.nullif(stated, F.lit(""))), by_name)})
        out = own if out is None else out.unionByName(own)
    return out


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def frontmatter(content: str = "content"):
    """(title, date) of a leading block between ``---`` lines, quotes removed."""
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\R(.*?)\R[ \t]*---[ \t]*(?:\R|\z)", 1)

    def value(key: str):
        return F.regexp_extract(block, rf"(?m)^[ \t]*{key}[ \t]*:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)

    return value("title"), value("date")


_BULLET = re.compile(r"- (?:(\d{1,2}:\d{2}(?::\d{2})?)\s*[-–—]\s*)?(.*)", re.S)
_TAGGED = re.compile(r"\[([^\]]+)\]\s+(.+)")
_CLOCK = re.compile(r"\d{1,2}:\d{2}")


class _Reader:
    """Reads one file's lines; ``rows`` are its items.

    Any second-level heading ends a raw or summary subsection. An item belongs to the latest
    section of its category, or opens one named by the first heading of that category."""

    def __init__(self) -> None:
        self.mode, self.kind, self.rows, self.sections = "default", None, [], []
        self.open: dict | None = None

    def section(self, title: str, kind: str) -> None:
        self.kind = kind
        self.sections.append((title, kind))

    def close(self) -> None:
        if self.open:
            self.rows.append(self.open)
            self.open = None

    def item(self, text: str, time: str | None, line: int, kind: str, tag: str | None) -> None:
        home = next((i for i in range(len(self.sections) - 1, -1, -1) if self.sections[i][1] == kind), None)
        if home is None:
            title = next(t for t, k in SECTION_TYPES.items() if k == kind)
            self.sections.append((title, kind))
            home = len(self.sections) - 1
        self.open = {
            "section_ord": home, "section_title": self.sections[home][0], "category": kind, "text": text.strip(), "time": time,
            "line_start": line, "line_end": line, "skip_extraction": self.mode == "raw", "tag": tag,
        }

    def heading(self, line: str) -> bool:
        marks, _, title = line.partition(" ")
        title = title.strip()
        if marks == "###":
            self.mode = "raw" if title in RAW_TITLES else "summary" if title in SUMMARY_TITLES else "default"
        elif marks == "##":
            self.mode = "default"
            if _CLOCK.match(title):
                self.kind = None
            else:
                self.section(title, SECTION_TYPES.get(title, "fact"))
        elif line.startswith("**") and line.endswith("**") and len(line) > 4:
            title = line[2:-2].strip()
            if title not in SECTION_TYPES:
                return False
            self.section(title, SECTION_TYPES[title])
        else:
            return False
        return True

    def line(self, number: int, line: str) -> None:
        bare = line.strip()
        if self.open is not None:
            # An indented line goes on with the item, unless a bullet or a heading begins.
            stops = bare.startswith("- ") or (line.startswith("##") if self.open["tag"] is None else bare.startswith("#") or bool(_TAGGED.match(bare)))
            if bare and line[:1] in " \t" and not stops:
                self.open["text"] += " " + bare
                self.open["line_end"] = number
                return
            self.close()
        if not bare or self.heading(bare if bare.startswith("**") else line.rstrip()):
            return
        if self.mode == "summary":
            tagged = _TAGGED.match(bare)
            if tagged and tagged[1] in TAG_TYPES:
                self.item(tagged[2], None, number, TAG_TYPES[tagged[1]], tagged[1])
        elif bare.startswith("- ") and self.kind:
            time, text = _BULLET.fullmatch(bare).groups()
            if text.strip():
                self.item(text, time, number, self.kind, None)


def items_of(content: str) -> list[dict]:
    """The items of one file. Text before the body (frontmatter) is passed over."""
    lines = content.splitlines()
    start = 0
    if lines and lines[0].strip() == "---":
        start = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
    reader = _Reader()
    for i in range(start, len(lines)):
        reader.line(i + 1, lines[i])
    reader.close()
    return sorted(reader.rows, key=lambda r: (r["section_ord"], r["line_start"]))


def parse_checked(files: DataFrame) -> DataFrame:
    """One row per item, with ``error`` null; a file that cannot be read has one row with an
    error and no item. Files go in batches, each is read whole by one task."""
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "date": pa.date32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in (ITEMS + ", error string").split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                own = {k: f[k] for k in ("source", "date", "file_name")}
                try:
                    if f["error"]:
                        raise ValueError(f["error"])
                    rows += [{**own, "item_ord": nth, **item} for nth, item in enumerate(items_of(f["content"] or ""))]
                except Exception as e:  # noqa: BLE001 - a bad file must not stop the others
                    rows.append({**own, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("source", "date", "file_name", "content", error).mapInArrow(run, ITEMS + ", error string")


def parse(files: DataFrame) -> DataFrame:
    """The items of all files that can be read."""
    return parse_checked(files).filter("error IS NULL").drop("error")
