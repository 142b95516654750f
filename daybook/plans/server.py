"""The tools as JSON: one object per answer, errors as ``{"error", "isError": true}``, and a
server that speaks JSON-RPC, one message per line, on standard input and output."""

from __future__ import annotations

import datetime as dt
import inspect
import json
import os
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.plans.consolidate import consolidate
from daybook.plans.tools import Knowledge
from daybook.sources.store import Store

PROTOCOL = "2024-11-05"


def rows(df: DataFrame) -> list[dict]:
    """The rows of a result, made JSON where they are; null fields stay."""
    made = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return [json.loads(r.j) for r in made.collect()]  # a page, or one report


def _one(df: DataFrame) -> dict:
    got = rows(df)
    return got[0] if got else {}


class Tools:
    """The tools by name, each from JSON arguments to a JSON value. ``today`` is asked for at
    each call, and the store's present version is read."""

    def __init__(self, store: Store, today: Callable[[], dt.date], sources: list[tuple[str, str]], embedder: Callable | None = None, slugs: DataFrame | None = None) -> None:
        self.store, self.today, self.sources, self.embedder, self.slugs = store, today, sources, embedder, slugs

    def _knowledge(self) -> Knowledge:
        return Knowledge(self.store, self.today(), self.slugs, self.embedder)

    def knowledge_search(self, query: str, entity_type: str = "", source: str = "", max_results: int = 10, min_score: float = 0.0, offset: int = 0) -> dict:
        """Entities by keyword or likeness; ordered by importance of today."""
        found = rows(self._knowledge().knowledge_search(query, entity_type or None, source or None, max_results, min_score, offset, log=True))
        return {"results": found, "total_hits": len(found)}

    def knowledge_trace(self, topic: str, max_depth: int = 2) -> dict:
        """What stands around a topic: timeline, related entities, decisions."""
        got = self._knowledge().knowledge_trace(topic, max_depth, log=True)
        return {"entity": _one(got["entity"]) or None} | {k: rows(got[k]) for k in ("timeline", "related", "decisions")}

    def active_projects(self, lookback_days: int = 14) -> dict:
        """Projects seen of late with their tasks."""
        return {"projects": rows(self._knowledge().active_projects(lookback_days, log=True))}

    def preference_lookup(self, topic: str = "", domain: str = "") -> dict:
        """Preferences, strongest first."""
        return {"preferences": rows(self._knowledge().preference_lookup(topic or None, domain or None, log=True))}

    def decision_history(self, topic: str, include_risk: bool = True, offset: int = 0) -> dict:
        """Decisions about a topic, latest first, with risks and follow-ups."""
        return {"decisions": rows(self._knowledge().decision_history(topic, include_risk, offset))}

    def knowledge_stats(self) -> dict:
        """Counts and health of the store."""
        got = self._knowledge().knowledge_stats()
        many = {"by_type": "type", "by_relation": "rel_type", "by_source": "source", "density": "type"}
        out = {k: {r.pop(many[k]): r.get("density", r.get("cnt")) for r in rows(df)} for k, df in got.items() if k in many}
        for k, df in got.items():
            if k not in many:
                out |= _one(df) if k not in ("quartiles",) else {"importance_distribution": _one(df)}
        return out | {"embedding_model": os.environ.get("EMBEDDING_MODEL", ""), "size_mb": self.store.size_mb()}

    def knowledge_consolidate(self) -> dict:
        """Reads new and changed note files. Needs an embedder."""
        if self.embedder is None:
            raise RuntimeError("no embedder: set EMBEDDING_API_URL, EMBEDDING_MODEL and EMBEDDING_API_KEY")
        r = consolidate(self.store, self.sources, self.today(), self.embedder)
        return {"status": r.status, "files_processed": r.processed, "files_skipped": r.skipped, "entities_created": r.created, "entities_updated": r.updated, "errors": r.errors}


NAMES = ("knowledge_search", "knowledge_trace", "active_projects", "preference_lookup", "decision_history", "knowledge_stats", "knowledge_consolidate")
_KINDS = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def call(tools: Tools, name: str, arguments: dict) -> tuple[str, bool]:
    """(JSON text, whether it is an error)."""
    try:
        if name not in NAMES:
            raise KeyError(f"no tool {name}")
        return _dump(getattr(tools, name)(**arguments)), False
    except Exception as e:  # noqa: BLE001 - the client gets the error
        return _dump({"error": str(e).split("\n")[0], "isError": True}), True


def read(tools: Tools, uri: str) -> str:
    """Resources: ``knowledge://stats``, ``knowledge://entity/{id}``, ``knowledge://days/{date}``."""
    kind, _, rest = uri.removeprefix("knowledge://").partition("/")
    try:
        if kind == "stats":
            return _dump(tools.knowledge_stats())
        if kind == "entity":
            own, edges = tools._knowledge().entity(rest)
            found = _one(own)
            return _dump(found | {"relations": rows(edges)} if found else {"error": f"no entity {rest}", "isError": True})
        if kind == "days":
            days = rows(tools._knowledge().day(dt.date.fromisoformat(rest)))
            return _dump({"date": rest, "files": days} if days else {"error": f"no day {rest}", "isError": True})
        raise KeyError(f"no resource {uri}")
    except Exception as e:  # noqa: BLE001
        return _dump({"error": str(e).split("\n")[0], "isError": True})


def listed() -> list[dict]:
    out = []
    for name in NAMES:
        f = getattr(Tools, name)
        own = [p for p in inspect.signature(f).parameters.values() if p.name != "self"]
        schema = {"type": "object", "properties": {p.name: {"type": _KINDS[str(p.annotation)]} for p in own}, "required": [p.name for p in own if p.default is p.empty]}
        out.append({"name": name, "description": f.__doc__, "inputSchema": schema})
    return out


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; notifications have none."""
    method, own = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    if method == "initialize":
        result: dict = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "daybook", "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": listed()}
    elif method == "tools/call":
        text, bad = call(tools, own.get("name", ""), own.get("arguments") or {})
        result = {"content": [{"type": "text", "text": text}], "isError": bad}
    elif method == "resources/list":
        result = {"resources": [{"uri": "knowledge://stats", "name": "stats"}]}
    elif method == "resources/templates/list":
        result = {"resourceTemplates": [{"uriTemplate": f"knowledge://{k}", "name": k.split("/")[0]} for k in ("entity/{id}", "days/{date}")]}
    elif method == "resources/read":
        result = {"contents": [{"uri": own.get("uri", ""), "mimeType": "application/json", "text": read(tools, own.get("uri", ""))}]}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve(tools: Tools, given: TextIO, out: TextIO) -> None:
    for line in given:
        if not line.strip():
            continue
        try:
            reply = answer(tools, json.loads(line))
        except (ValueError, AttributeError) as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            out.write(_dump(reply) + "\n")
            out.flush()
