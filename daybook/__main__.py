"""python -m daybook COMMAND STORE ...

consolidate STORE [SOURCES]              reads note files (name=path:path2); 0 if all went well
serve STORE [SOURCES]                    answers JSON-RPC on standard input and output
call STORE TOOL [JSON]                   one tool's answer as JSON
search STORE WORDS...                    a page of hits
stats STORE                              counts and health as JSON
maintain STORE [--dry-run] [--prune-only]  prunes noise, rescores, reports before and after
embed STORE                              makes all vectors anew
registry FILE --lexicon | --slugs        what the project registry holds

NOTE_DIRS has the sources and NOTE_REGISTRY the registry file where none is given.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("consolidate", "serve", "call", "search", "stats", "maintain", "embed", "registry"):
        print(__doc__, file=sys.stderr)
        return 1
    from daybook.operators.maintain import maintain
    from daybook.plans import server
    from daybook.plans.consolidate import consolidate, embed_again
    from daybook.sources import embeddings, registry
    from daybook.sources.notes import parse_source_list
    from daybook.sources.store import Store

    spark = SparkSession.builder.getOrCreate()
    command, place, rest = args[0], args[1], args[2:]
    if command == "registry":
        found = registry.load(spark, place)
        if "--lexicon" in rest:
            print(registry.lexicon_json(found))
        elif "--slugs" in rest:
            print("\n".join(sorted(r.id for r in registry.registered_ids(spark, found).collect())))
        return int(not {"--lexicon", "--slugs"} & set(rest))
    store, today, embedder = Store(spark, place), dt.date.today, embeddings.from_environment()
    known = os.environ.get("NOTE_REGISTRY")
    slugs = registry.registered_ids(spark, registry.load(spark, known)) if known else None
    given = rest[0] if rest and command in ("consolidate", "serve") else os.environ.get("NOTE_DIRS")
    tools = server.Tools(store, today, parse_source_list(given), embedder, slugs)
    if command == "consolidate":
        result = consolidate(store, tools.sources, today(), embedder)
        print(result)
        return int(result.status != "ok")
    if command == "serve":
        server.serve(tools, sys.stdin, sys.stdout)
    elif command == "call":
        text, bad = server.call(tools, rest[0] if rest else "", json.loads(rest[1]) if len(rest) > 1 else {})
        print(text)
        return int(bad)
    elif command == "search":
        tools._knowledge().knowledge_search(" ".join(rest)).show(truncate=60)
    elif command == "stats":
        print(server.call(tools, "knowledge_stats", {})[0])
    elif command == "maintain":
        print(json.dumps(maintain(store, today(), slugs, "--dry-run" in rest, "--prune-only" in rest), ensure_ascii=False))
    elif embedder is None:
        print("no embedder: set EMBEDDING_API_URL, EMBEDDING_MODEL and EMBEDDING_API_KEY", file=sys.stderr)
        return 1
    else:
        print(embed_again(store, embedder))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
