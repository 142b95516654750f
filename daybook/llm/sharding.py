"""Sharding over fixed virtual slots.

Records hash by id into ``slots`` slots that never change. A slot map, kept as a table with
a version number, says which shard each slot is in. Version 1 deals the slots out in turn;
rebalancing aggregates bytes per slot and writes a further version in which single slots
have moved, or changed places, until the shards' bytes are near equal.

An id that many rows repeat would make one slot as heavy as shards: slots over
``slot_limit`` of a fair shard are split into ``parts`` by row, so that they can be dealt out.

Defined cases. Null id: a key of its own. Null text: no bytes, CRC of no bytes. Repeated rows
are records of their own. Empty table: empty result. Only id and text are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty, written

MAP_SCHEMA = "version int, vslot int, part int, shard int"


def rebalanced(
    mapping: dict[tuple[int, int], int],
    weight: dict[tuple[int, int], int],
    shards: int,
    tolerance: float = 0.002,
) -> dict[tuple[int, int], int]:
    """The map after single moves: from the heaviest shard to the lightest, a slot whose
    weight is nearest to half the gap, or else the exchange of two that is. Stops within
    ``tolerance`` of a fair share or when no move narrows the gap."""
    out = dict(mapping)
    total = [0] * shards
    inside: list[dict] = [{} for _ in range(shards)]
    for slot, shard in out.items():
        w = weight.get(slot, 0)
        total[shard] += w
        if w:
            inside[shard][slot] = w
    fair = sum(total) / shards
    for _ in range(40 * shards + len(out)):
        light, heavy = min(range(shards), key=total.__getitem__), max(range(shards), key=total.__getitem__)
        gap = total[heavy] - total[light]
        if gap <= tolerance * fair:
            break
        half = gap / 2
        best = min(((abs(w - half), w, s, None) for s, w in inside[heavy].items() if w < gap), default=None)
        if best is None or best[0] > 0.25 * half:
            ours = heapq.nsmallest(40, inside[heavy].items(), key=lambda x: (abs(x[1] - 2 * half), x[0]))
            ours += heapq.nlargest(40, inside[heavy].items(), key=lambda x: (x[1], x[0]))
            theirs = heapq.nlargest(80, inside[light].items(), key=lambda x: (x[1], x[0]))
            theirs += heapq.nsmallest(80, inside[light].items(), key=lambda x: (x[1], x[0]))
            pairs = ((abs(a - b - half), a - b, s, t) for s, a in ours for t, b in theirs if 0 < a - b < gap)
            best = min([x for x in (best, min(pairs, key=lambda x: x[:3], default=None)) if x], key=lambda x: x[0], default=None)
        if best is None:
            break
        _, moved, slot, back = best
        for s, to, was in ((slot, light, heavy), (back, heavy, light)):
            if s is not None:
                inside[to][s] = inside[was].pop(s)
                out[s] = to
        total[heavy] -= moved
        total[light] += moved
    return out


def store_map(spark: SparkSession, versions: list[dict[tuple[int, int], int]]) -> DataFrame:
    """All versions of a slot map as a table in the shared folder."""
    rows = [(v, *slot, shard) for v, m in enumerate(versions, 1) for slot, shard in m.items()]
    return written(spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1), "slot_map")


def shard(
    docs: DataFrame,
    shards: int = 40,
    slots: int = 8192,
    slot_limit: float = 0.25,
    parts: int = 64,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, vslot, part, map_version,
    shard, slot``; ``slot`` counts from 0 in each shard without gaps."""
    spark = docs.sparkSession
    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.lit(5), F.col(id_column)), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "shard_rows")
    # Bounded: one row for each of the fixed slots.
    weight = {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    fair = sum(weight.values()) / shards
    hot = sorted(s for s, w in weight.items() if w > slot_limit * fair)
    part = F.when(F.col("vslot").isin(hot), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")) if hot else F.lit(None)
    rows = rows.withColumn("part", F.coalesce(part.cast("int"), F.lit(0)))
    by_part = {(s, 0): w for s, w in weight.items()}
    if hot:
        cut = rows.filter(F.col("vslot").isin(hot)).groupBy("vslot", "part").agg(F.sum("size").alias("bytes"))
        by_part |= {(s, p): 0 for s in hot for p in range(parts)}
        by_part |= {(r.vslot, r.part): r.bytes for r in cut.collect()}
    keys = sorted({(s, 0) for s in range(slots)} | set(by_part))
    first = {k: (k[0] + k[1]) % shards for k in keys}
    versions = [first, rebalanced(first, by_part, shards)]
    current = store_map(spark, versions).filter(F.col("version") == len(versions))
    # Rows per slot give each slot's first place in its shard; the map has a bounded size.
    counts = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = current.join(counts, ["vslot", "part"]).withColumn(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    placed = rows.withColumn(
        "nth", F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "row")) - 1
    ).join(F.broadcast(starts), ["vslot", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", "vslot", "part",
        F.col("version").alias("map_version"),
        "shard",
        (F.col("start") + F.col("nth")).alias("slot"),
    )
