"""Scoring by a log-frequency Bloom filter language model.

The filter holds one- and two-word n-grams with their counts quantised to q = 1 + floor(log2
count): the n-gram is entered with each of 1..q. A count is read by probing 1, 2, ... until
a probe fails. Probabilities interpolate the two orders, with one added to word counts.

The filter is blocked by hash: n-grams are counted and entered group by group, each group in
a block of bits of its own, so no worker holds the whole. Its size follows the tokens
learnt from (``bits_per_token``) without bound, so the rate of false positives does not grow
with the corpus: n-grams that differ are at most two a token, and fewer a token as a corpus
grows. ``filled`` gives the share of bits set, whose ``hashes``-th power is that rate. A filter of up to ``most_bits`` is broadcast. A larger one stays in blocks:
the distinct n-grams of each lot of texts go to their groups' blocks, are probed there, and
their counts go back to the lot. Both ways give the same scores.

Beside it stands an exact base: log10((c + 1) / (N + V + 1)) summed over tokens. Counts of
the most frequent words, at most ``head`` of them, are broadcast; the other words of each
document are joined with the table of counts.

Defined cases. Null or empty text: one token, the end. Held out: crc32 of the id's digits
mod 7 is 2; a null id is learnt from. Repeated rows are documents of their own. Ties: words of
one count are alike, and whether a word is among the frequent ones changes nothing. An empty
corpus has N = V = 0, and every word is unknown. Very long texts are read whole. Only id and
text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty, written
from daybook.llm.quality_classifier import id_crc

#: A-Z to a-z; bytes.split() without arguments divides at exactly the white space meant.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The end token; no word is empty.
END = b""
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
BATCH_TOKENS = 400_000


def tokens(text: bytes | None) -> list[bytes]:
    words = text.translate(_LOWER).split() if text else []
    words.append(END)
    return words


class _Words(dict):
    """Numbers for the words of one batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD[0])
        return (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[1])


def word_keys(words: Iterator[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(first * np.uint64(_ODD[2]) + (second ^ np.uint64(_ODD[3])))


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)


def _places(keys: np.ndarray, q: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    """Places in its group's block of (key, q), one array per hash function."""
    with np.errstate(over="ignore"):
        a = _mixed(keys + np.uint64((q * _ODD[2]) & (2**64 - 1)))
        b = _mixed(a) | np.uint64(1)
        for i in range(hashes):
            yield (((a + np.uint64(i) * b) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


def word_counts(docs: DataFrame, most_words: int = 400_000) -> DataFrame:
    """(word binary, n) over all rows of a table with one binary column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > most_words:
                    yield batch()
                    seen = Counter()
        if seen:
            yield batch()

    return docs.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Rows (as slices) and their tokens, in lots of about ``BATCH_TOKENS``."""
    for batch in batches:
        low, size, lot = 0, 0, []
        for i, text in enumerate(batch.column(column)):
            lot.append(tokens(text.as_py()))
            size += len(lot[-1])
            if size >= BATCH_TOKENS or i == batch.num_rows - 1:
                yield batch.slice(low, i + 1 - low), lot
                low, size, lot = i + 1, 0, []


def _numbered(lot: list[list[bytes]]) -> tuple[_Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, token numbers, their predecessors' numbers, token counts per text)."""
    words = _Words()
    end = words[END]
    lengths = np.fromiter(map(len, lot), np.int64, len(lot))
    ids = np.concatenate([np.fromiter(map(words.__getitem__, t), np.int32, len(t)) for t in lot])
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return words, ids, before, lengths


@dataclass
class BloomModel:
    blocks: np.ndarray | None  # one row of bytes per group
    bits: int
    hashes: int
    tokens: int
    vocabulary: int
    share: float = 0.7

    def quantised(self, keys: np.ndarray) -> np.ndarray:
        """q of each key, 0 if the first probe fails."""
        q = np.zeros(len(keys), np.int8)
        left, step = np.arange(len(keys)), 1
        flat, row = self.blocks.reshape(-1), self.blocks.shape[1]
        base = _group(keys, len(self.blocks)).astype(np.int64) * row
        while len(left) and step < 63:
            inside = np.ones(len(left), bool)
            for at in _places(keys[left], step, self.hashes, self.bits):
                byte = flat[base[left] + (at >> np.uint64(3)).astype(np.int64)]
                inside &= ((byte >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            left = left[inside]
            q[left] = step
            step += 1
        return q

    def filled(self) -> float:
        """The share of bits that are set."""
        return float(np.bitwise_count(self.blocks).sum()) / (8 * self.blocks.size)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of each quantum: 0, 1, then 1.5 * 2^(q-1)."""
        return _middles(self.quantised(keys))

    def log10(self, words: list[bytes], ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the one before it."""
        keys = word_keys(iter(words), len(words))
        single = self.counts(_mixed(keys))
        pair = self.counts(pair_keys(keys[before], keys[ids]))
        return self.interpolated(single[ids], single[before], pair)

    def interpolated(self, single: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 probabilities from the counts of tokens, of those before them, and of both."""
        unigram = (single + 1) / (self.tokens + self.vocabulary + 1)
        follows = np.minimum(1.0, pair / np.maximum(before, 1.0))
        return np.log10(self.share * follows + (1 - self.share) * unigram)


def _middles(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    return np.where(q == 0, 0.0, np.where(q == 1, 1.0, 1.5 * 2 ** (q - 1)))


def _cut(keys: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, start, end) of each group that occurs in sorted keys."""
    cuts = np.searchsorted(_group(keys, groups), np.arange(groups + 1))
    return [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def filter_size(n_tokens: int, bits_per_token: float) -> tuple[int, int]:
    """(groups, bits of each group's block)."""
    groups = max(64, n_tokens // 1_000_000)
    return groups, max(64, int(bits_per_token * n_tokens) // groups // 8 * 8)


def filter_blocks(docs: DataFrame, groups: int, bits: int, hashes: int) -> DataFrame:
    """(grp, block): the filter over all rows of a table with one binary column."""
    schema = pa.schema([("grp", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lot in _text_batches(batches, 0):
            words, ids, before, _ = _numbered(lot)
            own = word_keys(iter(words), len(words))
            single = np.bincount(ids, minlength=len(words))
            pairs, n = np.unique(pair_keys(own[before], own[ids]), return_counts=True)
            keys, n = np.concatenate([_mixed(own), pairs]), np.concatenate([single, n])
            keys, n = keys[n > 0], n[n > 0].astype(np.uint32)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            rows = [(g, keys[a:b].tobytes(), n[a:b].tobytes()) for g, a, b in _cut(keys, groups)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    def enter(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table["keys"]])
        n = np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in table["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.add.reduceat(n.astype(np.int64), first)
        q = 1 + np.floor(np.log2(n)).astype(np.int64)
        block = np.zeros(bits, bool)
        for step in range(1, int(q.max()) + 1):
            for at in _places(keys[q >= step], step, hashes, bits):
                block[at.astype(np.int64)] = True
        return pa.table({"grp": [table["grp"][0].as_py()], "block": [np.packbits(block, bitorder="little").tobytes()]})

    counted = docs.mapInArrow(count, "grp bigint, keys binary, counts binary")
    return counted.groupBy("grp").applyInArrow(enter, "grp bigint, block binary")


def _gathered(blocks: DataFrame, groups: int, bits: int) -> np.ndarray:
    """All blocks on the driver: the caller bounds their size."""
    out = np.zeros((groups, bits // 8), np.uint8)
    for row in blocks.toLocalIterator():
        out[row.grp] = np.frombuffer(row.block, np.uint8)
    return out


def _asked(words: _Words, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lot's sorted distinct keys, places in them of each token, its predecessor, both)."""
    own = word_keys(iter(words), len(words))
    single, pair = _mixed(own), pair_keys(own[before], own[ids])
    keys = np.unique(np.concatenate([single, pair]))
    at = np.searchsorted(keys, single).astype(np.int32)
    return keys, np.stack([at[ids], at[before], np.searchsorted(keys, pair).astype(np.int32)])


def _block_scores(table: DataFrame, blocks: DataFrame, model: BloomModel) -> DataFrame:
    """(row, score) from a table of lots: rows (lot, grp, keys) for the groups, in which each
    block is held by the one task that probes it, and rows (lot, row, places) for the texts.
    ``model`` has no blocks."""

    def probe(asked: pa.Table, block: pa.Table) -> pa.Table:
        if block.num_rows and asked.num_rows:
            one = np.frombuffer(block["block"][0].as_py(), np.uint8).reshape(1, -1)
            here = BloomModel(one, model.bits, model.hashes, model.tokens, model.vocabulary)
            found = [here.quantised(np.frombuffer(k.as_py(), np.uint64)).tobytes() for k in asked["keys"]]
        else:
            found = [bytes(len(k.as_py()) // 8) for k in asked["keys"]]
        return pa.table({"lot": asked["lot"], "grp": asked["grp"], "q": pa.array(found, pa.binary())})

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("grp")
        count = _middles(np.frombuffer(b"".join(x.as_py() for x in found["q"]), np.int8))
        scores = []
        for places in texts["places"]:
            word, before, pair = np.frombuffer(places.as_py(), np.int32).reshape(3, -1)
            scores.append(float(model.interpolated(count[word], count[before], count[pair]).sum()))
        return pa.table({"row": texts["row"], "score": pa.array(scores, pa.float64())})

    asked = table.filter("grp IS NOT NULL").select("lot", "grp", "keys")
    found = asked.groupBy("grp").cogroup(blocks.groupBy("grp")).applyInArrow(probe, "lot bigint, grp bigint, q binary")
    texts = table.filter("grp IS NULL").select("lot", "row", "places")
    return texts.groupBy("lot").cogroup(found.groupBy("lot")).applyInArrow(add_up, "row bigint, score double")


def score(
    docs: DataFrame, modulus: int = 7, held: int = 2, head: int = 200_000, id_column: str = "doc_id", text_column: str = "text",
    bits_per_token: float = 6.0, most_bits: int = 1 << 30, hashes: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``."""
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (F.pmod(id_crc(id_column), F.lit(modulus)) == held).alias("held_out"),
        text_or_empty(text_column).cast("binary").alias("text"),
    )
    learnt = own.filter("NOT held_out").select("text")
    counts = written(word_counts(learnt), "word_counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, vocabulary = int(totals[0]), int(totals[1])
    # The frequent words: by eighths of a power of two of their count, at most 512 classes.
    level = F.floor(F.log2("n") * 8)
    levels = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for lv, words in levels:
        total += words
        if total > head:
            break
        least = lv
    frequent = {} if least is None else {bytes(r.word): r.n for r in counts.filter(level >= least).toLocalIterator()}
    groups, bits = filter_size(n_tokens, bits_per_token)
    blocks = filter_blocks(learnt, groups, bits, hashes)
    # A filter that is not broadcast is probed block by block.
    sent = groups * bits <= most_bits
    model = BloomModel(_gathered(blocks, groups, bits) if sent else None, bits, hashes, n_tokens, vocabulary)
    shared = spark.sparkContext.broadcast((frequent, model))
    kinds = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_sum", pa.float64()),
         ("score", pa.float64()), ("rest", pa.list_(pa.binary())), ("rest_n", pa.list_(pa.int64())),
         ("lot", pa.int64()), ("grp", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model = shared.value
        lot_id = TaskContext.get().partitionId() << 33
        for part, lot in _text_batches(batches, 2):
            words, ids, before, lengths = _numbered(lot)
            listed = list(words)
            c = np.fromiter((frequent.get(w, -1) for w in listed), np.int64, len(listed))
            there = c >= 0
            logs = np.where(there, np.log10(np.maximum(c, 0) + 1.0), 0.0)
            starts = np.cumsum(lengths) - lengths
            rest, rest_n = [], []
            for a, n in zip(starts, lengths, strict=True):
                mine = ids[a : a + n]
                odd, times = np.unique(mine[~there[mine]], return_counts=True)
                rest.append([listed[i] for i in odd])
                rest_n.append(times.tolist())
            if sent:
                scores, places = pa.array(np.add.reduceat(model.log10(listed, ids, before), starts)), None
            else:
                keys, at = _asked(words, ids, before)
                scores, places = None, [at[:, a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)]
                lots = [{"lot": lot_id, "grp": g, "keys": keys[a:b].tobytes()} for g, a, b in _cut(keys, groups)]
                yield pa.RecordBatch.from_pylist(lots, schema=kinds)
            columns = {
                "doc_id": part.column(0), "held_out": part.column(1), "n_tokens": pa.array(lengths),
                "known": pa.array(np.add.reduceat(there[ids].astype(np.int64), starts)), "log_sum": pa.array(np.add.reduceat(logs[ids], starts)),
                "score": scores, "rest": pa.array(rest, pa.list_(pa.binary())), "rest_n": pa.array(rest_n, pa.list_(pa.int64())),
                "lot": pa.array([lot_id] * part.num_rows, pa.int64()), "places": places and pa.array(places, pa.binary()),
            }
            full = [pa.nulls(part.num_rows, f.type) if columns.get(f.name) is None else columns[f.name] for f in kinds]
            yield pa.RecordBatch.from_arrays(full, schema=kinds)
            lot_id += 1

    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, log_sum double, score double, rest array<binary>, rest_n array<bigint>, "
    ddl += "lot bigint, grp bigint, keys binary, places binary"
    table = written(own.mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()), "lm_scores")
    scored = table.filter("grp IS NULL").drop("lot", "grp", "keys", "places")
    if not sent:
        scored = scored.drop("score").join(_block_scores(table, blocks, model), "row")
    odd = scored.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.rest_n").alias("times"))
    found = (
        odd.join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_log"), F.sum("times").alias("rest_known"))
    )
    each = math.log10(n_tokens + vocabulary + 1)
    return scored.drop("rest", "rest_n").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("rest_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        "score",
    )
