"""Benchmark decontamination over a positional inverted index of the training text.

``build_index`` stores the postings of every training token. The index is cut into segments
of a few million words, each complete for its own documents: terms, and for each term the
sorted positions where it occurs. ``phrase_matches`` and ``proximity_matches`` run test
phrases against each segment from their rarest terms: the lists, each less its term's offset
in the phrase, are intersected in order of length, so a phrase dies at its rarest absent
term. No posting is shuffled, and a term found in every document only lengthens lists that
are searched, not scanned.

Test phrases reach the workers in blocks of at most ``block_words`` words, and so windows; a
larger test set is run block by block against all segments, and what each block hits in a
document, as spans and items, is put together after.

Defined cases. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Null or empty text has no words and no match. Items without words, or with a null id, have
no windows. Rows of one item id are one item. Repeated document rows each get their own
result. Positions leave a hole between documents, so no phrase crosses from one to the next.
Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import written

#: Each byte to itself if it is part of a word (A-Z as a-z), else to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: A window takes some 800 bytes in a worker.
BLOCK_WORDS = 100_000
INDEX_SCHEMA = "doc_ids array<bigint>, bases binary, terms binary, starts binary, postings binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _SegmentBuilder:
    def __init__(self) -> None:
        self.terms, self.ids, self.docs, self.bases, self.size = _Terms(), [], [], [0], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = words_of(text)
        self.ids.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.docs.append(doc_id)
        self.size += len(words) + 1
        self.bases.append(self.size)

    def row(self) -> dict:
        lengths = np.diff(np.array(self.bases, np.int64)) - 1
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        at = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(ids, kind="stable")
        starts = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum(np.bincount(ids, minlength=len(self.terms)), out=starts[1:])
        return {
            "doc_ids": self.docs,
            "bases": np.array(self.bases, np.int64).tobytes(),
            "terms": b" ".join(self.terms),
            "starts": starts.tobytes(),
            "postings": at[order].astype(np.int32).tobytes(),
        }


def _arrow_schema() -> pa.Schema:
    kinds = {"doc_ids": pa.list_(pa.int64())}
    return pa.schema([(n, kinds.get(n, pa.binary())) for n in ("doc_ids", "bases", "terms", "starts", "postings")])


def build_index(
    docs: DataFrame, segment_words: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The stored index: one row per segment. A segment ends with the document in which it
    passes ``segment_words``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _SegmentBuilder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg.add(doc_id, text.as_py())
                if seg.size >= segment_words:
                    yield pa.RecordBatch.from_pylist([seg.row()], schema=_arrow_schema())
                    seg = _SegmentBuilder()
        if seg.docs:
            yield pa.RecordBatch.from_pylist([seg.row()], schema=_arrow_schema())

    rows = docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("binary"))
    return written(rows.mapInArrow(build, INDEX_SCHEMA), "positional_index")


class Segment:
    """One index row, opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.bases = np.frombuffer(row["bases"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.int32)
        self.terms = {t: i for i, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers (-1 if absent) and how often each occurs here."""
        ids = np.fromiter((self.terms.get(w, -1) for w in words), np.int64, len(words))
        there = ids >= 0
        n = np.zeros(len(ids), np.int64)
        n[there] = self.starts[ids[there] + 1] - self.starts[ids[there]]
        return ids, n

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term + 1]]

    def phrase(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand in a row."""
        order = np.argsort(counts, kind="stable")
        found = self.list_of(ids[order[0]]) - np.int32(order[0])
        for k in order[1:]:
            if not len(found):
                break
            other, want = self.list_of(ids[k]), found + np.int32(k)
            at = np.searchsorted(other, want)
            at[at == len(other)] = len(other) - 1
            found = found[other[at] == want]
        return found

    def near(self, ids: np.ndarray, counts: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term within ``slop`` words."""
        order = np.argsort(counts, kind="stable")
        found = self.list_of(ids[order[0]])
        for k in order[1:]:
            other = self.list_of(ids[k])
            lo, hi = np.searchsorted(other, found - slop), np.searchsorted(other, found + slop, "right")
            found = found[hi > lo]
        return found

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, at, "right") - 1


class Windows:
    """Test items cut into windows of ``size`` words; items of fewer words are one window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int) -> None:
        self.vocabulary = _Terms()
        seen: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [self.vocabulary[w] for w in words]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                seen.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.windows = [(np.array(w), sorted(i)) for w, i in seen.items()]
        self.by_length: dict[int, list[int]] = {}
        for k, (w, _) in enumerate(self.windows):
            self.by_length.setdefault(len(w), []).append(k)
        self.words = list(self.vocabulary)

    def occurrences(self, seg: Segment) -> Iterator[tuple[np.ndarray, int, list[int]]]:
        """(positions, length, items) of each window that occurs in the segment."""
        ids, counts = seg.counts(self.words)
        for length, which in self.by_length.items():
            stack = np.stack([self.windows[k][0] for k in which])
            for k in np.array(which)[counts[stack].min(axis=1) > 0]:
                terms, items = self.windows[k]
                at = seg.phrase(ids[terms], counts[terms])
                if len(at):
                    yield at, length, items


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as words, in lists of at most ``block_words`` words (or one item)."""
    rows = (
        items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
        .filter("item_id IS NOT NULL AND text IS NOT NULL")
        .distinct()
    )
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Segment(batch.slice(i, 1).to_pylist()[0])


MATCH_SCHEMA = "segment string, doc int, doc_id bigint, n_words bigint, item_id bigint, start bigint, length int"


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every occurrence of an item's window: ``doc_id``, ``item_id``, first word ``start``
    (from 0 in its document) and ``length``; ``segment`` and ``doc`` name the row."""
    out = None
    for block in item_blocks(items, block_words):
        part = _matches(index, block, window)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else index.sparkSession.createDataFrame([], MATCH_SCHEMA)


def _matches(index: DataFrame, block: list, window: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Windows(shared.value, window)
        for seg in _segments(batches):
            name = hashlib.md5(seg.bases.tobytes() + repr(seg.doc_ids).encode()).hexdigest()
            for at, length, items in tests.occurrences(seg):
                doc = seg.doc_of(at)
                for item in items:
                    n = len(at)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "segment": pa.array([name] * n, pa.string()),
                            "doc": pa.array(doc, pa.int32()),
                            "doc_id": pa.array([seg.doc_ids[d] for d in doc], pa.int64()),
                            "n_words": pa.array(seg.bases[doc + 1] - seg.bases[doc] - 1),
                            "item_id": pa.array([item] * n, pa.int64()),
                            "start": pa.array(at - seg.bases[doc]),
                            "length": pa.array([length] * n, pa.int32()),
                        }
                    )

    return index.mapInArrow(search, MATCH_SCHEMA)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``start`` of the item's rarest term wherever all other
    terms of the item stand within ``slop`` words of it in the same document."""
    schema, out = "doc_id bigint, item_id bigint, start bigint", None
    for block in item_blocks(items, block_words):
        shared = index.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for seg in _segments(batches):
                for item, words in shared.value:
                    ids, counts = seg.counts(sorted(set(words)))
                    if not len(ids) or counts.min() == 0:
                        continue
                    at = seg.near(ids, counts, slop)
                    doc = seg.doc_of(at)
                    # A neighbour within reach may belong to the next document.
                    ok = np.ones(len(at), bool)
                    for t in ids:
                        other = seg.list_of(t)
                        lo = np.searchsorted(other, np.maximum(at - slop, seg.bases[doc]))
                        hi = np.searchsorted(other, np.minimum(at + slop + 1, seg.bases[doc + 1]))
                        ok &= hi > lo
                    at, doc = at[ok], doc[ok]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([seg.doc_ids[d] for d in doc], pa.int64()),
                            "item_id": pa.array([item] * len(at), pa.int64()),
                            "start": pa.array(at - seg.bases[doc]),
                        }
                    )

        part = index.mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else index.sparkSession.createDataFrame([], schema)


SUMMARY_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<bigint>"


def _document_hits(tests: Windows, seg: Segment) -> tuple[np.ndarray, dict[int, set[int]]]:
    """(for each position of the segment whether it is hit, items by document)."""
    edges = np.zeros(int(seg.bases[-1]) + 1, np.int32)
    found: dict[int, set[int]] = {}
    for at, length, items in tests.occurrences(seg):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        for d in np.unique(seg.doc_of(at)):
            found.setdefault(int(d), set()).update(items)
    return np.cumsum(edges) > 0, found


def summarize(index: DataFrame, items: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words inside any occurrence of a window, and the items
    that have one, in ascending order."""
    blocks = item_blocks(items, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        parts = [_block_hits(index, block, window) for block in (first, second, *blocks)]
        return _summarize_large(index, reduce(DataFrame.unionAll, parts))
    shared = index.sparkSession.sparkContext.broadcast(first)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Windows(shared.value, window)
        for seg in _segments(batches):
            hit, found = _document_hits(tests, seg)
            hits = np.concatenate([[0], np.cumsum(hit)])
            n = len(seg.doc_ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(seg.doc_ids, pa.int64()),
                    "n_words": pa.array(np.diff(seg.bases) - 1),
                    "n_hit": pa.array(hits[seg.bases[1:]] - hits[seg.bases[:-1]], pa.int64()),
                    "item_ids": pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.int64())),
                }
            )

    return index.mapInArrow(search, SUMMARY_SCHEMA)


def _block_hits(index: DataFrame, block: list, window: int) -> DataFrame:
    """What one block of items hits: spans of words that are hit, joined where they touch, and
    the items, each once a document. A row has a span or an item."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Windows(shared.value, window)
        for seg in _segments(batches):
            name = hashlib.md5(seg.bases.tobytes() + repr(seg.doc_ids).encode()).hexdigest()
            hit, found = _document_hits(tests, seg)
            turns = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            start, end = np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)
            doc = seg.doc_of(start)
            pairs = [(d, i) for d, items in sorted(found.items()) for i in sorted(items)]
            docs = np.concatenate([doc, np.array([d for d, _ in pairs], np.int64)])
            none = [None] * len(pairs)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([name] * len(docs), pa.string()),
                    "doc": pa.array(docs, pa.int32()),
                    "start": pa.array([*(start - seg.bases[doc]).tolist(), *none], pa.int64()),
                    "length": pa.array([*(end - start).tolist(), *none], pa.int32()),
                    "item_id": pa.array([*[None] * len(start), *(i for _, i in pairs)], pa.int64()),
                }
            )

    return index.mapInArrow(search, "segment string, doc int, start bigint, length int, item_id bigint")


def _summarize_large(index: DataFrame, matches: DataFrame) -> DataFrame:
    """The same from the hits of several blocks: overlapping spans of one document are merged
    by a running maximum of their ends."""
    from pyspark.sql import Window

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg in _segments(batches):
            n = len(seg.doc_ids)
            name = hashlib.md5(seg.bases.tobytes() + repr(seg.doc_ids).encode()).hexdigest()
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([name] * n, pa.string()),
                    "doc": pa.array(range(n), pa.int32()),
                    "doc_id": pa.array(seg.doc_ids, pa.int64()),
                    "n_words": pa.array(np.diff(seg.bases) - 1),
                }
            )

    key = ["segment", "doc"]
    rows = index.mapInArrow(names, "segment string, doc int, doc_id bigint, n_words bigint")
    # Equal segments (the same rows in the same order) would share a name; their results agree.
    rows = rows.groupBy("segment", "doc", "doc_id", "n_words").agg(F.count(F.lit(1)).alias("times"))
    end = F.col("start") + F.col("length")
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.filter("start IS NOT NULL").groupBy(*key, "start").agg(F.max("length").alias("length"))
    spans = spans.withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.groupBy(*key).agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("start", "done"))).alias("n_hit")
    )
    items = matches.filter("item_id IS NOT NULL").groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return (
        rows.join(hit, key, "left")
        .join(items, key, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
        )
        .drop("copy")
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", one_in: int = 20):
    """A document is contaminated if hit words are at least one in ``one_in``."""
    return (F.col(n_hit) > 0) & (one_in * F.col(n_hit) >= F.col(n_words))
