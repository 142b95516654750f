"""Packing of token sequences by non-negative least squares over a length histogram.

Documents are tokenised where they lie and cut at the window: whole windows are sequences of
their own, what is left is a piece of 1 to ``window`` tokens. Piece lengths, rounded up to
units of ``window / bins`` tokens, give a histogram of ``bins`` entries. All combinations of
at most ``depth`` units of length that fill the window exactly are columns of a matrix; a
non-negative least-squares solution says how often to use each, rounding down makes the
counts whole, and the pieces left over are packed best fit, longest first, on the histogram.
That plan is of bounded size; pieces find their sequence in it by their rank in their bin.
Ranks are counted in salted groups, so no bin is ever in one task.

Defined cases. Null or empty text: one piece, the end id alone. Repeated rows are documents
of their own. Very long texts give many whole windows. Empty table: empty result. Only id
and text are read. Lost executors: the pieces' lengths are a written table, and tasks
recomputed from it give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty, written

#: Distinct words, and letter or sign runs, a worker remembers; beyond it that memory is
#: emptied and filled anew.
CACHE_WORDS, CACHE_RUNS = 500_000, 400_000
_open: dict[str, WordTokens] = {}
#: Fixed value: how the word tokenizer cuts a word into runs.
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where Latin-1
    shows it, and else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: 0x100 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class WordTokens:
    """Ids of words by a tokenizer that never joins across blanks.

    The word tokenizer drops white space, lowers case and cuts words into runs of letters or
    signs, and its merges stay inside runs, so a text's ids are its words' ids one after the
    other, and a word's are its runs'. Words and runs seen are remembered. Words with letters
    past U+024F (where composing or lowering may change more than a letter) or with ``<|``
    (special tokens) are given to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= CACHE_RUNS:
                self.runs.clear()
            found = self.tokenizer.model.tokenize(run.encode().decode("latin-1").translate(_LETTERS))
            got = self.runs[run] = b"".join([t.id.to_bytes(4, "little") for t in found])
        return got

    def word(self, word: str) -> bytes:
        if not word:
            return b""
        if max(word) > "\u024f" or "<|" in word:
            return self.encode(word)
        low = word.lower()
        if low.isalpha():
            return self.run(low)
        if low[:-1].isalpha() and low[-1] in ",.;:!?":
            return self.run(low[:-1]) + self.run(low[-1])
        return b"".join(map(self.run, _RUN.findall(low)))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = set().union(*split)
            word = self.word
            self.known.update((w, word(w)) for w in new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _tokens(path: str) -> WordTokens:
    if path not in _open:
        _open[path] = WordTokens(path)
    return _open[path]


PIECE_SCHEMA = "doc_id bigint, start bigint, doc_tokens bigint, ids binary"


def pieces(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Documents as pieces of at most ``window`` ids (little-endian 32-bit in ``ids``)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.texts(part.column(1).to_pylist()), strict=True):
                    ids += end
                    rows += [(doc_id, i // 4, len(ids) // 4, ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col(id_column).cast("bigint"), text_or_empty(text_column))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``depth`` lengths that add up to ``bins``."""
    out: list[tuple[int, ...]] = []

    def add(left: int, most: int, sofar: tuple[int, ...]) -> None:
        if left == 0:
            out.append(sofar)
        elif len(sofar) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(sofar)) < left:
                    break
                add(left - x, x, (*sofar, x))

    add(bins, bins, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 600) -> np.ndarray:
    """argmin |Ax - b| over x >= 0 by the active-set method of Lawson and Hanson, with the
    normal equations of the columns in use."""
    n = a.shape[1]
    x, used, gram_b = np.zeros(n), np.zeros(n, bool), a.T @ b
    scale = max(1.0, float(np.abs(gram_b).max(initial=0)))
    for _ in range(most):
        slope = gram_b - a.T @ (a @ x)
        slope[used] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-7 * scale:
            break
        used[k] = True
        while True:
            on = np.flatnonzero(used)
            sub = a[:, on]
            z = np.linalg.solve(sub.T @ sub + 1e-9 * np.eye(len(on)), gram_b[on])
            if z.min() > 0:
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            gone = on[low & (x[on] <= 1e-9 * scale)]
            gone = gone if len(gone) else on[[int(np.argmin(np.where(low, x[on], np.inf)))]]
            x[gone], used[gone] = 0, False
            if not used.any():
                break
        x[:] = 0
        if used.any():
            x[np.flatnonzero(used)] = z
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs a histogram (``counts[b]`` pieces of ``b`` units), longest first, each into the
    fullest sequences that still have room. Returns (combination, repeats)."""
    bins = len(counts) - 1
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(bins + 1)]
    for b in range(bins, 0, -1):
        n = int(counts[b])
        while n:
            r = next((r for r in range(b, bins + 1) if room[r]), None)
            if r is None:
                combo, have, r = (), n, bins
            else:
                combo, have = room[r].popitem()
            take = min(n, have)
            if r < bins and have > take:
                room[r][combo] = have - take
            grown = (*combo, b)
            room[r - b][grown] = room[r - b].get(grown, 0) + take
            n -= take
    return [(c, k) for level in room for c, k in level.items() if c]


def plan(counts: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram exactly."""
    left, out = counts.astype(np.int64).copy(), []
    bins = len(counts) - 1
    if left[bins]:  # whole windows need no partner
        out.append(((bins,), int(left[bins])))
        left[bins] = 0
    combos = [c for c in combinations(bins, depth) if len(c) > 1 and all(left[b] for b in c)]
    if combos:
        matrix = np.zeros((bins + 1, len(combos)))
        for k, c in enumerate(combos):
            for b in c:
                matrix[b, k] += 1
        x = nnls(matrix, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            times = min([int(x[k] + 1e-6), *(int(left[b]) // c.count(b) for c in (combos[k],) for b in set(c))])
            if times > 0:
                out.append((combos[k], times))
                for b in combos[k]:
                    left[b] -= times
    return out + best_fit(left)


def _lookup(steps: list[tuple[tuple[int, ...], int]], bins: int) -> dict[int, np.ndarray]:
    """For each bin, rows (first rank, pieces per sequence, first sequence, first slot)."""
    used, sequence, rows = [0] * (bins + 1), 0, {b: [] for b in range(bins + 1)}
    for combo, times in steps:
        for b in sorted(set(combo), reverse=True):
            rows[b].append((used[b], combo.count(b), sequence, combo.index(b)))
            used[b] += times * combo.count(b)
        sequence += times
    return {b: np.array(r, np.int64).reshape(-1, 4) for b, r in rows.items()}


def assign(lengths: DataFrame, window: int = 4096, bins: int = 256, depth: int = 3, group_rows: int = 50_000) -> DataFrame:
    """``lengths`` (any columns, among them ``length`` from 1 to ``window``) with
    ``sequence_id`` and ``offset``. The input must be a written table."""
    spark = lengths.sparkSession
    unit = window // bins
    rows = lengths.withColumns(
        {
            "__pk_row": F.monotonically_increasing_id(),
            "__pk_bin": F.ceil(F.col("length") / unit).cast("int"),
        }
    )
    # Bounded: at most ``bins`` rows.
    counts = np.zeros(bins + 1, np.int64)
    for r in rows.groupBy("__pk_bin").count().collect():
        counts[r["__pk_bin"]] = r["count"]
    table = spark.sparkContext.broadcast(_lookup(plan(counts, depth), bins))
    salts = int(max(32, counts.max() // group_rows + 1))
    rows = rows.withColumn("__pk_salt", F.pmod(F.xxhash64("__pk_row"), F.lit(salts)).cast("int"))
    group = ["__pk_bin", "__pk_salt"]
    before = Window.partitionBy("__pk_bin").orderBy("__pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(*group).count().withColumn("__pk_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (
        rows.withColumn("__pk_nth", F.row_number().over(Window.partitionBy(*group).orderBy("__pk_row")) - 1)
        .join(firsts, group)
        .withColumn("__pk_rank", F.col("__pk_first") + F.col("__pk_nth"))
        .drop("__pk_salt", "__pk_nth", "__pk_first", "__pk_row")
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sequence, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            ranks, in_bin = pdf["__pk_rank"].to_numpy(), pdf["__pk_bin"].to_numpy()
            for b in np.unique(in_bin):
                at, steps = in_bin == b, table.value[b]
                k = np.searchsorted(steps[:, 0], ranks[at], "right") - 1
                nth, per = ranks[at] - steps[k, 0], steps[k, 1]
                sequence[at], slot[at] = steps[k, 2] + nth // per, steps[k, 3] + nth % per
            yield pdf.assign(sequence_id=sequence, __pk_slot=slot).drop(columns=["__pk_rank", "__pk_bin"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lengths.schema)
    placed = ranked.mapInPandas(place, f"{kept}, sequence_id bigint, __pk_slot bigint")
    ahead = Window.partitionBy("sequence_id").orderBy("__pk_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("bigint")).drop("__pk_slot")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, bins: int = 256, depth: int = 3) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    cut = pieces(docs, tokenizer, window, end_id).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
    )
    return assign(written(cut, "pieces"), window, bins, depth)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """The packed ids: ``sequence_id, ids`` (32-bit little-endian), for ids of documents that
    are told apart by ``doc_id``. A sequence gathers at most ``window`` ids."""
    parts = packed.join(pieces(docs, tokenizer, window, end_id).select("doc_id", "start", "ids"), ["doc_id", "start"])
    return parts.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
