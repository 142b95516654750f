"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of their character n-grams,
hashed into ``buckets``; a softmax over two labels sits on top. Training is stochastic
gradient descent in numpy on the driver, on a bounded sample: at most about ``sample``
labelled documents, chosen by a hash of the id, so that the same ones are taken every time.
Their hashed feature counts, not their texts, come to the driver.

The softmax reads the average linearly, so each bucket's vector folds into one number and a
text's score is the mean of its buckets' numbers; workers add them up word by word.

Defined cases. Null or empty text: no features, the score of the bias alone. Repeated labels
of one id: rows whose labels agree count once, ids with both labels are left out. Of several
texts under one id the least is learnt from, so the sample bounds rows; all are scored.
Without labels of both kinds the score is the share of label 1 (0.5 without any). Ties: a
score of exactly the threshold is predicted 1. Repeated rows get the same score. Empty table:
empty result. Very long texts are read whole. Only id, text and the label are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import text_or_empty

#: Distinct words a worker remembers; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 400_000
_memory: dict[str, dict[str, complex]] = {}


def id_crc(id_column: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits; null ids have that of no bytes."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")))


def buckets_of(word: str, buckets: int, low: int = 3, high: int = 4) -> list[int]:
    """The buckets of a word and of its character n-grams, ends marked."""
    marked = f"<{word}>".encode()
    grams = [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [crc32(b"w" + marked) % buckets, *(crc32(g) % buckets for g in grams)]


@dataclass
class Model:
    """``weight[b]``: what bucket b adds to the margin of label 1 over label 0."""

    weight: np.ndarray
    bias: float
    name: str = ""

    def margins(self, texts: list[str | None]) -> list[float]:
        known = _memory.get(self.name)
        if known is None:
            _memory.clear()
            known = _memory[self.name] = {}
        out = []
        for text in texts:
            words = (text or "").split()
            new = set(words).difference(known)
            if new:
                if len(known) + len(new) > CACHE_WORDS:
                    known.clear()
                    new = set(words)
                for w in new:
                    b = buckets_of(w, len(self.weight))
                    known[w] = complex(sum(map(self.weight.item, b)), len(b))
            total = sum(map(known.__getitem__, words))
            out.append(self.bias + (total.real / total.imag if words else 0.0))
        return out


def features(docs: DataFrame, buckets: int) -> DataFrame:
    """(label, bucket ids, counts) of each labelled document, both binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts: dict[str, int] = {}
                for w in (text.as_py() or "").split():
                    counts[w] = counts.get(w, 0) + 1
                total: dict[int, int] = {}
                for w, n in counts.items():
                    for b in buckets_of(w, buckets):
                        total[b] = total.get(b, 0) + n
                ids = np.fromiter(total, np.int32, len(total))
                rows.append((label, ids.tobytes(), np.fromiter(total.values(), np.float32, len(total)).tobytes()))
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "ids", "counts"])

    return docs.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, ids binary, counts binary")


Examples = list[tuple[int, np.ndarray, np.ndarray]]


def fit_sgd(
    examples: Examples, buckets: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain stochastic gradient descent, one document a step, with a falling rate; labels
    weigh as their squared shares would have to be equal. Returns the buckets' vectors, the
    softmax's two rows and its biases."""
    vectors, out, bias = np.zeros((buckets, dim), np.float32), np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    share = sum(e[0] for e in examples) / len(examples) if examples else 0.5
    if share in (0.0, 1.0) or not examples:
        safe = min(max(share, 1e-3), 1 - 1e-3)
        bias[1] = math.log(safe / (1 - safe))
        return vectors, out, bias
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weight = (math.sqrt(0.5 / (1 - share)), math.sqrt(0.5 / share))
    steps, total = 0, epochs * len(examples)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            label, ids, counts = examples[k]
            now = rate * (1 - steps / total)
            steps += 1
            n = counts.sum()
            hidden = counts @ vectors[ids] / n if n else np.zeros(dim, np.float32)
            score = out @ hidden + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            p *= weight[label] * now
            if n:
                vectors[ids] -= np.outer(counts / n, p @ out) * min(32.0, len(ids) ** 0.5)
            out -= np.outer(p, hidden)
            bias -= p * 0.1
    return vectors, out, bias


def folded(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """(what each bucket adds to the margin, the margin's bias)."""
    return (vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0])


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, buckets: int = 1 << 18, keep: Column | None = None,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
) -> Model:
    """``keep``: a condition on ``doc_id`` for the labels that may be learnt from."""
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL")
    known = known.filter(keep) if keep is not None else known
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    n = known.count()
    chance = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n, 1)))
    # Bounded: about ``sample`` ids and labels.
    chosen = F.broadcast(known.filter(chance))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = features(texts, buckets).toLocalIterator()
    examples = [(r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]
    examples.sort(key=lambda e: (e[0], len(e[1]), e[1].tobytes()))
    weight, bias = folded(*fit_sgd(examples, buckets))
    return Model(weight, bias, uuid.uuid4().hex)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                margins = np.array(shared.value.margins(part.column(1).to_pylist()))
                scores = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(scores), pa.array(scores >= threshold).cast(pa.int32())], names=["doc_id", "score", "predicted"]
                )

    rows = docs.select(F.col(id_column).cast("bigint"), text_or_empty(text_column))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
