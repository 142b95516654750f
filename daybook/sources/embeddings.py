"""Vectors of texts over HTTP, batch by batch inside the partitions."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.vocab import EMBEDDING_BATCH, EMBEDDING_DIMENSION


@dataclass(frozen=True)
class Client:
    """POST {url}/embeddings; answers are put in order by index; 429 is tried again after 1
    and 2 seconds; any other failure gives empty vectors. Pauses between remote batches."""

    url: str
    model: str
    key: str = ""
    dimension: int = EMBEDDING_DIMENSION
    pause: float = 3.0
    timeout: float = 120.0

    @property
    def local(self) -> bool:
        return "localhost" in self.url or "127.0.0.1" in self.url

    def batch(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for wait in (1.0, 2.0, None):
            try:
                request = urllib.request.Request(f"{self.url.rstrip('/')}/embeddings", body, head)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    data = sorted(json.load(answer)["data"], key=lambda d: d["index"])
                return [d["embedding"] for d in data]
            except urllib.error.HTTPError as e:
                if e.code != 429 or wait is None:
                    break
                time.sleep(wait)
            except (OSError, ValueError, KeyError):
                break
        return [[] for _ in texts]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), EMBEDDING_BATCH):
            if i and not self.local:
                time.sleep(self.pause)
            got = self.batch(texts[i : i + EMBEDDING_BATCH])
            out += [v if len(v) == self.dimension else [] for v in got]
        return out


def from_environment(env: dict[str, str] | None = None) -> Client | None:
    """A client where url and model are set, and the key unless the url is local."""
    e = os.environ if env is None else env
    url, model, key = e.get("EMBEDDING_API_URL", ""), e.get("EMBEDDING_MODEL", ""), e.get("EMBEDDING_API_KEY", "")
    if not url or not model:
        return None
    client = Client(url, model, key, int(e.get("EMBEDDING_DIMENSION", EMBEDDING_DIMENSION)))
    return client if key or client.local else None


def embed(entities: DataFrame, client: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(entity_id, embedding) of name and summary, at most 1000 characters; rows whose text
    got no vector are left out and can be tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"entity_id": pdf["id"], "embedding": client(pdf["text"].tolist())})

    text = F.substring(F.concat_ws(" ", "name", "summary"), 1, 1000).alias("text")
    return entities.select("id", text).mapInPandas(run, "entity_id string, embedding array<float>").filter(F.size("embedding") > 0)
