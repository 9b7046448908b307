"""Embedding of texts by an endpoint or any client, as a stage of a plan, and its cached results."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[list[float]]]


class Endpoint:
    """POST {input, model} to url/embeddings; results are put in order by their index."""

    def __init__(self, url: str, model: str, key: str | None = None, tries: int = 5, longest: float = 30.0, send: Callable[[dict], dict] | None = None, wait: Callable[[float], None] = time.sleep):
        self.url, self.model, self.key, self.tries, self.longest = url.rstrip("/") + "/embeddings", model, key, tries, longest
        self.send, self.wait = send or self._post, wait

    def _post(self, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=120) as r:  # noqa: S310
            return json.loads(r.read())

    def __call__(self, texts: list[str]) -> list[list[float]]:
        pause = 1.0
        for n in range(self.tries):
            try:
                data = sorted(self.send({"input": texts, "model": self.model})["data"], key=lambda d: d["index"])
                if len(data) != len(texts):
                    raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
                return [d["embedding"] for d in data]
            except (OSError, ValueError, KeyError):
                if n == self.tries - 1:
                    raise
                self.wait(min(pause, self.longest))
                pause *= 2
        raise AssertionError


def embed(texts: DataFrame, client: Client, batch: int = 64, prefix: str = "") -> DataFrame:
    """texts (id, text, ...) with `embedding`; null texts embed as empty ones."""
    names = texts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield part.assign(embedding=client([prefix + (t or "") for t in part["text"]]))[[*names, "embedding"]]

    return texts.mapInPandas(run, f"{schema}, embedding array<float>")


def embed_new(texts: DataFrame, client: Client, out: str, model: str, batch: int = 64) -> DataFrame:
    """Embed what the parquet cache `out` lacks for this model, add it, and return the cache's rows for texts."""
    spark = texts.sparkSession
    keyed = texts.withColumns({"model": F.lit(model), "digest": F.sha2(F.coalesce("text", F.lit("")), 256)})
    try:
        done = spark.read.parquet(out).where(F.col("model") == model).select("id", "digest")
        todo = keyed.join(done, ["id", "digest"], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = keyed
    embed(todo, client, batch).write.mode("append").parquet(out)
    return spark.read.parquet(out).join(keyed.select("id", "digest", "model"), ["id", "digest", "model"], "left_semi")


def embed_to(texts: DataFrame, client: Client, out: str, batch: int = 64, prefix: str = "") -> None:
    """Embed texts (id, text, label) and write them: as JSON lines to a name that ends so, else as Parquet. A label that no row has is left out."""
    done = embed(texts, client, batch, prefix)
    if "label" in texts.columns and texts.where("label IS NOT NULL").isEmpty():
        done = done.drop("label")
    done.write.json(out) if out.endswith((".jsonl", ".json")) else done.write.parquet(out)
