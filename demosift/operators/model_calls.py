"""The map over a language model: retries, failover, resumable and idempotent by key.

A client is anything with ``create(**request) -> dict`` with ``content`` and, if known, ``finish_reason`` and
``usage``.  Tasks can run twice, so results are written under their key and the last write of a key counts.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("strategy", "k", "test_index")
RESULT = "prediction string, error string, finish_reason string, llm_attempts int, empty_retries int, response_max_tokens int, api_key_index int, api_key_count int, prompt_tokens int, completion_tokens int, total_tokens int"


class Failover:
    """Several clients as one: stays with the one that works, goes round once when it fails."""

    def __init__(self, clients: list[Any]):
        self.clients, self.active = clients, 0

    @property
    def key_count(self) -> int:
        return len(self.clients)

    def create(self, **request: Any) -> dict:
        last: Exception | None = None
        for _ in self.clients:
            try:
                return self.clients[self.active].create(**request)
            except Exception as e:
                last = e
                self.active = (self.active + 1) % len(self.clients)
        raise last


class HttpClient:
    """A server that answers chat requests at ``<base>/chat/completions``; made inside a task, so it pickles."""

    def __init__(self, base: str, key: str = "", timeout: float = 120.0):
        self.url, self.key, self.timeout = f"{base.rstrip('/')}/chat/completions", key, timeout

    def create(self, **request: Any) -> dict:
        body = {**{k: v for k, v in request.items() if k != "extra_body"}, **(request.get("extra_body") or {})}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as answer:
            found = json.load(answer)
        choice = found["choices"][0]
        return {"content": choice["message"].get("content"), "finish_reason": choice.get("finish_reason"), "usage": found.get("usage")}


def http_pool(base: str, keys: list[str]) -> Failover:
    """One client for each key, with failover."""
    return Failover([HttpClient(base, k) for k in keys or [""]])


def waits(times: int, delay: float) -> list[float]:
    """Seconds to wait before each repetition: doubling, none where the delay is none."""
    return [max(0.0, delay) * 2**n for n in range(max(0, times))]


def reached(client: Any, request: dict, schedule: list[float], sleep: Callable[[float], None]) -> tuple[dict, int]:
    """An answer, and how many tries it took; the error of the last try is the caller's."""
    for tries, wait in enumerate(schedule, 1):
        try:
            return client.create(**request), tries
        except Exception:
            sleep(wait)
    return client.create(**request), len(schedule) + 1


def call(client: Any, request: dict, max_retries: int = 3, delay: float = 1.0, empty_retries: int = 2, empty_max_tokens: int | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[str, dict | None, dict]:
    """Output, usage and how it came.

    Errors are met by the same request after a while, empty outputs by one that allows more tokens.
    """
    on_error, on_empty = waits(max_retries, delay), waits(empty_retries, delay)
    bigger = request if empty_max_tokens is None else {**request, "max_tokens": max(int(request.get("max_tokens") or 0), int(empty_max_tokens))}
    output, attempts, empty = "", 0, -1
    while not output and empty < len(on_empty):
        empty += 1
        if empty and on_empty[empty - 1] > 0:
            sleep(on_empty[empty - 1])
        sent = bigger if empty else request
        answer, tries = reached(client, sent, on_error, sleep)
        attempts += tries
        output = (answer.get("content") or "").strip()
    pool = {"api_key_index": client.active + 1, "api_key_count": client.key_count} if hasattr(client, "active") else {}
    return output, answer.get("usage"), {"finish_reason": answer.get("finish_reason"), "attempts": attempts, "empty_retries": empty, "max_tokens": sent.get("max_tokens"), **pool}


def map_calls(work: DataFrame, make_client: Callable[[], Any], parallel: int | None = None, **options: Any) -> DataFrame:
    """``work`` (with ``request`` as JSON and, optionally, ``retry_max_tokens``) and the result columns.

    One client is made in each task; ``parallel`` tasks run at once.  A failed call gives an empty
    prediction and its error.
    """
    if parallel:
        work = work.repartition(parallel)
    has_retry = "retry_max_tokens" in work.columns
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch["request"]):
                request = json.loads(raw)
                retry = int(batch["retry_max_tokens"].iloc[i]) if has_retry else None
                try:
                    output, usage, info = call(client, request, empty_max_tokens=retry, **options)
                    error = ""
                except Exception as e:
                    output, usage, info, error = "", None, {}, f"{type(e).__name__}: {e}"
                usage = usage or {}
                rows.append((output, error, info.get("finish_reason"), info.get("attempts", 0), info.get("empty_retries", 0), info.get("max_tokens") or request.get("max_tokens"), info.get("api_key_index"), info.get("api_key_count"), *(int(usage.get(n) or 0) for n in ("prompt_tokens", "completion_tokens", "total_tokens"))))
            found = pd.DataFrame(rows, columns=names, dtype=object)
            yield pd.concat([batch.reset_index(drop=True), found], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema)
    return work.mapInPandas(run, f"{fields}, {RESULT}")


def keys(predictions: DataFrame) -> DataFrame:
    """The keys of earlier results that can be read as such."""
    found = predictions.select(F.col("strategy").cast("string").alias("strategy"), *[F.col(c).cast("string").try_cast("double").try_cast("int").alias(c) for c in KEY[1:]])
    return found.dropna().distinct()


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(keys(done), list(KEY), "left_anti")


def grid(tests: DataFrame, ks: list[int], strategies: list[str]) -> DataFrame:
    """Every test row under every k and strategy; the lists are short and become columns by explosion."""
    return tests.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))


def run_counts(predictions: DataFrame) -> DataFrame:
    """``completed, errors, empty_predictions``."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return predictions.agg(F.count("*").alias("completed"), F.count_if(~blank("error")).alias("errors"), F.count_if(blank("prediction")).alias("empty_predictions"))
