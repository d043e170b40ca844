"""Where answers to prompts come from: a replayed table, a deterministic stand-in, or an endpoint.

A source maps (key, prompt) to (key, text). Failures and unknown prompts give an empty text.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_hash(prompt: Column | str) -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


class Replay:
    """Answers kept in a table (hash, text)."""

    def __init__(self, kept: DataFrame) -> None:
        self.kept = kept.select("hash", "text").dropDuplicates(["hash"])

    def __call__(self, prompts: DataFrame, key: str = "qid") -> DataFrame:
        rows = prompts.withColumn("hash", prompt_hash("prompt")).join(self.kept, "hash", "left")
        return rows.select(key, F.coalesce("text", F.lit("")).alias("text"))


class Stub:
    """Answers made from the prompt by a column expression."""

    def __init__(self, answer: Column) -> None:
        self.answer = answer

    def __call__(self, prompts: DataFrame, key: str = "qid") -> DataFrame:
        return prompts.select(key, self.answer.alias("text"))


class Endpoint:
    """A chat endpoint called from the executors, with retries; its limit is shared out over the tasks."""

    def __init__(self, url: str, model: str, token: str = "", calls_per_minute: int = 1000, tasks: int = 8, attempts: int = 6, timeout: int = 120) -> None:
        self.url, self.model, self.token, self.timeout, self.attempts, self.tasks = url, model, token, timeout, attempts, max(1, tasks)
        self.pause = 60.0 * self.tasks / max(1, calls_per_minute)

    def _ask(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except (OSError, ValueError, KeyError, IndexError):
                time.sleep(min(30, 2 ** (attempt + 1)))
        return ""

    def __call__(self, prompts: DataFrame, key: str = "qid") -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts = []
                for prompt in b["prompt"]:
                    texts.append(self._ask(prompt))
                    time.sleep(self.pause)
                yield pd.DataFrame({key: b[key], "text": texts})

        return prompts.select(key, "prompt").repartition(self.tasks).mapInPandas(run, f"{key} string, text string")


def without_thoughts(text: Column | str) -> Column:
    """Drops thinking passages and stray closing tags; the text stays if nothing else is left."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?s)^.*</think>", ""))
    return F.when(bare == "", c).otherwise(bare)


def json_object(text: Column | str) -> Column:
    """The JSON object in an answer: a fenced one first, else from the first to the last brace, without trailing commas."""
    c = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    clean = F.regexp_replace(found, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found).when(F.try_parse_json(clean).isNotNull() & (clean != ""), clean)
