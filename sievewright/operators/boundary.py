"""Where outside code is called: validators, parsers, judges and encoders as Arrow batches (inventory N and M).

The function is given by the caller. It gets lists and returns as many results; whatever it raises becomes an
infrastructure error of that batch and never ends the job, so that a failure of the tool is not taken for a verdict.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_batches(df: DataFrame, key: str, value: str, make: Callable[[], Callable[[list], list]], size: int = 64, retries: int = 2) -> DataFrame:
    """(`key`, `status`, `result`, `attempts`) of a batch function over `value`; `make` builds it once per task.

    A batch that fails or has the wrong number of replies is halved and tried again up to `retries` times per item.
    Null values are not sent: their status is `absent`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def answer(items: list, tries: int) -> list[tuple]:
            try:
                replies = call(items)
                if len(replies) == len(items):
                    return [("done", r, tries) for r in replies]
            except Exception:  # of the tool, not of the row
                pass
            if len(items) > 1:
                half = len(items) // 2
                return answer(items[:half], tries) + answer(items[half:], tries)
            return answer(items, tries + 1) if tries <= retries else [("infrastructure_error", None, tries)]

        for pdf in batches:
            keys, values = pdf[key].tolist(), pdf[value].tolist()
            out = []
            todo = [(k, v) for k, v in zip(keys, values) if v is not None]
            out += [(k, "absent", None, 0) for k, v in zip(keys, values) if v is None]
            for i in range(0, len(todo), size):
                part = todo[i : i + size]
                out += [(k, *a) for (k, _), a in zip(part, answer([v for _, v in part], 1))]
            yield pd.DataFrame(out, columns=[key, "status", "result", "attempts"])

    kind = dict(df.dtypes)[key]
    return df.select(key, value).mapInPandas(run, f"{key} {kind}, status string, result string, attempts int")


def line_process(command: list[str], timeout: float = 60.0) -> Callable[[], Callable[[list], list]]:
    """A maker for a long-lived process per task that answers one JSON line per JSON line."""

    def make() -> Callable[[list], list]:
        state: dict = {}

        def call(items: list) -> list:
            import select

            p = state.get("p")
            if p is None or p.poll() is not None:
                p = state["p"] = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
            out = []
            for item in items:
                try:
                    p.stdin.write(json.dumps(item, ensure_ascii=False) + "\n")
                    p.stdin.flush()
                    if not select.select([p.stdout], [], [], timeout)[0]:
                        raise TimeoutError(command[0])
                    line = p.stdout.readline()
                    if not line:
                        raise EOFError(command[0])
                    out.append(json.loads(line))
                except BaseException:
                    p.kill()
                    p.wait()
                    raise
            return out

        return call

    return make


def blank_tokens() -> Callable[[list], list]:
    """A maker of a tokenizer that loses nothing: runs of blanks and runs of other characters."""
    import re

    cut = re.compile(r"\s+|\S+")
    return lambda texts: [cut.findall(t) for t in texts]


def verified_tokens(df: DataFrame, key: str, value: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """(`key`, `tokens`, `exact`) of a batch tokenizer over texts: how many tokens, and whether they make up the text again."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for pdf in batches:
            made = call(pdf[value].tolist())
            if len(made) != len(pdf):
                raise ValueError("the tokenizer gave another number of texts")
            yield pd.DataFrame({key: pdf[key].to_numpy(), "tokens": [len(t) for t in made], "exact": ["".join(t) == x for t, x in zip(made, pdf[value])]})

    return df.select(key, value).mapInPandas(run, f"{key} {kind}, tokens long, exact boolean")


def cached(df: DataFrame, key: str, value: str, cache: DataFrame, make: Callable[[], Callable[[list], list]], pin: str) -> tuple[DataFrame, DataFrame]:
    """(results for every row, new cache rows): distinct contents are evaluated once and never twice under one pin.

    Infrastructure errors are not cached.
    """
    hashed = df.withColumn("content_hash", F.sha2(F.concat(F.lit(pin + "\n"), F.col(value)), 256))
    known = cache.select("content_hash", "status", "result")
    fresh = hashed.filter("content_hash is not null").dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti")
    made = apply_batches(fresh, "content_hash", value, make).select("content_hash", "status", "result")
    from sievewright.sources.shared import materialize

    made = materialize(made, "judged")
    new = made.filter("status = 'done'")
    return hashed.join(known.unionByName(made), "content_hash", "left").select(key, "status", "result"), new
