"""External models and look-ups as pluggable functions, with deterministic stand-ins that need no network.

A model is a picklable callable ``(prompt) -> answer``; ``asked`` runs it once for
each distinct prompt inside the executors, with retries, and returns the answer
with its statistics. Callers join the answers back.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds between attempts after network errors.
WAITS = (5, 10, 20, 40, 80)
SCHEMA = "prompt string, answer string, attempts int, seconds double, failed boolean"


@dataclass(frozen=True)
class Host:
    """Where a model answers: model, temperature, thinking, place (``local`` or ``cloud``)."""

    model: str
    temperature: float = 0.0
    think: str | None = None
    cloud: bool = False


def think_argument(text: str | None) -> bool | str | None:
    """``true``/``false`` as booleans, low, medium and high as they are, null for none; others raise."""
    if text is None or text == "":
        return None
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("low", "medium", "high"):
        return low
    raise ValueError(f"no thinking mode: {text}")


def asked(prompts: DataFrame, model: Callable[[str], str], column: str = "prompt", waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompt, answer, attempts, seconds, failed of each distinct prompt.

    OSError and TimeoutError are tried again after each wait; when all fail, answer
    is null and failed true. Null prompts are not asked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                began, answer, failed = time.time(), None, True
                for attempt in range(len(waits) + 1):
                    try:
                        answer, failed = model(prompt), False
                        break
                    except (OSError, TimeoutError):
                        if attempt < len(waits):
                            sleep(waits[attempt])
                rows.append((prompt, answer, attempt + 1, time.time() - began, failed))
            yield pd.DataFrame(rows, columns=["prompt", "answer", "attempts", "seconds", "failed"])

    return prompts.select(F.col(column).alias("prompt")).where("prompt is not null").distinct().mapInPandas(run, SCHEMA)


def asked_json(prompts: DataFrame, model: Callable[[str], str], column: str = "prompt", attempts: int = 3) -> DataFrame:
    """prompt, body, attempts, failed of each distinct prompt: asked again until the answer holds a JSON object, ``attempts`` times at most.

    Errors of the model and answers without an object count alike; body is null when
    all fail.
    """
    import json

    from vellumflow.functions.text import balanced_object

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                body, k = None, 0
                while body is None and k < attempts:
                    k += 1
                    try:
                        found = balanced_object(model(prompt))
                        body = found if found is not None and isinstance(json.loads(found), dict) else None
                    except (OSError, TimeoutError, ValueError):
                        body = None
                rows.append((prompt, body, k, body is None))
            yield pd.DataFrame(rows, columns=["prompt", "body", "attempts", "failed"])

    return prompts.select(F.col(column).alias("prompt")).where("prompt is not null").distinct().mapInPandas(run, "prompt string, body string, attempts int, failed boolean")


def profile_stub(prompt: str) -> str:
    """A profile whose modern name is the mention itself, in a region named by its label."""
    said = re.search(r"^Mention: (.*)$", prompt, re.M)
    label = re.search(r"^Label: (.*)$", prompt, re.M)
    name = (said[1] if said else "").replace('"', "")
    return f'```json\n{{"modern_name": "{name}", "country_or_region": "Deutschland; {"hoogte" if label and "E18" in label[1] else "land"}", "type_keywords": ["stad"]}}\n```'


def rerank_stub(prompt: str) -> str:
    """``k: score`` lines for the numbered candidates of a prompt, by a hash."""
    out = []
    for m in re.finditer(r"^(\d+)\. (\S+)", prompt, re.M):
        out.append(f"{m[1]}: {int(hashlib.md5((m[2] + prompt[:40]).encode()).hexdigest(), 16) % 101 / 10}")
    return "\n".join(out)


def select_stub(prompt: str) -> str:
    """The first candidate of a prompt, NIL without one."""
    m = re.search(r"^1\. (\S+)", prompt, re.M)
    return m[1] if m else "NIL"


def tag_stub(text: str, label: str = "E53_Place") -> list[tuple[int, int, str]]:
    """Capitalised words that don't begin a sentence, as (start, end, label)."""
    return [(m.start(), m.end(), label) for m in re.finditer(r"(?<=[a-zà-ÿ,;] )[A-ZÄÖÜ][\w-]+(?: [A-ZÄÖÜ][\w-]+)*", text)]


def tagged(pages: DataFrame, tagger: Callable[[str], list[tuple[int, int, str]]] = tag_stub, attempts: int = 3) -> DataFrame:
    """Pages with ``spans`` (array<struct<start,end,label>>) and ``failed``; a page that fails keeps an empty list. Null texts have none."""

    @F.pandas_udf("spans array<struct<start:int,end:int,label:string>>, failed boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found, failed = [], False
            for k in range(attempts if text is not None else 0):
                try:
                    found, failed = [{"start": a, "end": b, "label": x} for a, b, x in tagger(text) if 0 <= a < b <= len(text)], False
                    break
                except Exception:  # noqa: BLE001
                    failed = True
            rows.append((found, failed))
        return pd.DataFrame(rows, columns=["spans", "failed"])

    return pages.withColumn("_vf_t", run("text")).select("*", "_vf_t.spans", "_vf_t.failed").drop("_vf_t")
