"""Outside model calls as an injected stage, and reading of noisy answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATCH = "array<struct<path:string,valor:string,evidencia:string,confianca:string>>"


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text that may hold fences and prose; None without one."""
    if not text:
        return None
    at = text.find("{")
    while at >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            elif c == '"':
                quoted = True
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    body = text[at : i + 1]
                    try:
                        json.loads(body)
                    except ValueError:
                        break
                    return body
        at = text.find("{", at + 1)
    return None


#: Signs of errors that pass, and of those that don't.
PASSING, LASTING = ("rate", "429", "overload", "timeout"), ("401", "403", "invalid_api_key", "authentication", "permission")
ATTEMPTS, STEP_SECONDS, MOST_SECONDS = 4, 3.0, 20.0


def normal_answer(raw: object) -> str | None:
    """An answer as text without white space around it, with plain line breaks; None for other kinds and for nothing."""
    if not isinstance(raw, str):
        return None
    return raw.strip().replace("\r\n", "\n") or None


def answer_text(answer: object) -> str | None:
    """The text of an answer: a string, an object with text parts in ``content``, or one with a first choice's message."""
    if answer is None or isinstance(answer, str):
        return normal_answer(answer)
    choices = getattr(answer, "choices", None)
    if choices is not None:
        answer = getattr(choices[0], "message", None) if choices else None
    content = getattr(answer, "content", None)
    if isinstance(content, str):
        return normal_answer(content)
    parts = [p.get("text") if isinstance(p, dict) and p.get("type") == "text" else getattr(p, "text", None) for p in content or []]
    return normal_answer("".join(p for p in parts if p))


def error_class(error: Exception) -> tuple[bool, str]:
    """Whether an error may pass when tried again, and what it was."""
    name, said = type(error).__name__, str(error).lower()
    if isinstance(error, ImportError):
        return False, f"{name}: dependencia ausente"
    if any(s in said for s in PASSING):
        return True, f"{name}: limite ou sobrecarga"
    if any(s in said for s in LASTING):
        return False, f"{name}: autenticacao"
    return False, f"{name}: {error}"


def provider_order(mode: str, primary: str, usable: dict[str, bool]) -> list[str]:
    """The providers to ask: the one that the mode names, or in mode auto the primary and then the others, as far as they are usable."""
    if mode != "auto":
        return [mode]
    names = [primary, *(n for n in usable if n != primary)]
    return [n for n in names if usable.get(n)]


def ask(prompt: str, provider: Callable[[str], object], attempts: int = ATTEMPTS, step: float = STEP_SECONDS, most: float = MOST_SECONDS) -> tuple[str | None, str | None]:
    """(answer, error) of one provider: errors that may pass are tried again after growing pauses, others aren't."""
    said = None
    for k in range(attempts):
        try:
            return answer_text(provider(prompt)), None
        except Exception as e:  # noqa: BLE001  providers fail in any way
            again, said = error_class(e)
            if not again:
                break
            if k + 1 < attempts and step:
                time.sleep(min(step * (k + 1), most))
    return None, said


def call(prompts: DataFrame, providers: list[Callable[[str], object]], attempts: int = ATTEMPTS, step: float = STEP_SECONDS, most: float = MOST_SECONDS, key: str = "doc") -> DataFrame:
    """(doc, answer, provider, error): each prompt goes to the providers in turn until one answers. No failure is raised."""
    def run(batches):
        for b in batches:
            out = []
            for doc, prompt in zip(b[key], b["prompt"], strict=True):
                answer = name = error = None
                for n, provider in enumerate(providers):
                    answer, error = ask(prompt, provider, attempts, step, most)
                    if answer:
                        name = getattr(provider, "__name__", str(n))
                        break
                out.append((doc, answer, name, None if answer else error))
            yield pd.DataFrame(out, columns=[key, "answer", "provider", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, answer string, provider string, error string")


def objects(texts: DataFrame, column: str = "answer", out: str = "body") -> DataFrame:
    """texts with the first JSON object of a column, null without one."""
    @F.pandas_udf("string")
    def body(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    return texts.withColumn(out, body(column))


def patches(answers: DataFrame, key: str = "doc") -> DataFrame:
    """(doc, pos, path, value, evidence, confidence) of the answers' patch lists; an answer without one gives no rows."""
    rows = objects(answers).select(key, F.posexplode(F.from_json("body", f"patch {PATCH}")["patch"]).alias("pos", "x"))
    return rows.select(key, "pos", F.col("x.path").alias("path"), F.col("x.valor").alias("value"), F.col("x.evidencia").alias("evidence"), F.col("x.confianca").alias("confidence"))


def prompt_text(parts: DataFrame, head: str, limit: int = 60_000, key: str = "doc"):
    """(doc, prompt): a fixed head and each document's text, cut at the last line break within the limit."""
    room = limit - len(head) - 2
    cut = F.left("text", F.lit(room))
    whole = F.when(F.length("text") <= room, F.col("text")).otherwise(F.regexp_replace(cut, r"\n[^\n]*$", ""))
    return parts.select(key, F.concat(F.lit(head + "\n\n"), whole).alias("prompt"))
