"""Slots for models that need a GPU or a remote service, with deterministic stand-ins. No model is shipped and nothing reaches a network.

A slot is an iterator over Arrow batches of values: what it loads, it loads once
for each worker. A real model takes the stand-in's place by registering under
the same kind; the mode is an argument, never a global.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[pd.Series], pd.Series]
_MAKERS: dict[tuple[str, str], Callable[[], Step]] = {}


def register(kind: str, mode: str, make: Callable[[], Step]) -> None:
    _MAKERS[kind, mode] = make


def _recognise() -> Step:
    """Bytes are taken for the text that they hold; an image of less than ten bytes is unreadable."""
    return lambda s: s.map(lambda b: [] if b is None else [{"text": "[unreadable]" if len(b) < 10 else bytes(b).decode("utf-8", "replace"), "score": 0.0 if len(b) < 10 else 1.0}])


def _table() -> Step:
    return lambda s: s.map(lambda b: None if b is None else "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in bytes(b).decode("utf-8", "replace").split("\n")) + "</table>")


def _font() -> Step:
    """The family by the first byte; nothing for less than 32 bytes."""
    return lambda s: s.map(lambda b: None if b is None or len(b) < 32 else ("Tinos", "Arimo", "Cousine")[b[0] % 3])


def _translate() -> Callable[[pd.DataFrame], pd.Series]:
    """Marks a text with its language, which can be undone."""
    return lambda d: "[" + d["tgt"].astype(str) + "] " + d["text"].astype(str)


register("translate", "local", _translate)  # type: ignore[arg-type]


def maker(kind: str, mode: str) -> Callable:
    """What makes a slot's step in a worker; an unknown mode raises when the plan is made."""
    return _MAKERS[kind, mode]


def translation(text: Column, tgt: Column, mode: str = "local") -> Column:
    """A column of texts in the language of another column; the stand-in stays in the JVM."""
    if mode == "local":
        return F.concat(F.lit("["), tgt, F.lit("] "), text)
    make = _MAKERS["translate", mode]

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        step = make()
        for a, b in parts:
            yield step(pd.DataFrame({"text": a, "tgt": b}))

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text, tgt)


for _kind, _make in (("ocr", _recognise), ("table", _table), ("font", _font)):
    register(_kind, "local", _make)

TYPES = {"ocr": "array<struct<text:string,score:double>>", "table": "string", "font": "string"}


def apply(kind: str, image: Column, mode: str = "local") -> Column:
    """The slot's answer for a binary column; null for null. An unknown mode has no answer and raises when the plan is made."""
    make = _MAKERS[kind, mode]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = make()
        for p in parts:
            yield step(p)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, TYPES[kind])(image)


def translate(df: DataFrame, text: str, tgt: str, out: str = "translated") -> DataFrame:
    """df with a translation: the stand-in marks the text with its language and can be undone. Blank texts stay as they are."""
    return df.withColumn(out, F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.col(text)).otherwise(F.concat(F.lit("["), F.col(tgt), F.lit("] "), F.col(text))))


def untranslate(c: Column) -> Column:
    return F.regexp_replace(c, r"^\[[a-z]{3}_[A-Z][a-z]{3}\] ", "")


def first_answer(answers: list[Column]) -> Column:
    """Of a chain of models, the primary first, the first that gives anything."""
    return F.coalesce(*answers)


# Pipelines by name: DataFrame to DataFrame.
PIPELINES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def pipeline(name: str) -> Callable:
    def add(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PIPELINES[name] = fn
        return fn

    return add


def run_pipeline(name: str, df: DataFrame) -> DataFrame:
    return df.transform(PIPELINES[name])
