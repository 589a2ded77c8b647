"""Places where a model may be plugged in, with deterministic stand-ins, and functions that need Python."""

from __future__ import annotations

import ast
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_embedder(size: int = 64):
    """Texts to unit vectors by hashed words; a user's model has the same shape: texts in, arrays out."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(size, np.float32)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % size] += 1 if h >> 16 & 1 else -1
            n = float(np.sqrt((v * v).sum()))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return run


def symbols(source: str | None) -> list[tuple[str, str, str]]:
    """``(name, kind, body)`` of the functions and classes of Python source; other text is one chunk."""
    text = source or ""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("", "file", text)] if text else []
    found = [(n.name, "class" if isinstance(n, ast.ClassDef) else "function", ast.get_source_segment(text, n) or "") for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return found or ([("", "file", text)] if text else [])


def code_symbols():
    @F.pandas_udf("array<struct<name:string,kind:string,body:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "kind": k, "body": b} for n, k, b in symbols(t)])

    return run


def trigger_match(text: str | None, trigger: str) -> float:
    """Coverage of a trigger's words by a text's, counting equal words and common beginnings of 60 %."""
    words, wanted = (text or "").lower().split(), trigger.lower().split()
    free, hits = list(words), 0
    for w in wanted:
        for k, x in enumerate(free):
            n = next((i for i, (a, b) in enumerate(zip(w, x)) if a != b), min(len(w), len(x)))
            if n >= 0.6 * max(len(w), len(x)):
                hits += 1
                del free[k]
                break
    return 0.7 * hits / max(1, len(wanted)) + 0.3 * hits / max(1, len(words))


def trigger_score(trigger: str):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: trigger_match(t, trigger))

    return run


def phrase_date(phrase: Column, anchor: Column) -> Column:
    """Dates of phrases such as today, yesterday, 3 days ago, 2 weeks ago, last or next month, an ISO date; else null."""
    n = F.regexp_extract(phrase, r"^(\d+) ", 1).cast("int")
    return (
        F.when(phrase == "today", anchor).when(phrase == "yesterday", F.date_sub(anchor, 1)).when(phrase == "tomorrow", F.date_add(anchor, 1))
        .when(F.rlike(phrase, F.lit(r"^\d+ days? ago$")), F.date_sub(anchor, n)).when(F.rlike(phrase, F.lit(r"^\d+ weeks? ago$")), F.date_sub(anchor, n * 7)).when(F.rlike(phrase, F.lit(r"^\d+ months? ago$")), F.add_months(anchor, -n))
        .when(phrase == "last month", F.add_months(anchor, -1)).when(phrase == "next month", F.add_months(anchor, 1)).when(F.rlike(phrase, F.lit(r"^\d{4}-\d\d-\d\d$")), F.try_to_date(phrase))
    )


