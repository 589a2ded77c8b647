"""Text functions: filters, classifiers, hashes, chunkers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import released

#: Content classes by ordered tests on the text.
CLASSES = (
    ("stacktrace", r"Traceback \(most recent call last\)|(?m)^\s+at [\w.$]+\("),
    ("log", r"(?m)^\d{4}-\d\d-\d\d[ T]\d\d:\d\d"),
    ("json", r"^\s*[\[{][\s\S]*[\]}]\s*$"),
    ("env", r"(?m)^[A-Z_]{3,}=\S"),
    ("sql", r"(?i)^\s*(select|insert|update|delete|create)\s"),
    ("shell", r"(?m)^\$ \w"),
    ("code", r"(?m)^\s*(def|class|function|import|return)\s"),
    ("markdown", r"(?m)^#{1,6} "),
    ("table", r" \| "),
)


def content_class(text: str = "text", classes=CLASSES) -> Column:
    out = F.lit("text")
    for name, pattern in reversed(classes):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def kept_lines(text: str, drop: str, most: int) -> Column:
    """The first ``most`` lines that do not match ``drop``; URLs of dropped lines are appended (nothing that locates is lost)."""
    lines = F.split(text, "\n")
    kept = F.slice(F.filter(lines, lambda x: ~F.rlike(x, F.lit(drop))), 1, most)
    urls = F.array_except(F.regexp_extract_all(text, F.lit(r"(https?://[^\s]+)")), F.regexp_extract_all(F.array_join(kept, "\n"), F.lit(r"(https?://[^\s]+)")))
    return F.array_join(F.concat(kept, urls), "\n")


def token_estimate(text: str = "text") -> Column:
    return F.floor(F.length(text) / 4)


def normal_hash(text: str = "text") -> Column:
    """SHA-256 of the lower-case text with runs of white space as one space, trimmed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", F.lit(" "))), 256)


def platt(score: Column, a: float, b: float) -> Column:
    p = 1 / (1 + F.exp(a * score + b))
    return F.when(F.isnan(p) | p.isNull(), 0.0).otherwise(p)


class _Strip(HTMLParser):
    BLOCKS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.off = 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.off = max(0, self.off - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def html_lines(source: str | None) -> str:
    """All text of a page; a newline at the end of each block element."""
    p = _Strip()
    p.feed(source or "")
    p.close()
    return "".join(p.out).strip()


def strip_html(html: str) -> Column:
    """``html_lines`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_lines)

    return run(html)


def pack(pieces: list[str], size: int, overlap: bool, joiner: str) -> list[str]:
    """Greedy packing of pieces into chunks of at most ``size`` characters; a longer piece is cut.

    With ``overlap`` a chunk starts with the last piece of the one before, where both fit.
    """
    out: list[str] = []
    now: list[str] = []
    long = [p[k : k + size] for p in pieces for k in range(0, max(1, len(p)), size)]
    for p in long:
        if now and len(joiner.join([*now, p])) > size:
            out.append(joiner.join(now))
            now = [now[-1]] if overlap and len(now[-1]) + len(joiner) + len(p) <= size else []
        now.append(p)
    return [*out, joiner.join(now)] if now else out


_FENCE = re.compile(r"(```.*?(?:```|\Z))", re.DOTALL)
_HEADING = re.compile(r"(?m)^(?=#{1,6} )")
_LEVEL = re.compile(r"(?m)^(?=\d{4}-\d\d-\d\d|\[?(?:ERROR|WARN|INFO|DEBUG))")
_CODE = re.compile(r"(?m)^(?=(?:def|class|async def|function|func|public|private) )")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def chunks(text: str, kind: str, size: int = 1500) -> list[str]:
    """Chunks of at most ``size`` characters by kind of content: markdown, code, log, sentence, text."""
    text = text or ""
    if kind == "markdown":
        parts = [(p, p.startswith("```")) for p in _FENCE.split(text) if p.strip()]
        return [c for p, code in parts for section in ([p] if code else _HEADING.split(p)) if section.strip() for c in pack([section.strip()] if code else section.strip().split("\n\n"), size, False, "\n\n")]
    if kind in ("code", "log"):
        return pack([p.rstrip() for p in (_CODE if kind == "code" else _LEVEL).split(text) if p.strip()], size, False, "\n")
    if kind == "sentence":
        return pack([s for s in _SENTENCE.split(text) if s.strip()], size, True, " ")
    return pack([p.strip() for p in text.split("\n") if p.strip()], size, True, "\n")


def chunked(kind: str, size: int = 1500):
    """A function from texts to arrays of chunks, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunks(t, kind, size))

    return run


def chunk_rows(docs: DataFrame, key: str, text: str, kind: str, size: int = 1500) -> DataFrame:
    """``(key, n, chunk)``, a row a chunk in order; a reply holds the chunks of few texts, so memory doesn't grow with a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [chunks(t, kind, size) for t in part.column(1).to_pylist()]
                at = pa.array([r for r, c in enumerate(found) for _ in c], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([n for c in found for n in range(len(c))], pa.int32()), pa.array([x for c in found for x in c], pa.string())], [key, "n", "chunk"])

    return docs.select(key, text).mapInArrow(released(run), f"{key} {dict(docs.dtypes)[key]}, n int, chunk string")
