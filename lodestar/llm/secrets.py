"""Secret scans: regular base formats and formats inferred as probabilistic automata.

Base scans find assignments, access keys and hexadecimal runs by fixed patterns.
From credentials that a base scan has labelled, grammar inference builds a
prefix tree over format symbols and merges states whose continuations agree
within a Hoeffding bound (the red and blue procedure), which gives one
probabilistic automaton a kind. Every other credential-like run of a text is
then scored by its likelihood under each automaton against that of ordinary
runs, and what fits a format well enough is a span of kind ``like``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import written

KINDS = ("assign", "access", "hex", "like")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched from its start, so this keeps the runs of 24 and more
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Most labelled credentials of each kind, and most ordinary runs, that inference reads, and the longest of either (the documented bounds of the sample; scores have none).
PER_KIND, ORDINARY, LONGEST = 600, 2000, 256
#: Least mean log-likelihood ratio a character, in bits, of a span of kind ``like``.
LEAST_BITS = 0.7
_SIZE = 16  # symbols that smoothing shares among: five sets, six separators, a few literals and the end
#: Characters of a beginning that is a format's own, the least part of a kind's credentials that have it, and their least number.
HEAD, HEAD_SHARE, HEAD_COUNT = 4, 0.05, 5
_CLASSES = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "1" * 6 + "2" * 20 + "3" * 6 + "4" * 20)


def symbols(run: str, heads: frozenset[str] = frozenset()) -> str:
    """A run as format symbols, one a character.

    Digits, ``a-f``, ``g-z``, ``A-F`` and ``G-Z`` are 0 to 4, separators stay as they are;
    a beginning among ``heads`` is spelled in symbols of its own.
    """
    if run[:HEAD] in heads:
        return "".join([chr(0xE000 + ord(c)) for c in run[:HEAD]]) + run[HEAD:].translate(_CLASSES)
    return run.translate(_CLASSES)


def frequent_heads(runs: list[str]) -> frozenset[str]:
    """Beginnings that many of a kind's credentials share, such as a key's issuer mark."""
    seen = Counter(r[:HEAD] for r in runs)
    return frozenset(h for h, n in seen.items() if n >= max(HEAD_COUNT, HEAD_SHARE * len(runs)))


class Automaton:
    """A deterministic probabilistic automaton: counts of next states and of ends."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]

    @classmethod
    def inferred(cls, strings: list[str], alpha: float = 0.05) -> Automaton:
        """Merge the compatible states of the strings' prefix tree; an empty list gives an automaton that accepts nothing."""
        tree = cls()
        for s in sorted(strings):
            at = 0
            for c in s:
                tree.seen[at][c] = tree.seen[at].get(c, 0) + 1
                if c not in tree.next[at]:
                    tree.next[at][c] = len(tree.next)
                    tree.next.append({})
                    tree.seen.append({})
                    tree.ends.append(0)
                at = tree.next[at][c]
            tree.ends[at] += 1
        tree._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        return tree

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def _differ(self, a: int, na: int, b: int, nb: int, bound: float) -> bool:
        return abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            nx, ny = self.total(x), self.total(y)
            if not nx or not ny:
                continue
            if self._differ(self.ends[x], nx, self.ends[y], ny, bound):
                return False
            for c in self.seen[x].keys() | self.seen[y].keys():
                if self._differ(self.seen[x].get(c, 0), nx, self.seen[y].get(c, 0), ny, bound):
                    return False
                if c in self.next[x] and c in self.next[y] and self.next[x][c] != self.next[y][c]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            for c, n in self.seen[y].items():
                self.seen[x][c] = self.seen[x].get(c, 0) + n
                if c in self.next[x]:
                    todo.append((self.next[x][c], self.next[y][c]))
                else:
                    self.next[x][c] = self.next[y][c]

    def _merge(self, bound: float) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda e: -self.total(self.next[e[0]][e[1]]))
            src, c = blue.pop(0)
            q = self.next[src][c]
            into = next((r for r in red if self._compatible(r, q, bound)), None)
            if into is None:
                red.append(q)
                blue += [(q, d) for d in sorted(self.next[q])]
            else:
                self.next[src][c] = into
                self._fold(into, q)
                reds = set(red)
                blue = [(r, d) for r in red for d in sorted(self.next[r]) if self.next[r][d] not in reds]

    def compiled(self) -> Automaton:
        """With tables of log2-probabilities, smoothed by a little of the uniform."""
        self.arcs, self.stop = [], []
        for q in range(len(self.next)):
            n = self.total(q)
            self.arcs.append({c: (math.log2(0.98 * self.seen[q].get(c, 0) / n + 0.02 / _SIZE), to) for c, to in self.next[q].items()} if n else {})
            self.stop.append(math.log2((0.98 * self.ends[q] / n if n else 0) + 0.02 / _SIZE))
        return self

    def bits(self, s: str) -> float:
        """Log2-likelihood of a string of symbols; a string that leaves the automaton pays for all of its symbols."""
        at, out, arcs = 0, 0.0, self.arcs
        for c in s:
            step = arcs[at].get(c)
            if step is None:
                return out + (len(s) + 1) * math.log2(0.02 / _SIZE)
            out += step[0]
            at = step[1]
        return out + self.stop[at]


class Ordinary:
    """A symbol-bigram model of runs that are no credentials."""

    def __init__(self, strings: list[str]):
        pairs: dict[tuple[str, str], int] = defaultdict(int)
        firsts: dict[str, int] = defaultdict(int)
        for s in strings:
            for a, b in zip("^" + s, s + "$"):
                pairs[a, b] += 1
                firsts[a] += 1
        self.pairs, self.firsts = dict(pairs), dict(firsts)

    def bits(self, s: str) -> float:
        return sum(math.log2((self.pairs.get((a, b), 0) + 0.5) / (self.firsts.get(a, 0) + 0.5 * _SIZE)) for a, b in zip("^" + s, s + "$"))


class Model:
    """Automata by kind and the model of ordinary runs."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str], least_bits: float = LEAST_BITS):
        credentials = {k: v for k, v in sorted(credentials.items()) if v}
        self.heads = frozenset().union(*map(frequent_heads, credentials.values()))
        formats = {k: [symbols(s, self.heads) for s in v] for k, v in credentials.items()}
        self.automata = {k: Automaton.inferred(v).compiled() for k, v in formats.items()}
        self.ordinary, self.least = Ordinary([symbols(s, self.heads) for s in ordinary]), least_bits
        # a format's own credentials set how likely a member of it has to be
        self.floor = {k: float(np.quantile([self.automata[k].bits(s) / (len(s) + 1) for s in v], 0.02)) for k, v in formats.items()}

    def score(self, run: str) -> float:
        """Bits a character by which the best format beats ordinary text; -inf if no format would write the run."""
        s, best = symbols(run, self.heads), -math.inf
        base = None
        for k, a in self.automata.items():
            own = a.bits(s)
            if own / (len(s) + 1) >= self.floor[k]:
                base = self.ordinary.bits(s) if base is None else base
                best = max(best, (own - base) / (len(s) + 1))
        return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base scans, in order; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6] if (":" in text or "=" in text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """Runs of 16 and more credential characters that touch no base span."""
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # the spans that begin before the run's end
        if not before or reach[before - 1] <= m.start():
            yield m.start(), m.end(), m.group()


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_kind: int = PER_KIND) -> Model:
    """Automata inferred from at most ``per_kind`` different credentials of each kind.

    Base scans label the credentials: the value of an assignment, an access key,
    a hexadecimal run. The sample takes the smallest hashes of the whole corpus;
    what is longer than ``LONGEST`` teaches no format.
    """

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                for s, k, e in base:
                    found = text[s:e]
                    if k == 0:
                        found = _ASSIGN.match(found).group(2)
                    rows.append((KINDS[k], found))
                rows += [("", run) for _, _, run in candidates(text, base)]
            rows = [r for r in rows if len(r[1]) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([r for _, r in rows], pa.string())], ["kind", "run"])

    runs = written(docs.select(F.col(text_col).alias("text")).mapInArrow(harvest, "kind string, run string").distinct(), "secret-runs")
    got = {k: [r["run"] for r in runs.filter(F.col("kind") == k).orderBy(F.xxhash64("run"), "run").limit(n).collect()] for k, n in [*((k, per_kind) for k in KINDS[:3]), ("", ORDINARY)]}
    return Model({k: got[k] for k in KINDS[:3]}, got[""])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets count code points of the whole text, ends are exclusive. Null text
    counts as empty; without spans the string is empty and the digest that of an
    empty string. Repeated rows are scanned each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 1 MB whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                base = base_spans(text)
                more = [(s, 3, e) for s, e, r in candidates(text, base) if found.score(r) >= found.least]
                kinds = [k for _, k, _ in base]
                rows.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
