"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of one character class with a digit and a letter in it; each class takes
its own runs, also those inside wider runs. A window slides over it; the entropy of the window follows
from the counts of its characters, of which each step changes two. Windows at or above the class's
threshold are merged to spans, unless most of the window is words (paths, identifiers) or an allow-list
entry covers them; then the spans of all classes that overlap are merged. Every step reads a text a
fixed number of times, so the work is linear in its length, however long its runs are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The base kinds in their order, with pattern, group that is measured, and its least length. Fixed values.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: What the base patterns need, lower-cased: most texts hold none of it.
_ASSIGN_WORDS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class CharClass:
    """Runs of chars of window or more characters are candidates; threshold: bits a character; words: windows that are words for the most part don't count."""

    kind: str
    pattern: str
    window: int
    threshold: float
    words: bool = False


#: Merged spans have the kind of the longest one, of equal ones the first class. An equals sign only pads; elsewhere it parts a key from its value.
CLASSES = (CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 2.9), CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 3.6, words=True))
#: What looks random and isn't secret: UUIDs, digests named as such. A pattern begins with what is rare or of fixed length, so that no run is read again from each of its places.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:sha(?:1|256|512)|md5)[-:][0-9A-Za-z+/=]+",
)
#: Words that make the run they stand in a placeholder, and beginnings of counted sequences, which go on to the run's end.
PLACEHOLDERS = ("example", "placeholder", "changeme", "dummy", "xxxxxx")
SEQUENCES = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "1234567890")
#: A part of a run, between marks, that reads as a word or number: one case, or humps, and a short number at the end.
_WORDS = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+)[0-9]{0,4}|[0-9]{1,8}")
_PART = re.compile(r"[^+/_=-]+")


@dataclass(frozen=True)
class SecretScanner:
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    placeholders: tuple[str, ...] = PLACEHOLDERS
    sequences: tuple[str, ...] = SEQUENCES
    _runs: tuple[re.Pattern, ...] = field(init=False)
    _allow: tuple[re.Pattern, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_runs", tuple(re.compile(c.pattern) for c in self.classes))
        object.__setattr__(self, "_allow", tuple(map(re.compile, self.allowed)))

    def base_spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the fixed patterns, by start, then kind in the order of BASE."""
        found, low = [], text.lower()
        for order, (kind, pattern, group, least) in enumerate(BASE):
            if kind == "assign" and not any(w in low for w in _ASSIGN_WORDS):
                continue
            # a run too short for its kind can't hold a longer one, so the measured length filters whole matches
            found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return [(a, b, kind) for a, _, b, kind in sorted(found)]

    def quiet_spans(self, text: str) -> tuple[list[int], list[int]]:
        """Starts and ends of what the allowed patterns match, merged where they overlap."""
        starts: list[int] = []
        ends: list[int] = []
        for a, b in sorted(m.span() for p in self._allow for m in p.finditer(text)):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        return starts, ends

    def quiet_from(self, run: str) -> int:
        """The place in a run from which on it is a placeholder or a counted sequence."""
        low = run.lower()
        if any(w in low for w in self.placeholders):
            return 0
        return min((at for w in self.sequences if (at := low.find(w)) >= 0), default=len(run))

    def entropy_spans(self, text: str) -> list[tuple[int, int, str]]:
        found, quiet = [], None
        for order, (c, runs) in enumerate(zip(self.classes, self._runs, strict=True)):
            for m in runs.finditer(text):
                run = m.group()
                if not re.search(r"[0-9]", run) or not re.search(r"[A-Za-z]", run):
                    continue
                if quiet is None:
                    quiet = self.quiet_spans(text)
                past = self.quiet_from(run)
                for a, b in dense_windows(run, c.window, c.threshold, odd_counts(run) if c.words else None):
                    k = bisect_right(quiet[0], m.start() + a) - 1
                    if a < past and (k < 0 or quiet[1][k] < m.start() + b):
                        found.append((m.start() + a, m.start() + b, order))
        out: list[tuple[int, int, int, int]] = []  # start, end, less the longest span's length, its class
        for a, b, order in sorted(found):
            if out and a < out[-1][1]:
                x, y, *longest = out[-1]
                out[-1] = (x, max(y, b), *min(tuple(longest), (a - b, order)))
            else:
                out.append((a, b, a - b, order))
        return [(a, b, self.classes[order].kind) for a, b, _, order in out]

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans, and all spans by start, then kind."""
        base = self.base_spans(text)
        order = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(c.kind for c in self.classes)])}
        return base, sorted([*base, *self.entropy_spans(text)], key=lambda s: (s[0], order[s[2]], s[1]))


def odd_counts(run: str) -> list[int]:
    """For each place, how many characters before it stand in no word or number of the run."""
    odd = bytearray(b"\1" * len(run))
    for m in _PART.finditer(run):
        if _WORDS.fullmatch(run, m.start(), m.end()):
            odd[m.start() : m.end()] = bytes(m.end() - m.start())
    return list(accumulate(odd, initial=0))


def dense_windows(run: str, window: int, threshold: float, odd: list[int] | None = None) -> list[tuple[int, int]]:
    """The union of the windows of run whose entropy is at least threshold. Each step adds one character and removes one. odd: only windows of which half or more counts as odd."""
    weight = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    # entropy = log2(window) - sum(n * log2(n)) / window
    most = (log2(window) - threshold) * window + 1e-9
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, ch in enumerate(run):
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        if i >= window:
            old = run[i - window]
            total += (weight[n + 1] if n < window else weight[n]) - weight[n]
            k = counts[old]
            total += weight[k - 1] - weight[min(k, window)]
            counts[old] = k - 1
        else:
            total += weight[n + 1] - weight[n]
        if total <= most and i + 1 >= window and (odd is None or 2 * (odd[i + 1] - odd[i + 1 - window]) >= window):
            start = i + 1 - window
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, scanner: SecretScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (and the digest of
    the empty string); whole texts are scanned whatever their length. Repeated rows are scanned
    each; other columns don't matter; an empty table gives an empty result.
    """
    scanner = scanner or SecretScanner()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = scanner.scan(text.as_py() or "")
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
