"""License scan by patience alignment of texts with license texts, standard headers and short notices.

Words unique to both sides are anchors; the longest increasing subsequence of their places keeps the
order; the gaps between kept anchors are aligned the same way, down to gaps without anchors, which a
longest common subsequence finishes. A template's coverage is the share of
its words that are aligned.

Only places that can reach the coverage are aligned: a place must hold enough of the template's words,
each counted as often as the template has it, and its common subsequence must be long enough.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Short notices looked for, by SPDX identifier where there is one. Fixed values.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}


def with_texts(notices: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """The notices, and the whole texts and standard headers (NAME.txt and NAME.header.txt) of the folder licenses beside this file."""
    out = {k: (v,) for k, v in notices.items()}
    for file in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        name = file.name.removesuffix(".txt").removesuffix(".header")
        out[name] = (*out.get(name, ()), file.read_text(encoding="utf-8"))
    return out


#: Templates by license.
TEMPLATES = with_texts(NOTICES)
#: Share of a template's words that must be aligned; foreign words that an end of a notice may reach over; cells of a plain alignment.
COVERAGE = 0.8
GAP = 6
PLAIN_CELLS = 40_000
_EDGES = ".,;:!?()[]{}<>\"'`*_#|/"
_WORD = re.compile(r"\S+")


def words_of(text: str) -> list[str]:
    """Lower-case words between white space, without punctuation at their ends."""
    return [w.strip(_EDGES) for w in text.lower().split()]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
            top.append(i)
        else:
            tails[k], top[k] = p, i
        back[i] = top[k - 1] if k else -1
    out, i = [], top[-1] if top else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs (i, j) with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        at = {w: k for k, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = [(k, at[w]) for k, w in enumerate(a[i:m], i) if in_a[w] == 1 and w in at]
        kept = [anchors[k] for k in increasing([p for _, p in anchors])]
        if kept:
            out += kept
            edges = [(i - 1, j - 1), *kept, (m, n)]
            stack += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
        else:
            out += [(i + x, j + y) for x, y in longest_common(a[i:m], b[j:n])]
    return sorted(out)


def longest_common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence. Tables above PLAIN_CELLS are halved by the lengths up to their middle, in memory linear in the words."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= PLAIN_CELLS:
            out += [(i + x, j + y) for x, y in _common(a[i:m], b[j:n])]
        elif m - i == 1:
            out += [(i, j + b[j:n].index(a[i]))] if a[i] in b[j:n] else []
        else:
            half = (i + m) // 2
            head, tail = _lengths(a[i:half], b[j:n]), _lengths(a[half:m][::-1], b[j:n][::-1])
            cut = j + max(range(n - j + 1), key=lambda k: head[k] + tail[n - j - k])
            stack += [(i, half, j, cut), (half, m, cut, n)]
    return sorted(out)


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequence of a with each beginning of b; a bit for each word of b."""
    at: dict[str, int] = {}
    for k, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    left = full
    for w in a:
        x = left & at.get(w, 0)
        left = (left + x | left - x) & full
    return list(accumulate((bit == "0" for bit in reversed(f"{left:0{len(b)}b}")), initial=0))


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@dataclass(frozen=True)
class Notice:
    license: str
    first: int  # word indices, the end exclusive
    past: int
    coverage: float
    aligned: int  # words


class Template:
    def __init__(self, license: str, words: list[str], coverage: float) -> None:
        self.license, self.words, self.coverage = license, words, coverage
        self.times = Counter(words)
        self.least = coverage * len(words) - 1e-9
        self._bits: dict[str, int] = {}  # of each word's places; filled where it is needed

    def common(self, words: list[str]) -> int:
        """Length of the longest common subsequence with words, a bit for each word of the template."""
        if not self._bits:
            for i, w in enumerate(self.words):
                self._bits[w] = self._bits.get(w, 0) | 1 << i
        full = (1 << len(self.words)) - 1
        left = full
        for w in words:
            at = left & self._bits.get(w, 0)
            if at:
                left = (left + at | left - at) & full
        return len(self.words) - left.bit_count()

    def places(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """Alignments that reach the coverage, by place and apart from each other, as pairs of places in words and template."""
        hits = np.array([i for i, w in enumerate(words) if w in self.times], np.int64)
        far = max(2 * len(self.words), len(self.words) + GAP) - self.least + 1  # over a longer gap no window holds enough words
        out, cuts = [], [0, *(np.flatnonzero(np.diff(hits) > far) + 1).tolist(), len(hits)]
        for start, k in zip(cuts, cuts[1:], strict=False):
            out += self._of_stretch(words, int(hits[start]), int(hits[k - 1]) + 1) if k - start >= self.least else []
        return out

    def _of_stretch(self, words: list[str], first: int, past: int) -> list[list[tuple[int, int]]]:
        n, found = len(self.words), []
        if max(self._held(words, first, past, max(2 * n, n + GAP)), default=0) < self.least:
            return []
        # narrow windows part copies that touch; wide ones find copies with words put in
        for width in (n, n + GAP, max(2 * n, n + GAP)):
            edges = [first, *(e for pairs in found for e in (pairs[0][0], pairs[-1][0] + 1)), past]
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= self.least:
                    found += self._windows(words, a, b, width)
            found.sort()
        ends = [first, *(pairs[-1][0] + 1 for pairs in found)]
        starts = [*(pairs[0][0] for pairs in found[1:]), past]
        return [self._grown(words, pairs, a, b) for pairs, a, b in zip(found, ends, starts, strict=False)]

    def _held(self, words: list[str], a: int, b: int, width: int) -> list[int]:
        """How many of the template's words, each counted as often as the template has it, the window from each place holds."""
        # an occurrence counts in the windows that hold it, but not as many earlier ones as the template has
        times, places, steps = self.times, {}, [0] * (b - a + 1)
        for k, w in enumerate(words[a:b]):
            if w in times:
                n, seen = times[w], places.setdefault(w, [])
                first = k - width + 1 if k >= width else 0
                if len(seen) >= n and seen[-n] >= first:
                    first = seen[-n] + 1
                seen.append(k)
                steps[first] += 1
                steps[k + 1] -= 1
        return list(accumulate(steps[:-1]))

    def _windows(self, words: list[str], a: int, b: int, width: int) -> Iterator[list[tuple[int, int]]]:
        score = self._held(words, a, b, width)
        at = a
        while at < b:
            if score[at - a] < self.least:
                at += 1
                continue
            size = self.common(words[at : min(at + width, b)])
            if size < self.least:
                at += max(1, int(self.least - size))  # a step brings one word more at most
                continue
            # the place that holds most, among those that begin before this one's words are through
            near = range(at, min(b, at + max(1, min(width - int(self.least), int(self.least)))))
            best = max(near, key=lambda i: score[i - a])
            pairs = patience_align(words[best : min(best + width, b)], self.words)
            if len(pairs) < self.least:
                best, pairs = at, patience_align(words[at : min(at + width, b)], self.words)
            if len(pairs) < self.least:
                pairs = longest_common(words[at : min(at + width, b)], self.words)
            yield [(best + i, j) for i, j in pairs]
            at = best + pairs[-1][0] + 1

    def _grown(self, words: list[str], pairs: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
        """The alignment with the template's words that its window cut off, as far as no more than GAP words stand between."""
        n = len(self.words)
        if len(pairs) == n:
            return pairs
        (i, j), (u, v) = pairs[0], pairs[-1]
        if j:
            a = max(a, i - 2 * j - GAP)
            for x, y in reversed(patience_align(words[a:i], self.words[:j])):
                if pairs[0][0] - (a + x) - 1 > GAP:
                    break
                pairs = [(a + x, y), *pairs]
        if v < n - 1:
            for x, y in patience_align(words[u + 1 : min(b, u + 1 + 2 * (n - 1 - v) + GAP)], self.words[v + 1 :]):
                if u + 1 + x - pairs[-1][0] - 1 > GAP:
                    break
                pairs = [*pairs, (u + 1 + x, v + 1 + y)]
        return pairs


class LicenseScanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.order = {k: i for i, k in enumerate(templates)}
        texts = [(k, [w for w in words_of(t) if w]) for k, v in templates.items() for t in ((v,) if isinstance(v, str) else v)]
        self.templates = [Template(k, words, coverage) for k, words in texts if words]
        self.places = {w: i for i, w in enumerate(sorted({w for t in self.templates for w in t.times}))}
        self.times = np.zeros((len(self.places), len(self.templates)), np.int32)
        for k, t in enumerate(self.templates):
            for w, n in t.times.items():
                self.times[self.places[w], k] = n
        self.least = np.array([t.least for t in self.templates])

    def notices(self, words: list[str]) -> list[Notice]:
        """Places of every template, by place; of overlapping ones that with the most aligned words, then the highest coverage, then the first listed."""
        whole = [i for i, w in enumerate(words) if w]  # what is punctuation only is no word
        words = [words[i] for i in whole]
        held = [(self.places[w], n) for w, n in Counter(words).items() if w in self.places]
        if not held:
            return []
        rows, n = np.array(held).T
        found = []
        for k in np.flatnonzero(np.minimum(self.times[rows], n[:, None]).sum(0) >= self.least):
            t = self.templates[k]
            for pairs in t.places(words):
                share = len(pairs) / len(t.words)
                notice = Notice(t.license, whole[pairs[0][0]], whole[pairs[-1][0]] + 1, share, len(pairs))
                found.append((*self.rank(notice), notice.first, notice.past, notice))
        found.sort(key=lambda x: x[:-1])
        kept: list[Notice] = []
        firsts: list[int] = []
        for *_, n in found:
            at = bisect_left(firsts, n.first)
            if (at == 0 or kept[at - 1].past <= n.first) and (at == len(kept) or n.past <= kept[at].first):
                firsts.insert(at, n.first)
                kept.insert(at, n)
        return kept

    def rank(self, notice: Notice) -> tuple[int, float, int]:
        """The best notice has the least."""
        return -notice.aligned, -notice.coverage, self.order[notice.license]


def scan_licenses(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, license, coverage, n_notices, spans.

    license and coverage are of the best notice (most aligned words, then the highest coverage, then
    the first listed), null and 0 without one. spans: license:start:end by start, comma-joined; code points, ends exclusive.
    Up to as many foreign words as a template has may stand inside its notice. Null and empty texts have
    none. Whole texts are scanned whatever their length; repeated rows are scanned each, and equal texts
    alike; other columns don't matter; an empty table gives an empty result.
    """
    scanner = scanner or LicenseScanner()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(1):
                text = item.as_py() or ""
                found = scanner.notices(words_of(text))
                if not found:
                    rows.append((None, 0.0, 0, ""))
                    continue
                best = min(found, key=scanner.rank)
                at = [m.span() for m in _WORD.finditer(text)]
                spans = ",".join(f"{n.license}:{at[n.first][0]}:{at[n.past - 1][1]}" for n in found)
                rows.append((best.license, best.coverage, len(found), spans))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "license", "coverage", "n_notices", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, coverage double, n_notices long, spans string")
