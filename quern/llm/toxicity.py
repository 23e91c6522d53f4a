"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier.

Voters are lexicon terms (common insults, and words and word beginnings mined from the labelled
sample), each once for a hit and once for several; text patterns; and a voter for clean, where hits are
too few for the text's length. Each votes one way or not at all; the sample's own
labels are one voter more, which may err like the others. The label model treats
a document's class as hidden and gives each voter a rate of each vote in each class; expectation
maximisation estimates the rates. Voters that agree more than their classes explain are correlated, and
each counts by one over its correlated company (estimated from triplets). The posterior labels then
train a logistic classifier over hits, their share of the text, patterns, and words beyond the lexicon.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .labelled import fit_logistic, labelled_sample, sigmoid
from .quality import score_documents

FOLDS, HELD_OUT = 5, 0
LABEL = "toxic"
#: Common insults in four languages, which vote whatever the sample holds. Fixed values.
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "dimwit", "disgusting", "dumb", "dumbass", "dunce", "fool", "freak", "garbage", "halfwit", "idiot", "idiotic", "imbecile", "jackass", "jerk", "loser", "moron", "nitwit", "parasite", "pathetic", "pig", "prick", "scum", "scumbag", "shit", "slut", "stupid", "trash", "twat", "vermin", "wanker", "whore", "worthless",
    "abschaum", "arschloch", "blödmann", "depp", "dreckskerl", "dummkopf", "hurensohn", "miststück", "schlampe", "schwachkopf", "trottel", "vollidiot", "wichser",
    "abruti", "connard", "connasse", "débile", "enculé", "imbécile", "ordure", "pourriture", "salaud", "salope",
    "basura", "cabrón", "estúpido", "gilipollas", "idiota", "imbécil", "pendejo", "puta",
)
#: Mined terms at most; a term's least odds ratio; chances of one term by luck among all.
LEXICON = 240
LEAST_ODDS = 12.0
LUCK = 1e-1
#: The least odds ratio of a pattern that votes.
PATTERN_ODDS = 3.0
#: Terms are chosen until each toxic document holds so many.
COVER = 4
#: Agreement beyond the classes from which on two voters are correlated.
CORRELATED = 0.3
#: Letters of a word's beginning.
STEMS = (3, 4, 5, 6, 7, 8)
#: Penalty of the classifier's weights.
RIDGE = 2e-3
#: Words beyond the lexicon that the classifier reads; in how many texts of the sample each stands at least.
WIDER, WIDER_TEXTS = 96, 24
#: So many words for each hit say clean.
SPARSE = 150
#: Share of toxic documents where the sample doesn't tell.
PRIOR = 0.05
WORD = re.compile(r"\w+")
#: Patterns that vote, whatever words they hold: second-person frames, repeated punctuation, spelled-out words, masked words.
PATTERNS = (
    re.compile(r"\b(?:you|u)(?:['\u2019]re|\s+(?:are|r))?\s+(?:(?:all|just|really|so|such|nothing\s+but)\s+){0,4}an?\b|\b(?:shut\s+up|get\s+lost|go\s+to\s+hell)\b", re.I),
    re.compile(r"[!?]{3,}"),
    re.compile(r"(?<!\w)[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?!\w)"),
    re.compile(r"(?<!\w)[^\W\d_]+[*#$]+[^\W\d_]+(?!\w)|(?<!\w)[^\W\d_][*#$]{2,}"),
)
#: Words for the reader.
SECOND = frozenset(("you", "your", "yours", "yourself", "youre", "u", "ur"))
#: Words that the first pattern begins with.
FRAMES = frozenset(("you", "u", "shut", "get", "go"))
#: Words whose terms a worker remembers.
REMEMBERED = 200_000


def terms_of(word: str) -> list[str]:
    """A lower-case word, and its beginnings marked with a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def without_copies(texts: list[str]) -> list[int]:
    """The places of texts that don't share their least word hashes with an earlier one: copies and most near copies go, which would pass for evidence."""
    seen: set[tuple[int, ...]] = set()
    kept = []
    for i, t in enumerate(texts):
        h = sorted(map(xxhash.xxh3_64_intdigest, set(WORD.findall(t.lower()))))[:6]
        keys = {tuple(h[:3]), tuple(h[3:])} if len(h) == 6 else {tuple(h)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


class Terms:
    """Counts of terms in texts, by a dictionary of words met before."""

    def __init__(self, terms: list[str]) -> None:
        self.at = {t: i for i, t in enumerate(terms)}
        self._lengths = sorted({len(t) - 1 for t in terms if t.endswith("*")})
        self._known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        at = self.at
        own = [at[word]] if word in at else []
        own += [at[t] for n in self._lengths if len(word) > n and (t := word[:n] + "*") in at]
        return tuple(own)

    def counts(self, words: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        for w, n in words.items():
            got = self._known.get(w)
            if got is None:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                got = self._known[w] = self.of(w)
            for i in got:
                out[i] = out.get(i, 0) + n
        return out


def _evidence(k: int, c: int, n: list[int], share: float) -> tuple[float, float]:
    """Odds ratio of toxic documents among holders, and minus the logarithm of the chance (Chernoff's bound) that k of k + c holders are toxic."""
    odds = (k + 0.5) / (n[1] + 1) / ((c + 0.5) / (n[0] + 1))
    x = k / max(1, k + c)
    luck = (k + c) * (x * np.log(x / share) + ((1 - x) * np.log((1 - x) / (1 - share)) if c else 0.0)) if x > share else 0.0
    return odds, luck


def mine_lexicon(texts: list[str], labels: np.ndarray) -> list[tuple[str, int]]:
    """(term, hits) much commoner in toxic documents, and not by luck: a text holds the term that often or more. Chosen greedily by evidence for documents that hold fewer than COVER chosen ones."""
    kept = without_copies(texts)
    texts, labels = [texts[i] for i in kept], labels[kept]
    n = [int((labels == 0).sum()), int((labels == 1).sum())]
    if not all(n):
        return []
    share = n[1] / sum(n)
    words = [Counter(WORD.findall(t.lower())) for t in texts]
    toxic = Counter(t for w, y in zip(words, labels, strict=True) if y == 1 for t in {t for x in w for t in terms_of(x)})
    certain = np.log(max(1, sum(k >= 3 for k in toxic.values())) / LUCK)
    found = Terms([t for t, k in toxic.items() if -k * np.log(share) >= certain])  # what a term of no clean document needs
    names = list(found.at)
    holders: list[dict[int, list[int]]] = [{}, {}]
    for i, w in enumerate(words):
        for t, k in found.counts(w).items():
            for least in (1, 2)[:k]:
                holders[least - 1].setdefault(t, []).append(i)
    worth: dict[tuple[str, int], float] = {}
    covers: dict[tuple[str, int], list[int]] = {}
    for least, held in enumerate(holders, 1):
        for t, docs in held.items():
            hit = [i for i in docs if labels[i] == 1]
            odds, luck = _evidence(len(hit), len(docs) - len(hit), n, share)
            if odds >= LEAST_ODDS and luck >= certain:
                worth[names[t], least], covers[names[t], least] = luck / max(1, len(hit)), hit
    covered: Counter = Counter()
    gain = [(-len(d) * worth[t], -len(t[0]), t) for t, d in covers.items()]  # of equal evidence the longest term, which fewest other words share
    heapq.heapify(gain)
    chosen: list[tuple[str, int]] = []
    while gain and len(chosen) < LEXICON:
        old, size, t = heapq.heappop(gain)
        new = sum(1 for i in covers[t] if covered[i] < COVER)
        if not new or any(_nested(t[0], c) for c, _ in chosen):
            continue
        if -new * worth[t] > old:
            heapq.heappush(gain, (-new * worth[t], size, t))
            continue
        chosen.append(t)
        covered.update(covers[t])
    return chosen


def _nested(a: str, b: str) -> bool:
    """Whether every word of one term is a word of the other: evidence counts once."""
    x, y = a.rstrip("*"), b.rstrip("*")
    return a == b or a.endswith("*") and y.startswith(x) or b.endswith("*") and x.startswith(y)


@dataclass
class ToxicityModel:
    """mined: (term, hits) beside SEEDS; patterns: which of shouting and PATTERNS vote; wider: words beyond the lexicon that the classifier reads."""

    mined: list[tuple[str, int]]
    patterns: tuple[int, ...] = tuple(range(1 + len(PATTERNS)))
    wider: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def __post_init__(self) -> None:
        self.lexicon = [*self.mined, *((w, 1) for w in SEEDS if not any(_nested(w, t) for t, _ in self.mined))]
        self._terms = Terms(list(dict.fromkeys(t for t, _ in self.lexicon)))
        self._wider = Terms(self.wider)
        self._known: dict[str, tuple | None] = {}
        self._least = np.array([k for _, k in self.lexicon])
        self._own = np.array([self._terms.at[t] for t, _ in self.lexicon])

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("mined", "patterns", "wider", "weights", "mean", "scale")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _learn(self, word: str) -> tuple | None:
        """What a word as it is written adds to a text: flags, its terms in the lexicon, its wider words; None if nothing."""
        low = word.lower()
        flags = (word.isupper(), word.isdigit(), low in SECOND, low in FRAMES, len(low) == 1)
        own, wide = self._terms.of(low), self._wider.of(low)
        about = (*flags, own, wide) if any(flags) or own or wide else None
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        self._known[word] = about
        return about

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of each term of the lexicon; (words, shouting, each pattern); the shares and wider words that only the classifier reads."""
        words = Counter(WORD.findall(text))
        hits, more = np.zeros(len(self._terms.at)), np.zeros(4 + len(self.wider))
        total = upper = digits = second = frames = letters = 0
        known = self._known
        for w, k in words.items():
            total += k
            about = known.get(w, 0)
            if about == 0:
                about = self._learn(w)
            if about is None:
                continue
            is_upper, is_digit, is_second, is_frame, is_letter, own, wide = about
            upper += k * is_upper
            digits += k * is_digit
            second += k * is_second
            frames += is_frame
            letters += k * is_letter
            for i in own:
                hits[i] += k
            for i in wide:
                more[4 + i] = 1
        hits = hits[self._own]
        n, marks = max(1, total), text.count("!") + text.count("?")
        # a pattern is only looked for where what it is made of is there
        may = (frames, marks >= 3, letters >= 4 or "_" in text, "*" in text or "#" in text or "$" in text)
        facts = np.array([total, upper > 0.5 * total, *(bool(m) and p.search(text) is not None for p, m in zip(PATTERNS, may, strict=True))], float)
        more[:4] = upper / n, marks / (marks + n), second / n, digits / n
        return hits, facts, more

    def votes(self, hits: np.ndarray, facts: np.ndarray) -> np.ndarray:
        """1: toxic, 0: clean, -1: no vote, for rows of hits and facts. Voters that never vote are left out; the last one says that hits are sparse. What has no hit at all shows in the rates of not voting."""
        held = hits >= self._least
        total = np.where(held, hits, 0).sum(axis=1)
        by_term = np.where(held, 1, -1)
        shown = facts[:, [1 + k for k in self.patterns]] > 0
        several = np.where(held.sum(axis=1) >= 2, 1, -1)
        clean = (total > 0) & (facts[:, 0] >= SPARSE * total)
        own = np.column_stack([by_term, np.where(shown, 1, -1), several])
        return np.column_stack([own[:, (own >= 0).any(axis=0)], np.where(clean, 0, -1)])

    def features(self, hits: np.ndarray, facts: np.ndarray, more: np.ndarray) -> np.ndarray:
        held = hits >= self._least
        total = np.where(held, hits, 0).sum(axis=1)
        words = np.maximum(1, facts[:, 0])
        kinds = held.sum(axis=1)
        whole = np.column_stack([np.log1p(total), np.log1p(kinds), np.log1p(100 * total / words), kinds >= 1, kinds >= 2, kinds >= 3, np.log(words)])
        return np.column_stack([held * np.log1p(hits), whole, facts[:, 1:], more])

    def read_all(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        rows = [self.read(t or "") for t in texts]
        widths = (len(self.lexicon), 2 + len(PATTERNS), 4 + len(self.wider))
        return tuple(np.array([r[k] for r in rows], float).reshape(len(rows), w) for k, w in enumerate(widths))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hits, facts, more = self.read_all(texts)
        if not len(self.weights):  # nothing was fitted: the share of toxic documents, and each hit on its own
            held = (hits >= self._least).sum(axis=1)
            return sigmoid(np.log(PRIOR / (1 - PRIOR)) + 2.5 * np.minimum(held, 3))
        x = (self.features(hits, facts, more) - self.mean) / self.scale
        return sigmoid(np.column_stack([x, np.ones(len(x))]) @ self.weights)


def company_of(votes: np.ndarray) -> np.ndarray:
    """How much of each pair's agreement their common class doesn't explain (diagonal 1).

    If the class alone made voters agree, the correlation of two would be the product of one number
    for each; triplets give its square as r(i,j) r(i,k) / r(j,k). The lower quartile over triplets is
    that of voters outside one's own company.
    """
    shown = np.where(votes == 1, 1.0, np.where(votes == 0, 0.0, 0.5))
    shown -= shown.mean(axis=0)
    shown /= shown.std(axis=0) + 1e-9
    r = shown.T @ shown / max(1, len(votes))
    m = len(r)
    strength = np.zeros(m)
    for i in range(m):
        others = np.delete(np.arange(m), i)
        if len(others) > 1:
            below = np.abs(r[np.ix_(others, others)])
            ratio = np.abs(np.outer(r[i, others], r[i, others])) / np.maximum(below, 1e-3)
            strength[i] = min(1.0, float(np.sqrt(np.quantile(ratio[np.triu_indices(len(others), 1)], 0.25))))
    left = np.abs(r - np.outer(strength, strength) * np.sign(r))
    np.fill_diagonal(left, 1.0)
    return left


def label_model(votes: np.ndarray, rounds: int = 25, derived: int = 0, prior: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability of class 1, the voters' accuracies, and the voters' weights after their correlations.

    The last `derived` voters follow from others by rule; they keep their weight, and correlations
    are those of the rest. prior: the share of class 1, where it is known; else it is estimated too.
    """
    is_vote = np.stack([votes == 1, votes == 0, votes == -1]).astype(np.float64)  # 3, n, m
    company = company_of(votes[:, : votes.shape[1] - derived])
    weight = np.concatenate([1.0 / np.where(company > CORRELATED, company, 0.0).sum(axis=1), np.ones(derived)])
    lead = is_vote[0] @ weight - is_vote[1] @ weight
    q = np.where(lead > 0, 0.98, np.where(lead < 0, 0.02, 0.5 if prior is None else min(0.5, prior)))
    for _ in range(rounds):
        share = float(np.clip(q.mean() if prior is None else prior, 1e-3, 1 - 1e-3))
        rate = [np.stack([(w @ is_vote[v] + 0.1) / (w.sum() + 0.3) for v in range(3)]) for w in (1 - q, q)]  # 3, m for each class
        logs = np.log(rate[1]) - np.log(rate[0])
        q = sigmoid(np.log(share / (1 - share)) + sum(is_vote[v] @ (weight * logs[v]) for v in range(3)))
    cast = np.maximum(1e-9, (votes >= 0).sum(axis=0))
    right = ((votes == 1) * q[:, None] + (votes == 0) * (1 - q[:, None])).sum(axis=0) / cast
    return q, right, weight


def wider_words(texts: list[str], q: np.ndarray, lexicon: list[tuple[str, int]]) -> list[str]:
    """The words of no term of the lexicon whose presence goes most with the posterior labels, either way."""
    words = [set(WORD.findall(t.lower())) for t in texts]
    held: Counter = Counter()
    mass: Counter = Counter()
    for w, x in zip(words, q, strict=True):
        for t in w:
            held[t] += 1
            mass[t] += float(x)
    base = float(q.mean())
    own = {t for t, _ in lexicon}
    score = {t: abs(mass[t] - k * base) / np.sqrt(k * base * (1 - base) + 1e-9) for t, k in held.items() if WIDER_TEXTS <= k <= len(texts) - WIDER_TEXTS and not any(x in own for x in terms_of(t))}
    return sorted(sorted(score, key=lambda t: (-score[t], t))[:WIDER])


def fit_toxicity(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """The labels choose the mined terms and the patterns that vote, and vote themselves; the classifier's targets are the label model's posteriors."""
    model = ToxicityModel(mine_lexicon(texts, labels))
    if not texts or not 0 < labels.sum() < len(labels):
        return model
    hits, facts, _ = model.read_all(texts)
    n = [int((labels == 0).sum()), int((labels == 1).sum())]
    shown = [(int(x[labels == 1].sum()), int(x[labels == 0].sum())) for x in facts[:, 1:].T]
    model.patterns = tuple(k for k, (t, c) in enumerate(shown) if (e := _evidence(t, c, n, n[1] / sum(n)))[0] >= PATTERN_ODDS and e[1] >= np.log(len(shown) / LUCK))
    if not (hits >= model._least).any():
        return model
    given = np.where(labels > 0, 1, 0)[:, None]
    q, _, _ = label_model(np.column_stack([model.votes(hits, facts), given]), derived=2, prior=float(labels.mean()))
    model.wider = wider_words(texts, q, model.lexicon)
    model.__post_init__()
    x = model.features(*model.read_all(texts))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.mean) / model.scale
    model.weights = fit_logistic(x, q, ridge=RIDGE)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of being toxic), predicted.

    Fitted on a bounded sample of labelled rows outside the held-out fold (see labelled.py for the
    bound); every whole text is scored. A null text counts as empty: no term, so it is clean.
    Repeated rows are scored each and equal texts equally; a null id counts as held out. Where the
    labels are of one class, or no term stands in the sample, the score is a low prior raised by each
    hit of the common insults. Other columns don't matter; an empty table gives an empty result.
    """
    model = fit_toxicity(*labelled_sample(docs, labels, LABEL, FOLDS, HELD_OUT))
    return score_documents(docs, model, FOLDS, HELD_OUT)
