"""Weights of words in their context, learned from readers' judgements of whole documents.

A clause (a sentence or line) is read as words; to a word of the lexicon its
category is added. Features are words and ordered pairs of words a few places
apart. Readers judge documents, so which clause of a condemned document was
meant is unknown: at first it is the one with the most unusual features, then
the one that a model of the *other* documents scores highest. A condemned
document in which that model sees nothing is taken as a reader's error and
dropped. What is left, against all clean clauses that hold a cue, trains a
logistic regression with a penalty on its weights.

Nothing here knows a wording of its own: without judgements there is no model.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import regex

#: Words between which a pair may span; words of a longer clause are read in windows of so many, overlapping by half.
REACH, CLAUSE_WORDS = 4, 64
#: A feature is used from so many groups of condemned documents on (and one in so many of them), and a cue where it is so many times (as a logarithm) as frequent in them.
LEAST_DOCUMENTS, SHARE_OF_DOCUMENTS, LEAST_CUE = 2, 400, 1.0
#: Parts in which documents are judged by a model of the others.
FOLDS = 3
STEPS, RATE, PENALTY = 80, 0.5, 0.05
#: The share of condemned documents, those of the least unusual clauses, that the first model does without.
UNSURE_SHARE = 0.3
#: Log-odds under which a condemned document is taken as an error.
NOTHING_SEEN = -1.5
QUOTED = "<quote>"
_MARKS = frozenset({'"', "“", "”", "„", "«", "»", "''"})
NO_SPACES = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")

Feature = str | tuple[str, str]


def read_words(tokens: Iterable[str]) -> list[str]:
    """Words and quotation marks of a clause; scripts without spaces are read letter by letter."""
    out: list[str] = []
    for t in tokens:
        if t in _MARKS:
            out.append(QUOTED)
        elif t.isascii():
            if any(c.isalnum() for c in t):
                out.append(t)
        elif NO_SPACES.search(t):
            out.extend(c for c in t if c.isalnum())
        elif any(c.isalnum() for c in t):
            out.append(t)
    return out


def windows(words: list[str]) -> list[tuple[str, ...]]:
    """A clause as windows of bounded length; a pair within reach is in one of them."""
    if len(words) <= CLAUSE_WORDS:
        return [tuple(words)]
    half = CLAUSE_WORDS // 2
    return [tuple(words[i : i + CLAUSE_WORDS]) for i in range(0, len(words) - half, half)]


def features(words: Iterable[str], categories: dict[str, tuple[str, ...]]) -> set[Feature]:
    """Words and their categories, and ordered pairs of them up to ``REACH`` places apart; a quotation also pairs with every category."""
    seen: set[Feature] = set()
    before: list[tuple[str, ...]] = []
    quoted, kinds = False, set()
    for w in words:
        if w == QUOTED:
            quoted = True
            continue
        if w.isdigit():
            before.append(())
            continue
        own = (w,)
        if w in categories:
            own += categories[w]
            kinds.update(own[1:])
        seen.update(own)
        for other in before[-REACH:]:
            for a in other:
                for b in own:
                    seen.add((a, b))
        before.append(own)
    if quoted:
        seen.add(QUOTED)
        seen.update((QUOTED, k) for k in kinds)
    return seen


@dataclass
class Wording:
    """A fitted model: log-odds that a clause is abusive; one without a cue has none. ``anchors`` has of each cue the word, or category, that clean documents hold least. ``ordinary`` are words that clean documents hold again and again."""

    weights: dict[Feature, float] = field(default_factory=dict)
    cues: frozenset[Feature] = frozenset()
    anchors: frozenset[str] = frozenset()
    bias: float = 0.0
    ordinary: frozenset[str] = frozenset()
    n_condemned: int = 0

    def words(self) -> set[str]:
        """Words that a cue names."""
        return {w for f in self.cues for w in (f if isinstance(f, tuple) else (f,)) if not w.startswith(("<", "#"))}

    def log_odds(self, words: Iterable[str], categories: dict[str, tuple[str, ...]]) -> float:
        seen = features(words, categories)
        return -math.inf if self.cues.isdisjoint(seen) else self.bias + sum(self.weights.get(f, 0.0) for f in seen)


def _train(inst: list[list[int]], y: np.ndarray, weight: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, none over ``most``, and bias of a penalised logistic regression, by adaptive gradient steps over all instances."""
    rows = np.repeat(np.arange(len(inst)), [len(x) for x in inst])
    cols = np.concatenate([np.asarray(x, dtype=np.int64) for x in inst]) if inst else np.zeros(0, np.int64)
    n = len(most)
    w, b, g2, gb2 = np.zeros(n), -3.0, np.full(n, 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], len(inst)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(cols, e[rows], n) + PENALTY * w
        gb = e.sum()
        g2 += g * g
        gb2 += gb * gb
        w = np.minimum(w - RATE * g / np.sqrt(g2), most)
        b -= RATE * gb / math.sqrt(gb2)
    return w, b


def fit_wording(clauses: Iterable[tuple[tuple[str, ...], list[tuple[int, int]], int]], n_condemned: int, n_clean: int, categories: dict[str, tuple[str, ...]], near) -> Wording:
    """A model of (words, condemned documents that hold the clause as (group, document), number of clean documents that hold it).

    Documents of a group, such as revisions of a page, share names and topics: they count once, and are on one side when a model of others judges.
    ``near(words)`` gives a function that finds, for a word, the one of ``words`` that it
    may be a misspelling of, else None. Without condemned documents the model is empty.
    """
    held, clean = {}, Counter()
    for words, docs, n in clauses:
        if docs:
            held[words] = docs
        if n:
            clean[words] += n
    if not held or not n_clean:
        return Wording(n_condemned=n_condemned)
    meant = {s: docs for s, docs in held.items() if 2 * (clean[s] + 0.5) / (n_clean + 1) < len(docs) / (n_condemned + 1)}
    own = {s: features(s, categories) for s in meant}
    by_doc: dict[tuple[int, int], list[tuple[str, ...]]] = defaultdict(list)
    for s, docs in meant.items():
        for d in docs:
            by_doc[d].append(s)
    by_group: dict[int, list[tuple[str, ...]]] = defaultdict(list)
    for (g, _), parts in by_doc.items():
        by_group[g].extend(parts)
    n_groups = len(by_group)

    least = max(LEAST_DOCUMENTS, round(n_groups / SHARE_OF_DOCUMENTS))

    def frequencies() -> tuple[Counter, Counter]:
        in_condemned: Counter = Counter()
        for parts in by_group.values():
            in_condemned.update(set().union(*(own[s] for s in parts)))
        keep = {f for f, n in in_condemned.items() if n >= least}
        in_clean: Counter = Counter()
        for s, n in clean.items():
            for f in features(s, categories):
                if f in keep:
                    in_clean[f] += n
        return Counter({f: in_condemned[f] for f in keep}), in_clean

    in_condemned, in_clean = frequencies()
    odds = lambda f: math.log((in_condemned[f] + 0.5) / (n_groups + 1)) - math.log((in_clean[f] + 0.5) / (n_clean + 1))
    cues = {f: x for f in in_condemned if (x := odds(f)) > LEAST_CUE}
    # words near a cue word that clean documents hardly know are misspellings of it
    known: Counter = Counter()
    for s, n in clean.items():
        for w in set(s):
            known[w] += n
    cue_words = {w for f in cues for w in (f if isinstance(f, tuple) else (f,))}
    slips = near({w for w in cue_words if known[w] or in_condemned[w] >= 2 * least} | set(categories))
    common = max(2, n_clean // 2000)
    mended: dict[str, str] = {}
    for s in meant:
        for w in s:
            if w not in mended:
                mended[w] = w if w in categories or known[w] > common or (w in cue_words and in_condemned[w] >= 2 * least) else slips(w) or w
    own = {s: features([mended[w] for w in s], categories) for s in meant}
    in_condemned, in_clean = frequencies()
    cues = {f: x for f in in_condemned if (x := odds(f)) > LEAST_CUE and f != QUOTED}
    # clean clauses with a cue are what the model must tell apart; their words may speak against abuse
    cue_set = set(cues)
    hard = {s: fs for s in clean if not (fs := features(s, categories)).isdisjoint(cue_set)}
    against = Counter(f for s, fs in hard.items() for f in fs if isinstance(f, str) or f[0] == QUOTED or f[0].startswith("#") or f[1].startswith("#"))
    use = sorted(set(cues) | {f for f, n in against.items() if n >= 3}, key=str)
    index = {f: i for i, f in enumerate(use)}
    most = np.array([np.inf if f in cue_set else 0.0 for f in use])
    ids = lambda fs: [index[f] for f in fs if f in index]
    negative = list(hard)
    neg_ids = [ids(hard[s]) for s in negative]
    neg_weight = np.sqrt(np.array([clean[s] for s in negative], dtype=np.float64))
    neg_fold = np.array([sum(map(len, s)) % FOLDS for s in negative], dtype=np.int64)
    pos_ids = {s: ids(fs) for s, fs in own.items()}
    docs = sorted(by_doc)
    group_fold = {g: i % FOLDS for i, g in enumerate(sorted(by_group))}
    doc_fold = {d: group_fold[d[0]] for d in docs}
    first = {s: sum(sorted((cues[f] for f in fs if f in cues), reverse=True)[:8]) for s, fs in own.items()}
    chosen = {d: max(by_doc[d], key=lambda s: (first[s], s)) for d in docs}
    floor = np.quantile([first[s] for s in chosen.values()], UNSURE_SHARE)
    chosen = {d: s for d, s in chosen.items() if first[s] >= floor}

    def model(skip: int | None) -> tuple[np.ndarray, float]:
        positive = [pos_ids[s] for d, s in chosen.items() if doc_fold[d] != skip]
        at = np.flatnonzero(neg_fold != (-1 if skip is None else skip))
        y = np.r_[np.ones(len(positive)), np.zeros(len(at))]
        return _train([*positive, *(neg_ids[i] for i in at)], y, np.r_[np.ones(len(positive)), neg_weight[at]], most)

    for _ in range(2):
        kept: dict[int, tuple[str, ...]] = {}
        for k in range(FOLDS):
            w, b = model(k)
            for d in (d for d in docs if doc_fold[d] == k):
                score, s = max((b + w[pos_ids[s]].sum(), s) for s in by_doc[d])
                if score > NOTHING_SEEN:
                    kept[d] = s
        chosen = kept
        if not chosen:
            return Wording(n_condemned=n_condemned)
    w, b = model(None)
    weights = {f: round(float(x), 4) for f, x in zip(use, w) if abs(x) > 0.02}
    for w, kinds in categories.items():
        for kind in kinds:
            known[kind] += known[w]
    speaking = frozenset(f for f in cue_set if weights.get(f, 0.0) > 0)
    anchors = frozenset(min(f, key=lambda w: (known[w], w)) if isinstance(f, tuple) else f for f in speaking)
    return Wording(weights, speaking, anchors, round(float(b), 4), frozenset(x for x, n in known.items() if n > common), n_condemned)
