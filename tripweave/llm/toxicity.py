"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities: of lexicon words, of lexicon words near a word of
the second person, of words that match the lexicon only once obfuscation is
undone, of capitals and of punctuation. The lexicon is a short
list of insults and what is learned: word stems
(whole words and prefixes) whose document counts differ between the labels far
beyond chance. Lexicon, trees and calibration are cross-fitted on a bounded
sample of labelled rows; the fitted model is a few KB and scores every document
in one pass without a shuffle.

Defined results: null text is the empty text, which gets a score as any other;
repeated rows get equal scores; an empty table gives an empty result; if the
sample lacks one of the labels, each score is the share of label 1 in it (0.0
without rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_rows

#: Labelled documents that everything is fitted on, at most.
TRAIN_ROWS = 12_000
#: Score from which a document is predicted toxic.
CUT = 0.7
#: Insults that the lexicon has before anything is learned, and their log odds.
SEED = frozenset("idiot moron stupid trash worthless disgusting pathetic scum clown loser dumb fool jerk imbecile garbage filth".split())
SEED_ODDS = 3.0
#: Words of the second person in the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir ihr euch dein deine usted ustedes vosotros tus".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!|*#%&", "oieastasii    ".replace(" ", "\u0000"))
#: Lengths of the prefixes that may become stems.
STEM = (5, 6, 7, 8)
LEAST_DOCS, LEAST_Z = 6, 4.0

_TOKEN = re.compile(r"[^\W_]+(?:[@$!|*#%&0-9]+[^\W_]+)*")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCT = re.compile(r"[!?.,;:]")
_MIXED = re.compile(r"[@$!|*#%&0-9]")
FEATURES = (
    "lexicon", "lexicon_any", "lexicon_log", "lexicon_weight", "distinct_lexicon", "near_second_person", "second_person",
    "obfuscated_lexicon", "obfuscated", "capitals", "exclamations", "punctuation", "log_words", "largest_line_density",
)


def stems(word: str) -> list[str]:
    """The keys under which a word is looked up: the whole word, and its prefixes with a star."""
    return [word, *(word[:n] + "*" for n in STEM if len(word) > n)]


def learn_lexicon(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Stem -> log odds, for the stems that label 1 has in clearly more documents.

    A stem needs LEAST_DOCS documents of label 1 and a z of LEAST_Z of its log
    odds ratio (counts plus one half) between the labels."""
    with_1, with_0 = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        found = {s for w in set(_TOKEN.findall(text.lower())) for s in stems(w)}
        (with_1 if label else with_0).update(found)
    n1 = sum(map(bool, labels))
    n0 = len(labels) - n1
    out = dict.fromkeys(SEED, SEED_ODDS)
    for stem, a in with_1.items():
        if a >= LEAST_DOCS:
            b = with_0[stem]
            odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
            spread = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
            if odds / spread >= LEAST_Z:
                out[stem] = odds
    return out


class Features:
    """Dense features of a text under a lexicon; looks each distinct word up once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def word(self, w: str) -> tuple[float, bool]:
        """(log odds of the word, 0 outside the lexicon; whether that took undoing obfuscation)."""
        if (found := self.known.get(w)) is None:
            weight, undone = max((self.lexicon.get(s, 0.0) for s in stems(w)), default=0.0), False
            if not weight and _MIXED.search(w):
                plain = w.translate(LEET).replace("\u0000", "")
                weight = max((self.lexicon.get(s, 0.0) for s in stems(plain)), default=0.0)
                undone = weight > 0
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[w] = (weight, undone)
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        n = max(1, len(tokens))
        hits, near, undone, weight, distinct = 0, 0, 0, 0.0, set()
        at = []
        word = self.word
        for i, w in enumerate(tokens):
            odds, hidden = word(w)
            if odds:
                hits += 1
                undone += hidden
                weight += odds
                distinct.add(w)
                at.append(i)
        second = [i for i, w in enumerate(tokens) if w in SECOND_PERSON]
        if at and second:
            near = sum(1 for i in at if any(w in SECOND_PERSON for w in tokens[max(0, i - 4) : i + 5]))
        best = 0.0
        if at:
            start = 0
            for end, i in enumerate(at):  # the most hits in any 50 words
                while i - at[start] >= 50:
                    start += 1
                best = max(best, (end - start + 1) / min(50, n))
        mixed = sum(1 for w in tokens if _MIXED.search(w) and not w.isdigit()) if _MIXED.search(text) else 0
        chars = max(1, len(text))
        return [
            hits / n, float(hits > 0), math.log1p(hits), weight / n, math.log1p(len(distinct)), near / n, len(second) / n,
            undone / n, mixed / n, len(_CAPITAL.findall(text)) / chars, text.count("!") / n, len(_PUNCT.findall(text)) / chars,
            math.log1p(len(tokens)), best,
        ]


class Boosted:
    """Trees grown on binned features with the gradients of the logistic loss."""

    def __init__(self, bias: float, trees: list):
        self.bias, self.trees = bias, trees

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: float = 5.0, ridge: float = 1.0, bins: int = 64) -> "Boosted":
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])  # <= edge goes left
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        model = Boosted(float(math.log(p / (1 - p))), [])
        raw = np.full(len(y), model.bias)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, q * (1 - q)
            tree: list = []
            model._grow(tree, coded, edges, g, h, np.arange(len(y)), depth, least, ridge, rate, raw)
            model.trees.append(tree)
        return model

    def _grow(self, tree, coded, edges, g, h, rows, depth, least, ridge, rate, raw) -> int:
        """Append the node of `rows` (and all below it) to `tree`; its number."""
        me = len(tree)
        tree.append(None)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, -1)
        if depth and len(rows) >= 2 * least:
            whole = sum_g**2 / (sum_h + ridge)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = coded[f, rows]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            value = float(-rate * sum_g / (sum_h + ridge))
            raw[rows] += value
            tree[me] = (-1, value, 0, 0)
            return me
        _, f, k = best
        left = coded[f, rows] <= k
        a = self._grow(tree, coded, edges, g, h, rows[left], depth - 1, least, ridge, rate, raw)
        b = self._grow(tree, coded, edges, g, h, rows[~left], depth - 1, least, ridge, rate, raw)
        tree[me] = (f, float(edges[f][k]), a, b)
        return me

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                f, value, a, b = tree[node]
                if f < 0:
                    out[rows] += value
                elif len(rows):
                    left = x[rows, f] <= value
                    stack += [(a, rows[left]), (b, rows[~left])]
        return out


class Isotonic:
    """Non-decreasing map of raw scores to shares of label 1 (pool adjacent violators)."""

    def __init__(self, at: np.ndarray, value: np.ndarray):
        self.at, self.value = at, value

    @staticmethod
    def fit(raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, sum of raw scores
        for r, label in zip(raw[order], y[order], strict=True):
            pools.append([float(label), 1.0, float(r)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
        return Isotonic(np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools]))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value)


class ToxicityModel:
    def __init__(self, features: Features, trees: Boosted | None, scale: Isotonic | None, share: float):
        self.features, self.trees, self.scale, self.share = features, trees, scale, share

    @staticmethod
    def fit(sample: list[tuple[str, int]], folds: int = 4) -> "ToxicityModel":
        """Cross-fitted: a row's densities come from a lexicon learned without its fold, and the
        calibration from scores of trees grown without it; the final lexicon and trees see all rows."""
        y = np.array([label for _, label in sample], float)
        share = float(y.mean()) if len(y) else 0.0
        if min(y.sum(), len(y) - y.sum()) < 2 * folds:
            return ToxicityModel(Features({}), None, None, share)
        fold = np.zeros(len(y), int)
        for label in (0, 1):
            rows = np.flatnonzero(y == label)
            fold[rows] = np.arange(len(rows)) % folds
        texts = [t for t, _ in sample]
        x = np.zeros((len(y), len(FEATURES)))
        for k in range(folds):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            features = Features(learn_lexicon([texts[i] for i in rest], [int(y[i]) for i in rest]))
            x[own] = [features(texts[i]) for i in own]
        raw = np.zeros(len(y))
        for k in range(folds):
            raw[fold == k] = Boosted.fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        return ToxicityModel(Features(learn_lexicon(texts, y.astype(int).tolist())), Boosted.fit(x, y), Isotonic.fit(raw, y), share)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([self.features(t) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(self.scale(self.trees.raw(x)), 0.0, 1.0)


def held_out(id_col) -> F.Column:
    """True for the third of the ids that nothing is learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> ToxicityModel:
    """The model fitted on at most `rows` labelled documents that are not held out."""
    return ToxicityModel.fit(labelled_sample(docs, labels.where(~held_out(F.col(id_col))), "toxic", rows, id_col))


def score(docs: DataFrame, model: ToxicityModel, cut: float = CUT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, held_out, score and predicted, a row for each document."""

    def work(ids, out, texts):
        s = model.score(texts)
        return ids, out, s.tolist(), (s >= cut).astype(int).tolist()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text))
    return map_rows(rows, work, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
