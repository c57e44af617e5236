"""Quality rules: a linear-chain conditional random field over the lines of a text.

Each line with a word gets dense features; the field has the two states
boilerplate (0) and content (1), and Viterbi decoding labels the lines. The
share of the words that stand in content lines decides whether the document is
kept. The field is fitted on a bounded sample of labelled documents. A label says
on which side of CONTENT_SHARE the document is, not what each line is: the states
of the lines are latent. They start as the document's label; a field without
transitions is fitted to them, each document is decoded, lines move to the states
found, and where those contradict the label the least certain lines move back
until the share agrees. The chain is then fitted to these states, and once more
to those that it finds itself.

Defined results: null and blank texts have no words and fail the base rules;
repeated rows are judged alike; an empty table gives an empty result; without
labelled rows the base rules alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, labelled_sample, map_rows

#: Labelled documents that the field is fitted on, at most.
TRAIN_ROWS = 3000
#: A document is kept if this share of its words stands in content lines.
CONTENT_SHARE = 0.5
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_ENDS = (".", "!", "?", ":", ";", "…", '"')
FEATURES = (
    "bias", "symbols_per_word", "pipes_per_word", "capitals", "exclamations", "digits", "seen_before",
    "repeated_words", "distinct_words", "log_words", "word_length", "ends_sentence", "first", "last",
)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeated_positions(words: list[str]) -> np.ndarray:
    """True for each word that lies in a WINDOW-word window found twice or more in the text."""
    n = len(words)
    covered = np.zeros(n, bool)
    m = n - WINDOW + 1
    if m < 2:
        return covered
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = sum(h[k : k + m] * _MULT[k] for k in range(WINDOW))
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return covered  # unlike hashes: no window is found twice
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, m)
    for k in range(WINDOW):
        covered[k : k + m] |= hit
    return covered


def examine(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words per line)."""
    text = text or ""
    words: list[str] = []
    lines: list[tuple[str, int, int]] = []  # line, first word, words
    for line in text.split("\n"):
        if found := WORD.findall(line):
            lines.append((line, len(words), len(found)))
            words += found
    covered = repeated_positions(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = np.concatenate(([0], np.cumsum(covered)))
    chars = np.concatenate(([0], np.cumsum(lengths)))
    n_symbols = 0
    seen: set[str] = set()
    n_dup = 0
    rows, sizes = [], []
    for i, (line, first, n) in enumerate(lines):
        total = int(chars[first + n] - chars[first])
        symbols = len(_SYMBOL.findall(line))
        n_symbols += symbols
        again = line in seen
        n_dup += again
        seen.add(line)
        rows.append((
            1.0,
            min(3.0, symbols / n),
            min(1.0, line.count("|") / n),
            len(_CAPITAL.findall(line)) / total,
            min(2.0, line.count("!") / n),
            len(_DIGIT.findall(line)) / total,
            float(again),
            float(repeats[first + n] - repeats[first]) / n,
            len(set(words[first : first + n])) / n if n > 1 else 1.0,
            math.log1p(n) / 5.0,
            min(2.0, total / n / 10.0),
            float(line.rstrip().endswith(_ENDS)),
            float(i == 0),
            float(i == len(lines) - 1),
        ))
        sizes.append(n)
    base = (len(words), int(chars[-1]), n_symbols, n_dup, int(repeats[-1]))
    return base, np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


class LineField:
    """Linear-chain CRF with two states; the score of boilerplate is 0 in each line."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(len(FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    @staticmethod
    def fit(texts: list[np.ndarray], states: list[np.ndarray], chain: bool = True, steps: int = 100, rate: float = 0.1, ridge: float = 1e-3) -> "LineField":
        """Adam on the mean log-likelihood of the lines' states; documents of like length form one padded block. Without `chain` all transitions weigh 0."""
        blocks = []
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(texts):
            if len(x):
                by_size.setdefault(max(0, len(x) - 1).bit_length(), []).append(i)
        for members in by_size.values():
            most = max(len(texts[i]) for i in members)
            x = np.zeros((len(members), most, len(FEATURES)))
            there, y = np.zeros((len(members), most), bool), np.zeros((len(members), most), np.int8)
            for r, i in enumerate(members):
                x[r, : len(texts[i])] = texts[i]
                there[r, : len(texts[i])] = True
                y[r, : len(texts[i])] = states[i]
            blocks.append((x, there, y))
        field = LineField()
        total = sum(len(y) for _, _, y in blocks)
        if not total:
            return field
        size = len(FEATURES)
        at, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
        for step in range(1, steps + 1):
            g = -ridge * at
            for x, there, y in blocks:
                g += field._gradient(x, there, y) / total
            if not chain:
                g[size:] = 0.0
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            at = at + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            field = LineField(at[:size], at[size:].reshape(2, 2))
        return field

    def _gradient(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Observed minus expected counts, each document's divided by its number of lines."""
        docs, most, _ = x.shape
        share = 1.0 / there.sum(1)
        emit = np.zeros((docs, most, 2))
        emit[:, :, 1] = x @ self.weights
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, most):
            new = np.logaddexp(fwd[:, t - 1, 0, None] + self.moves[0], fwd[:, t - 1, 1, None] + self.moves[1]) + emit[:, t]
            fwd[:, t] = np.where(there[:, t, None], new, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            nxt = emit[:, t + 1] + bwd[:, t + 1]
            new = np.logaddexp(self.moves[:, 0] + nxt[:, 0, None], self.moves[:, 1] + nxt[:, 1, None])
            bwd[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * there
        diff = (y * there - p) * share[:, None]
        moves = np.zeros((2, 2))
        both = there[:, 1:]
        for a in range(2):
            for b in range(2):
                pair = np.exp(fwd[:, :-1, a] + self.moves[a, b] + emit[:, 1:, b] + bwd[:, 1:, b] - z[:, None]) * both
                seen = both * ((y[:, :-1] == a) & (y[:, 1:] == b))
                moves[a, b] = ((seen - pair) * share[:, None]).sum()
        return np.concatenate((np.einsum("dt,dtf->f", diff, x), moves.ravel()))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest state of each line; ties go to content."""
        n = len(x)
        if not n:
            return np.zeros(0, np.int8)
        emit = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = 0.0, emit[0]
        back0, back1 = bytearray(n), bytearray(n)
        for t in range(1, n):
            a, b = s0 + m00, s1 + m10
            c, d = s0 + m01, s1 + m11
            back0[t], s_next = (0, a) if a > b else (1, b)
            back1[t], s1 = (0, c + emit[t]) if c > d else (1, d + emit[t])
            s0 = s_next
        state = 0 if s0 > s1 else 1
        out = bytearray(n)
        for t in range(n - 1, -1, -1):
            out[t] = state
            state = back1[t] if state else back0[t]
        return np.frombuffer(bytes(out), np.int8)

    def content_share(self, x: np.ndarray, sizes: np.ndarray) -> float:
        """Share of the words that stand in content lines; 0.0 without words."""
        return float((self.decode(x) * sizes).sum() / sizes.sum()) if len(sizes) else 0.0


def latent_states(field: LineField, x: np.ndarray, sizes: np.ndarray, label: int, share: float = CONTENT_SHARE) -> np.ndarray:
    """The decoded states of a labelled document's lines; the least certain ones are changed until the share of content agrees with the label."""
    states = field.decode(x).copy()
    scores, held, total = x @ field.weights, int((states * sizes).sum()), int(sizes.sum())
    for k in np.argsort(-scores if label else scores, kind="stable"):
        if (held >= share * total) == bool(label):
            break
        if states[k] != label:
            states[k] = label
            held += int(sizes[k]) if label else -int(sizes[k])
    return states


def fit_field(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> LineField | None:
    """The field fitted on at most `rows` labelled documents; None if one label has no document."""
    sample = labelled_sample(docs, labels, "quality", rows)
    examined = [(x, sizes, q) for (_, x, sizes), q in ((examine(t), q) for t, q in sample) if len(x)]
    if len({q for *_, q in examined}) < 2:
        return None
    texts = [x for x, _, _ in examined]
    field = LineField.fit(texts, [np.full(len(x), q, np.int8) for x, _, q in examined], chain=False)
    for _ in range(2):
        field = LineField.fit(texts, [latent_states(field, *doc) for doc in examined])
    return field


def judge(docs: DataFrame, field: LineField | None, share: float = CONTENT_SHARE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id_col`, the base counts, n_lines, content_share, base_failed and kept, a row for each document."""

    def work(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            base, x, sizes = examine(t)
            failed = base_fails(base[0], base[4])
            part = field.content_share(x, sizes) if field is not None else float(len(sizes) > 0)
            out.append((i, *base, len(sizes), part, failed, not failed and part >= share))
        return list(zip(*out, strict=True))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_share double, base_failed boolean, kept boolean"
    return map_rows(docs.select(F.col(id_col), F.col(text)), work, schema).withColumnRenamed("id", id_col)


def line_labels(docs: DataFrame, field: LineField, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line with a word: `id_col`, line (its number among those, from 0), text and content (boolean)."""

    def work(ids, texts):
        out = []
        for i, t in zip(ids, texts, strict=True):
            _, x, _ = examine(t)
            held = [line for line in (t or "").split("\n") if WORD.search(line)]
            out += [(i, k, line, bool(s)) for k, (line, s) in enumerate(zip(held, field.decode(x), strict=True))]
        return list(zip(*out, strict=True)) if out else None

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col), F.col(text)), work, f"id {kind}, line long, text string, content boolean").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, field: LineField | None, share: float = CONTENT_SHARE, text: str = "text") -> DataFrame:
    """The documents that judge() keeps, all columns as they were; a filter, without a shuffle."""

    @F.arrow_udf("boolean")
    def kept(texts):
        import pyarrow as pa

        out = []
        for t in texts.to_pylist():
            base, x, sizes = examine(t)
            part = field.content_share(x, sizes) if field is not None else float(len(sizes) > 0)
            out.append(not base_fails(base[0], base[4]) and part >= share)
        return pa.array(out, pa.bool_())

    return docs.where(kept(F.col(text)))
