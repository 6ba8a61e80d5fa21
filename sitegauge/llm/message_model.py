"""What a line says, as learned from example lines: a softmax model over words, word pairs and character n-grams.

A line's features are averaged over its words, so a phrase within a long sentence weighs little and a line
made of it weighs much. The model is trained here on the examples of ``message_seeds`` and on a bounded
sample of the corpus's own lines as ordinary ones. Messages and filler are among these, so in a first fit the
sample weighs little, and lines that it calls something else are left out of the second.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np

from sitegauge.llm.message_seeds import CLASSES, seeds

#: Size of the feature table (a power of two), steps of a fit, weight decay.
SIZE, STEPS, DECAY = 1 << 16, 60, 2e-5
#: Sharpness: averaged features are small, so they are scaled up.
GAIN = 4.0
#: Odds from which a sample line is taken for something else than ordinary.
SURE = 1.0
#: Weight of all sample lines together, in terms of the examples of one class, in each fit; fewer lines than
#: LEAST weigh as if they were that many.
SAMPLE_WEIGHTS, LEAST = (0.1, 1.5), 1500


def _code(name: str) -> int:
    return zlib.crc32(name.encode()) & (SIZE - 1)


def _word_features(word: str, known: frozenset[str]) -> list[tuple[int, float]]:
    """The word, or that it is new, and its character n-grams."""
    edge = f"^{word}$"
    grams = [edge[i : i + 4] for i in range(max(1, len(edge) - 3))]
    return [(_code(f"w:{word}" if word in known else "new"), 1.0), *((_code(f"g:{g}"), 1.0 / len(grams)) for g in grams)]


def _shape(tokens: tuple[str, ...]) -> list[str]:
    """Names for how a line repeats itself."""
    n = len(tokens)
    if n < 6:
        return []
    distinct = len(set(tokens))
    out = [f"d:{4 * distinct // n}"]
    if 3 * distinct <= 2 * n and any(tokens[p:] == tokens[:-p] for p in range(1, n // 3 + 1)):
        out.append("period")
    return out


def _pairs(words: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Codes of neighbouring words, from the words' own codes; ``inside`` tells which neighbours share a line."""
    mixed = (words[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + words[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return (mixed[inside] % np.uint64(SIZE)).astype(np.int64)


class MessageModel:
    """Weights, with the scores of words met remembered in each worker."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, known: frozenset[str]) -> None:
        self.weights, self.bias, self.known = weights, bias, known
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.codes = np.zeros(1024, np.int64)
        self.scores = np.zeros((1024, len(CLASSES)), np.float32)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray, frozenset[str]]:
        return self.weights, self.bias, self.known

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray, frozenset[str]]) -> None:
        self.weights, self.bias, self.known = state
        self._forget()

    def _number(self, word: str) -> int:
        self.words[word] = n = len(self.words)
        if n == len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.codes[n] = _code(word)
        for i, x in _word_features(word, self.known):
            self.scores[n] += self.weights[i] * np.float32(x)
        return n

    def odds(self, lines: list[tuple[str, ...]]) -> np.ndarray:
        """Log odds of each class against ordinary (itself 0), a row for each line; no line is empty."""
        if len(self.words) > 400_000:
            self._forget()
        if not lines:
            return np.zeros((0, len(CLASSES)), np.float32)
        get = self.words.get
        n = np.array([len(t) for t in lines])
        ids = np.array([k if (k := get(w)) is not None else self._number(w) for t in lines for w in t])
        first = np.cumsum(n) - n
        total = np.add.reduceat(self.scores[ids], first, axis=0)
        owner = np.repeat(np.arange(len(lines)), n)
        inside = owner[:-1] == owner[1:]
        if inside.any():
            # rows of pairs lie in the order of lines; those of one word have none
            many = n > 1
            pairs = self.weights[_pairs(self.codes[ids], inside)]
            total[many] += np.add.reduceat(pairs, (np.cumsum(n - 1) - (n - 1))[many], axis=0)
        z = self.bias + GAIN * total / n[:, None]
        for k, t in enumerate(lines):
            for name in _shape(t):
                z[k] += self.weights[_code(name)]
        return z - z[:, :1]


def _matrix(lines: list[tuple[str, ...]], known: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols, values = [], [], []
    words: dict[str, list[tuple[int, float]]] = {}
    for r, tokens in enumerate(lines):
        unit = GAIN / max(1, len(tokens))
        for w in tokens:
            if w not in words:
                words[w] = _word_features(w, known)
            for i, x in words[w]:
                rows.append(r), cols.append(i), values.append(unit * x)
        codes = np.array([_code(w) for w in tokens])
        for c in _pairs(codes, np.ones(len(codes) - 1, bool)):
            rows.append(r), cols.append(int(c)), values.append(unit)
        for name in _shape(tokens):
            rows.append(r), cols.append(_code(name)), values.append(1.0)
    return np.array(rows), np.array(cols), np.array(values)


def _fit(lines: list[tuple[str, ...]], known: frozenset[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient steps of adapted length on all lines at once."""
    rows, cols, values = _matrix(lines, known)
    used, cols = np.unique(cols, return_inverse=True)
    order = np.argsort(cols, kind="stable")
    by_line, by_feature = np.searchsorted(rows, np.arange(len(lines))), np.searchsorted(cols[order], np.arange(len(used)))
    unit = values.astype(np.float32)[:, None]
    k = len(CLASSES)
    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    g_w, g_b = np.full(w.shape, 1e-8, np.float32), np.full(k, 1e-8, np.float32)
    target, weight = np.eye(k, dtype=np.float32)[y], weight.astype(np.float32)[:, None]
    rows, unit_too = rows[order], unit[order]
    for _ in range(STEPS):
        z = np.add.reduceat(w[cols] * unit, by_line, axis=0) + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        diff = (target - p) * weight
        grad = np.add.reduceat(diff[rows] * unit_too, by_feature, axis=0) - np.float32(DECAY) * w
        g_w += grad**2
        g_b += diff.sum(0) ** 2
        w += np.float32(0.25) * grad / np.sqrt(g_w)
        b += np.float32(0.25) * diff.sum(0) / np.sqrt(g_b)
    full = np.zeros((SIZE, k), np.float32)
    full[used] = w
    return full, b


def train(sample: Iterable[tuple[str, ...]]) -> MessageModel:
    """Fit the model to the examples and a sample of the corpus's lines.

    Words that the sample has in one line only (mostly names) stand for all words never met: new.
    """
    told = [(CLASSES.index(c), tuple(line.split())) for c, line in seeds()]
    own = sorted(set(sample))
    uses = Counter(w for t in own for w in set(t))
    known = frozenset(w for _, t in told for w in t) | {w for w, n in uses.items() if n > 1}
    for total in SAMPLE_WEIGHTS:
        lines = [t for _, t in told] + own
        y = np.array([c for c, _ in told] + [0] * len(own))
        size = np.bincount(y[: len(told)], minlength=len(CLASSES))
        weight = np.concatenate([1 / size[y[: len(told)]], np.full(len(own), total / max(LEAST, len(own)))]) / len(CLASSES)
        weights, bias = _fit(lines, known, y, weight)
        model = MessageModel(weights, bias, known)
        own = [t for t, o in zip(own, model.odds(own), strict=True) if o.max() < SURE]
    return model
