"""Subject areas of documents by calibrated classifier chains.

From hand labels and the areas' descriptions a term table is learned: how much each word or word pair speaks for
each subject. It is widened by the company that terms keep in sentences of unlabelled texts, so few labels do. It
turns a document into features of three kinds: *terms* (mean evidence for each subject), *structure*
(share of sentences whose evidence points to each subject, and a ramp that tells a passing mention from
a treated subject, sentence count, share of lines that are lists, code or headings) and *source* (how far the labels of its source lean to each subject). A chain
of logistic models, one subject after another, sees these and the decisions before it, and so models
which subjects occur together. Scores are calibrated on held-out documents and corrected for wrong and
missing labels; a beam search decodes the likeliest combination, none being one of them.

The chain is fitted to at most ``TRAIN_DOCS`` labelled documents, terms are widened on at most ``MORE_DOCS`` others,
each those of the smallest hashed ids;
labels that name no subject after trimming and lower-casing are ignored. All documents are decoded.
Null, blank and unlabelled-language texts simply lack evidence and get no subject.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import words_of
from sitegauge.plans.staging import spread

#: Bounds and settings of the fit; beam width of decoding.
TRAIN_DOCS, MORE_DOCS, LEAST_DOCS, PURITY, EVIDENCE, BEAM = 12_000, 4_000, 3, 0.6, 0.8, 6
#: Rounds in which terms are widened by the company they keep, texts that tell of it, and the share that agrees.
ROUNDS, LEAST_TEXTS, COMPANY = 1, 3, 0.75
#: Labelled documents from which on labels alone decide about a word.
JUDGED = 10
#: Weight of a word of an area's description; how firmly a subject's weights are held to those all share.
PRIOR, RIDGE = 1.0, 100.0
#: Documents that usual label rates are mixed with, and the usual rate.
MIXED, USUAL = 20, 0.9
#: Shares up to RAMP are passing mentions, shares from twice RAMP on are treatment.
RAMP = 0.1
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|\n+")
_DIGIT = re.compile(r"\d")
_LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s", re.M)


def _sentences(text: str) -> list[list[str]]:
    return [w for x in _SENTENCE.split(text) if (w := words_of(x))]


def _terms(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Chain:
    subjects: list[str]
    terms: dict[str, tuple[int, float]] = field(default_factory=dict)
    #: First words of the terms that are pairs.
    heads: set[str] | None = None
    sources: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: list[np.ndarray] = field(default_factory=list)
    slope: np.ndarray | None = None
    shift: np.ndarray | None = None
    #: Label rates of documents without and with a subject, by subject.
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def features(self, text: str | None, source: str | None) -> np.ndarray:
        k = len(self.subjects)
        told, total = np.zeros(k), np.zeros(k)
        sentences = _sentences(text or "")
        get = self.terms.get
        if self.heads is None:
            self.heads = {t.split(" ")[0] for t in self.terms if " " in t}
        heads = self.heads
        for words in sentences:
            hits = [h for w in words if (h := get(w))]
            hits += [h for a, b in zip(words, words[1:], strict=False) if a in heads and (h := get(f"{a} {b}"))]
            if hits:
                mine = [0.0] * k
                for s, weight in hits:
                    mine[s] += weight
                total += mine
                if max(mine) > EVIDENCE:
                    told[mine.index(max(mine))] += 1
        n = max(1, len(sentences))
        lines = max(1, (text or "").count("\n") + 1)
        extra = [math.log1p(n), len(_LIST.findall(text or "")) / lines, (text or "").count("```") / lines, float((text or "").startswith("#"))]
        share = told / n
        return np.concatenate([share, np.clip(share / RAMP - 1, 0, 1), np.log1p(total / n), self.sources.get(source or "", np.zeros(k)), extra])

    def probabilities(self, x: np.ndarray, k: int, before: np.ndarray) -> np.ndarray:
        """Chance that subject ``k`` holds, for rows of features and the decisions before it."""
        z = np.concatenate([x, before, np.ones((len(x), 1))], 1) @ self.weights[k]
        p = 1 / (1 + np.exp(-np.clip(self.slope[k] * z + self.shift[k], -30, 30)))
        return np.clip((p - self.low[k]) / max(1e-6, self.high[k] - self.low[k]), 1e-4, 1 - 1e-4)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likeliest combinations (documents x subjects) and each subject's chance in them, by beam search."""
        n, k = len(x), len(self.subjects)
        if not n or not self.weights:
            return np.zeros((n, k), bool), np.zeros((n, k))
        x = (x - self.mean) / self.scale
        beams = [(np.zeros((n, 0)), np.zeros(n), np.zeros((n, 0)))]
        for s in range(k):
            new = []
            for y, score, p in beams:
                q = self.probabilities(x, s, y)
                for v, cost in ((0, np.log1p(-q)), (1, np.log(q))):
                    new.append((np.c_[y, np.full(n, v)], score + cost, np.c_[p, q]))
            order = np.argsort(-np.stack([b[1] for b in new], 1), axis=1, kind="stable")[:, :BEAM]
            pick = lambda part, j, new=new, order=order: np.stack([b[part] for b in new], 1)[np.arange(n), order[:, j]]
            beams = [(pick(0, j), pick(1, j), pick(2, j)) for j in range(order.shape[1])]
        return beams[0][0] > 0.5, beams[0][2]


class _Sample:
    """Terms of the sample's documents as (document, term) pairs, so that tables of parts are quick."""

    def __init__(self, docs: list[tuple[str | None, str | None, set[int]]], k: int) -> None:
        self.vocab: dict[str, int] = {}
        new = self.vocab
        rows = [np.fromiter({new.setdefault(t, len(new)) for t in _terms(words_of(text))}, np.int64) for text, _, _ in docs]
        self.term = np.concatenate(rows)
        self.doc = np.repeat(np.arange(len(docs)), [len(r) for r in rows])
        self.y = np.zeros((len(docs), k))
        for i, (_, _, labels) in enumerate(docs):
            self.y[i, list(labels)] = 1

    def terms(self, part: np.ndarray) -> dict[str, tuple[int, float]]:
        """term -> (subject, evidence) for terms whose labelled documents mostly share a subject."""
        on = part[self.doc]
        term, doc, size = self.term[on], self.doc[on], len(self.vocab)
        n = np.bincount(term, minlength=size)
        by = np.stack([np.bincount(term, self.y[doc, s], size) for s in range(self.y.shape[1])], 1)
        base = self.y[part].mean(0)
        rate = (by + 2 * base) / (n + 2)[:, None]
        best = rate.argmax(1)
        top = rate[np.arange(size), best]
        keep = (n >= LEAST_DOCS) & (top >= np.maximum(PURITY, (1 + base[best]) / 2))
        weight = top * np.log1p(n)
        return {t: (int(best[i]), float(weight[i])) for t, i in self.vocab.items() if keep[i] and not _DIGIT.search(t)}


    def judged(self, part: np.ndarray) -> set[str]:
        """Terms of enough labelled documents for labels alone to say what they speak for, if for anything."""
        n = np.bincount(self.term[part[self.doc]], minlength=len(self.vocab))
        return {t for t, i in self.vocab.items() if n[i] >= JUDGED}


def _source_table(docs: list[tuple[str | None, str | None, set[int]]], k: int) -> dict[str, np.ndarray]:
    count: Counter[str] = Counter()
    by: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for _, source, labels in docs:
        count[source or ""] += 1
        by[source or ""][list(labels)] += 1
    base = sum(by.values(), np.zeros(k)) / max(1, len(docs))
    return {s: (by[s] + 100 * base) / (n + 100) - base for s, n in count.items()}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, toward: np.ndarray | None = None, ridge_last: float = 1e-6) -> np.ndarray:
    """Logistic regression by Newton steps, its weights drawn ``toward`` given ones (zero); the last column is the intercept."""
    goal = np.zeros(x.shape[1]) if toward is None else toward
    w = goal.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge_last
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * (w - goal))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class _Sentences:
    """Words of the sentences of a sample of texts, labelled or not, and the texts they stand in."""

    def __init__(self, texts: list[str]) -> None:
        self.vocab: dict[str, int] = {}
        new = self.vocab
        rows, owner = [], []
        for d, text in enumerate(sorted(set(texts))):
            for words in _sentences(text):
                rows.append(np.fromiter({new.setdefault(w, len(new)) for w in words if not _DIGIT.search(w)}, np.int64))
                owner.append(d)
        self.term = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.sentence = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.text = np.array(owner, np.int64)[self.sentence] if rows else np.zeros(0, np.int64)
        self.rows = len(rows)

    def widened(self, terms: dict[str, tuple[int, float]], k: int, judged: set[str]) -> dict[str, tuple[int, float]]:
        """The table after one round of looking at the company that words keep.

        A sentence speaks for a subject by its known words. A new word that in nearly all texts occurs in sentences
        which speak for one subject takes that subject; known terms, and words that labels have ``judged``, stay as
        they are.
        """
        size = len(self.vocab)
        subject, weight = np.zeros(size, np.int64), np.zeros(size, np.float32)
        for t, (s, w) in terms.items():
            if (i := self.vocab.get(t)) is not None:
                subject[i], weight[i] = s, w
        told = np.bincount(self.sentence * k + subject[self.term], weight[self.term], self.rows * k).reshape(-1, k).astype(np.float32)
        seen: list[np.ndarray] = []
        for start in range(0, len(self.term), 500_000):
            cut = slice(start, start + 500_000)
            term = self.term[cut]
            rest = told[self.sentence[cut]]
            rest[np.arange(len(term)), subject[term]] -= weight[term]
            best = rest.argmax(1)
            sure = rest[np.arange(len(term)), best] > EVIDENCE
            seen.append(np.stack([term[sure], self.text[cut][sure], best[sure]], 1))
        # a text counts once for a word and subject, however often they meet in it
        hits = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 3), np.int64)
        by = np.bincount(hits[:, 0] * k + hits[:, 2], minlength=size * k).reshape(size, k)
        n = by.sum(1)
        best = by.argmax(1)
        pure = by[np.arange(size), best] / (n + 1)
        names = list(self.vocab)
        new = {names[i]: (int(best[i]), float(pure[i] * np.log1p(n[i]))) for i in np.flatnonzero((n >= LEAST_TEXTS) & (pure >= COMPANY)) if names[i] not in judged}
        return new | terms


def _prior(areas: list[tuple[str, str]], subjects: list[str]) -> dict[str, tuple[int, float]]:
    """Words of the areas' titles and scope notes that one area alone has, as terms of it."""
    owners: dict[str, set[str]] = defaultdict(set)
    for subject, text in areas:
        for w in words_of(text):
            if len(w) > 3:
                owners[w].add(subject)
    return {w: (subjects.index(next(iter(s))), PRIOR) for w, s in owners.items() if len(s) == 1}


def train(docs: list[tuple[str | None, str | None, set[int]]], subjects: list[str], areas: list[tuple[str, str]] = (), more: list[str] = ()) -> Chain:
    """Fit a chain to (text, source, indexes of the labelled subjects).

    ``areas`` are (subject, descriptive text), ``more`` other texts, unlabelled, from which terms are widened.
    """
    k, chain = len(subjects), Chain(subjects)
    if len(docs) < 2 or not k:
        return chain
    # features of each third come from terms learned on the rest, lest a document vouch for itself
    x = np.zeros((len(docs), 4 * k + 4))
    sample = _Sample(docs, k)
    y = sample.y
    prior, around = _prior(list(areas), subjects), _Sentences([t for t, _, _ in docs if t] + list(more))

    def terms(part: np.ndarray) -> dict[str, tuple[int, float]]:
        found, judged = prior | sample.terms(part), sample.judged(part)
        for _ in range(ROUNDS):
            found = around.widened(found, k, judged)
        return found

    turn = np.random.default_rng(0).permutation(len(docs))
    for fold in range(3):
        rest = turn % 3 != fold
        part = Chain(subjects, terms(rest), _source_table([d for d, r in zip(docs, rest, strict=True) if r], k))
        for i in np.flatnonzero(~rest):
            x[i] = part.features(docs[i][0], docs[i][1])
    chain.terms, chain.sources = terms(np.ones(len(docs), bool)), _source_table(docs, k)
    # one scale for a kind of feature, whatever the subject
    kinds = [slice(j * k, (j + 1) * k) for j in range(4)] + [slice(4 * k + j, 4 * k + j + 1) for j in range(4)]
    chain.mean = np.concatenate([np.full(x[:, c].shape[1], x[:, c].mean()) for c in kinds])
    chain.scale = np.concatenate([np.full(x[:, c].shape[1], x[:, c].std()) for c in kinds]) + 1e-6
    share = x[:, :k]
    z = (x - chain.mean) / chain.scale
    held = turn % 5 == 4
    one = np.ones((len(docs), 1))
    clear, none = share >= 0.3, share <= 0.02
    # label rates of documents that clearly lack or treat a subject, mixed with what careful labels would give
    chain.low = np.full(k, float(y[none].sum() / (none.sum() + MIXED)))
    chain.high = np.full(k, float((y[clear].sum() + MIXED * USUAL) / (clear.sum() + MIXED)))
    chain.high = np.maximum(chain.high, chain.low + 0.2)
    chain.slope, chain.shift = np.ones(k), np.zeros(k)
    # what all subjects have in common: how their own features tell of them; each subject's weights start from it
    own = lambda s: [s, k + s, 2 * k + s, 3 * k + s]
    shared = _logistic(np.concatenate([np.c_[z[~held][:, own(s)], one[~held]] for s in range(k)]), y[~held].T.ravel(), 1.0)
    for s in range(k):
        full = np.concatenate([z, y[:, :s], one], 1)
        common = np.zeros(full.shape[1])
        common[own(s)], common[-1] = shared[:4], shared[4]
        w = _logistic(full[~held], y[~held, s], RIDGE, common, 1.0)
        chain.weights.append(w)
        chain.slope[s], chain.shift[s] = _logistic(np.c_[full[held] @ w, np.ones(held.sum())], y[held, s], 0.1, np.array([1.0, 0.0]), 0.1)
    return chain


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> Chain:
    """Train on the bounded samples of labelled documents and of texts."""
    told = [r for r in areas.select("subject", "title", "scope_note").distinct().collect() if r.subject] if {"title", "scope_note"} <= set(areas.columns) else [r for r in areas.select("subject").distinct().collect() if r.subject]
    subjects = sorted({r.subject for r in told})
    place = {s.strip().lower(): i for i, s in enumerate(subjects)}
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(*place)) if place else labels.limit(0).select("doc_id", "subject")
    picked = named.groupBy("doc_id").agg(F.collect_set("subject").alias("told")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = documents.select("doc_id", "text", "source").join(F.broadcast(picked), "doc_id").distinct().collect()
    rows = sorted((r for r in rows if r.text), key=lambda r: (r.doc_id, r.text))
    others = documents.filter("text <> ''").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MORE_DOCS)
    more = [r.text for r in documents.select("doc_id", "text").join(F.broadcast(others), "doc_id").distinct().collect() if r.text]
    described = [(r.subject, " ".join(x for x in r if x)) for r in told]
    return train([(r.text, r.source, {place[s] for s in r.told}) for r in rows], subjects, described, more)


def assign(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, subject, chance, share): one row per document and assigned subject."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            x = np.stack([model.features(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("source").to_pylist(), strict=True)]) if ids else np.zeros((0, 1))
            holds, chance = model.decode(x)
            rows, cols = np.nonzero(holds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.int64()),
                    pa.array([model.subjects[j] for j in cols], pa.string()),
                    pa.array(chance[rows, cols] if len(rows) else [], pa.float64()),
                    pa.array(x[rows, cols] if len(rows) else [], pa.float64()),
                ],
                ["doc_id", "subject", "chance", "share"],
            )

    rows = spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text", "source"))
    return rows.mapInArrow(run, "doc_id long, subject string, chance double, share double")


def found(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject) of every assigned subject, each pair once."""
    return assign(documents, fit(documents, labels, areas)).select("doc_id", "subject").distinct()
