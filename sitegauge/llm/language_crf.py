"""Language of pages and of stretches of mixed pages by a linear-chain conditional random field.

Every word of a page's main text is a node. Its score for a language sums the weights of its affixes,
character n-grams and itself (the lexicon feature), all hashed into one table; two learned transition
tables tie it to the word before it, one within a paragraph and one across a paragraph's edge.
Beside them stands a lexicon: how often each word, hashed, is met under each locale language, counted over
all pages, since no bounded sample knows the words of a table that grows.
Forward-backward gives each word's posterior; a paragraph has the language with most posterior mass.

The field is trained here, by gradient ascent on its conditional likelihood, on at most
``TRAIN_PAGES`` pages for each language that a locale names. Locales are partly wrong, so between
passes the paragraphs of the sample take the language their words vote for. The sample is the pages
of the smallest hashed ids, hence the same for any partitioning; everything else runs over all pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import words_of
from sitegauge.operators.html import paragraphs
from sitegauge.plans.staging import spread

LANGS = ("en", "de", "fr", "es", "it", "nl")
MIN_WORDS = 40
#: Bound of the training sample for each language, passes over it, feature table size (a power of two).
TRAIN_PAGES, PASSES, SIZE = 100, 30, 1 << 16
#: Lexicon: hashed words (a power of two), words a language and uses a word need to count half, greatest score, steps of a score in a byte.
LEXICON, FEW_WORDS, FEW_USES, GREATEST, GRAIN = 1 << 20, 1000, 3.0, 5.0, 24
#: Passes before which the sample's paragraphs take the language their words vote for.
RELABEL = (5, 9, 13, 18)
CHUNK = 80
_K = len(LANGS)
_cache: dict[int, dict[str, int]] = {}


@dataclass
class Model:
    weights: np.ndarray  # SIZE x languages
    inside: np.ndarray  # languages x languages, log scale
    across: np.ndarray
    lexicon: np.ndarray  # LEXICON x (languages and what is left to the features), bytes
    key: int

    def emission(self, word: str) -> np.ndarray:
        row = self.lexicon[bucket(word)].astype(np.float32)
        return self.weights[features(word)].sum(0) * (row[_K] / 127) + row[:_K] / GRAIN


def bucket(word: str) -> int:
    """Row of the lexicon for a word; digits are alike."""
    return zlib.crc32(("0" if word.isdigit() else word).encode()) & (LEXICON - 1)


def features(word: str) -> list[int]:
    """Hashed lexicon, affix and n-gram features of a word; digits are alike."""
    w = "0" if word.isdigit() else word
    edge = f"^{w}$"
    names = [f"w:{w}", *(f"p:{w[:k]}" for k in (1, 2, 3)), *(f"s:{w[-k:]}" for k in (1, 2, 3))]
    names += [edge[i : i + 3] for i in range(max(1, len(edge) - 2))]
    return [zlib.crc32(x.encode()) & (SIZE - 1) for x in names]


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), n.max()), np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out, n


def forward_backward(score: np.ndarray, edge: np.ndarray, n: np.ndarray, inside: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (texts x words x languages) and expected transitions within and across paragraphs.

    ``score`` has the log emissions, ``edge`` is True at the first word of a paragraph, ``n`` are the
    lengths; positions from ``n`` on count for nothing.
    """
    b, t, k = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    a_in, a_ac = np.exp(inside), np.exp(across)
    alive = np.arange(t)[None, :] < n[:, None]
    alpha = np.empty((t, b, k), score.dtype)
    alpha[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = np.where(edge[:, i, None], alpha[i - 1] @ a_ac, alpha[i - 1] @ a_in) * e[:, i]
        x /= x.sum(1, keepdims=True) + 1e-30
        alpha[i] = np.where(alive[:, i, None], x, alpha[i - 1])
    beta = np.ones((b, k), score.dtype)
    post = np.empty((t, b, k), score.dtype)
    post[t - 1] = alpha[t - 1]
    sums = np.zeros((2, k, k))
    for i in range(t - 1, 0, -1):
        x = e[:, i] * beta
        on, at_edge = alive[:, i, None], edge[:, i, None]
        for which, a, mine in ((0, a_in, on & ~at_edge), (1, a_ac, on & at_edge)):
            rows = mine[:, 0]
            if rows.any():
                pair = alpha[i - 1][rows][:, :, None] * a[None] * x[rows][:, None, :]
                sums[which] += (pair / (pair.sum((1, 2), keepdims=True) + 1e-30)).sum(0)
        y = np.where(at_edge, x @ a_ac.T, x @ a_in.T)
        y /= y.sum(1, keepdims=True) + 1e-30
        beta = np.where(on, y, beta)
        p = alpha[i - 1] * beta
        post[i - 1] = p / (p.sum(1, keepdims=True) + 1e-30)
    return post.transpose(1, 0, 2), sums[0], sums[1]


def posteriors(score: np.ndarray, edge: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """Posteriors alone, as ``forward_backward`` gives them, without expected transitions."""
    b, t, k = score.shape
    e = np.ascontiguousarray(np.exp(score - score.max(2, keepdims=True)).transpose(1, 0, 2))
    both = np.exp(np.concatenate([model.inside, model.across], 1)).astype(score.dtype)
    back = np.exp(np.concatenate([model.inside.T, model.across.T], 1)).astype(score.dtype)
    cut = np.ascontiguousarray(edge.T)[:, :, None]
    last = n - 1
    alpha = np.empty((t, b, k), score.dtype)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, t):
        x = alpha[i - 1] @ both
        x = np.where(cut[i], x[:, k:], x[:, :k]) * e[i]
        x /= x.sum(1, keepdims=True) + 1e-30
        alpha[i] = x
    beta = np.ones((b, k), score.dtype)
    post = np.empty((t, b, k), score.dtype)
    for i in range(t - 1, -1, -1):
        beta[last <= i] = 1  # at and after its last word a text has nothing to come
        p = alpha[i] * beta
        post[i] = p / (p.sum(1, keepdims=True) + 1e-30)
        x = (e[i] * beta) @ back
        beta = np.where(cut[i], x[:, k:], x[:, :k])
        beta /= beta.sum(1, keepdims=True) + 1e-30
    return post.transpose(1, 0, 2)


def _chunks(paras: list[list[str]]) -> Iterator[list[list[str]]]:
    """Consecutive paragraphs in pieces of about CHUNK words, so that sequences are of like length; long ones are split."""
    part: list[list[str]] = []
    for p in paras:
        for start in range(0, len(p), 2 * CHUNK):
            part.append(p[start : start + 2 * CHUNK])
            if sum(map(len, part)) >= CHUNK:
                yield part
                part = []
    if part:
        yield part


def _by_row(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share an index."""
    return np.stack([np.bincount(index, values[:, k], rows) for k in range(values.shape[1])], 1)


def looked_up(lexicon: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words by language, and the share of their features' weights that counts beside them."""
    rows = lexicon[[bucket(w) for w in words]].astype(np.float32)
    return rows[:, :_K] / GRAIN, rows[:, _K:] / 127


def lexicon_of(counts: np.ndarray) -> np.ndarray:
    """The lexicon from uses of the hashed words by language: the log of a language's share over an even share.

    Rare words score near 0 and are left to their features; the more uses a word has, the less its features say, since
    they are learned on the sample.
    """
    uses = counts.sum(1, keepdims=True)
    rate = counts / (counts.sum(0) + FEW_WORDS)
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-30)
    score = np.log((uses * share + FEW_USES) / (uses / _K + FEW_USES))
    left = FEW_USES / (uses + FEW_USES)
    return np.rint(np.concatenate([score.clip(-GREATEST, GREATEST) * GRAIN, left * 127], 1)).astype(np.int8)


def train(texts: list[tuple[list[list[str]], str]], lexicon: np.ndarray | None = None) -> Model:
    """Fit the field to (paragraphs as word lists, language of the page) of the sample, beside the lexicon's scores."""
    if lexicon is None:
        lexicon = lexicon_of(np.zeros((LEXICON, _K)))
    vocab: dict[str, int] = {}
    seqs, edges, labels = [], [], []
    for paras, lang in texts:
        for part in _chunks(paras):
            words = [w for p in part for w in p]
            seqs.append(np.array([vocab.setdefault(w, len(vocab)) for w in words]))
            at = np.zeros(len(words), np.int64)
            at[np.cumsum([0, *map(len, part)])[:-1]] = 1
            edges.append(at)
            labels.append(np.full(len(words), LANGS.index(lang)))
    weights, trans = np.zeros((SIZE, _K)), np.zeros((2, _K, _K))
    if seqs:
        feats = [np.array(features(w)) for w in vocab]
        known, left = looked_up(lexicon, list(vocab))
        flat, first = np.concatenate(feats), np.cumsum([0, *map(len, feats)])[:-1]
        owner = np.repeat(np.arange(len(feats)), list(map(len, feats)))
        (ids, n), (edge, _), (y, _) = _padded(seqs), _padded(edges), _padded(labels)
        alive = np.arange(ids.shape[1])[None, :] < n[:, None]
        para = np.cumsum((edge * alive)[alive]) - 1  # paragraph of each living word, over all sequences
        later = alive[:, 1:].ravel()
        g_w, g_t = np.full(weights.shape, 1e-6), np.full(trans.shape, 1e-6)
        for step in range(PASSES):
            unit = np.add.reduceat(weights[flat], first, axis=0) * left + known
            if step in RELABEL:
                vote = _by_row(para, unit[ids[alive]], int(para[-1]) + 1)
                y[alive] = vote.argmax(1)[para]
            post, t_in, t_ac = forward_backward(unit[ids], edge.astype(bool), n, trans[0], trans[1])
            diff = (np.eye(_K)[y] - post)[alive]
            cell = ((edge[:, 1:] * _K + y[:, :-1]) * _K + y[:, 1:]).ravel()[later]
            seen = np.bincount(cell, minlength=2 * _K * _K).reshape(2, _K, _K)
            up = _by_row(ids[alive], diff, len(vocab)) * left
            grad = _by_row(flat, up[owner], SIZE) / len(n) - 1e-4 * weights
            gt = (seen - np.stack([t_in, t_ac])) / len(n) - 1e-3 * trans
            g_w += grad**2
            g_t += gt**2
            weights += 0.3 * grad / np.sqrt(g_w)
            trans += 0.2 * gt / np.sqrt(g_t)
    weights = weights.astype(np.float32)
    return Model(weights, trans[0].astype(np.float32), trans[1].astype(np.float32), lexicon, zlib.crc32(lexicon, zlib.crc32(weights)))


def named_language(locale: Column) -> Column:
    """The language that a locale names in any case, or null: two letters alone or before - or _."""
    bare = F.regexp_replace(locale, r"(?U)^\s+|\s+$", "")
    return F.lower(F.when(bare.rlike(r"^[A-Za-z]{2}(?:[-_]|$)"), F.substring(bare, 1, 2)))


def _main(html: str | None) -> list[list[str]]:
    paras = [w for p in paragraphs(html) if (w := words_of(p))]
    return paras if sum(map(len, paras)) >= MIN_WORDS else []


def lexicon(pages: DataFrame, locales: DataFrame) -> np.ndarray:
    """The lexicon of all pages whose locale names one of LANGS. Html stays in place: hashed words travel to the locales, then counts."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            ids, rows = [], []
            for i, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                words = [w for p in _main(h) for w in p]
                if words:
                    for w in set(words).difference(known):
                        known[w] = bucket(w)
                    ids.append(i), rows.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)).tobytes())
            if len(known) > 400_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["page_id", "words"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(LEXICON * _K, np.int32)
        for b in batches:
            rows = [np.frombuffer(x, np.int32) for x in b.column("words").to_pylist()]
            if rows:
                lang = np.repeat(np.array([LANGS.index(x) for x in b.column("lang").to_pylist()]), list(map(len, rows)))
                cells, n = np.unique(np.concatenate(rows) * _K + lang, return_counts=True)
                uses[cells] += n.astype(np.int32)
        table = uses.reshape(LEXICON, _K)
        met = np.flatnonzero(table.any(1))
        for start in range(0, len(met), 10_000):
            part = met[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(table[part, k]) for k in range(_K))], ["bucket", *LANGS])

    told = locales.select("page_id", named_language(F.col("locale")).alias("lang")).filter(F.col("lang").isin(*LANGS) & F.col("page_id").isNotNull()).distinct()
    src = spread(pages.filter("page_id is not null and html is not null").select("page_id", "html"))
    words = src.mapInArrow(coded, "page_id long, words binary").join(told, "page_id").select("words", "lang")
    sums = words.mapInArrow(counted, ", ".join(["bucket int", *(f"{k} int" for k in LANGS)])).groupBy("bucket").agg(*(F.sum(k).cast("float").alias(k) for k in LANGS))
    counts, met = np.zeros((LEXICON, _K)), sums.toArrow()
    counts[met.column("bucket").to_numpy()] = np.stack([met.column(k).to_numpy() for k in LANGS], 1)
    return lexicon_of(counts)


def fit(pages: DataFrame, locales: DataFrame) -> Model:
    """Train on the bounded sample of pages whose locale names one of LANGS, beside the lexicon of all such pages."""
    told = locales.select("page_id", named_language(F.col("locale")).alias("lang")).filter("page_id is not null")
    ids = [
        told.filter(F.col("lang") == k).groupBy("page_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
        for k in LANGS
    ]
    picked = ids[0]
    for x in ids[1:]:
        picked = picked.unionByName(x)
    rows = pages.select("page_id", "html").filter("html is not null").join(F.broadcast(picked), "page_id").groupBy("page_id", "lang").agg(F.min("html").alias("html")).collect()
    texts = {(r.page_id, r.lang): _main(r.html) for r in sorted(rows, key=lambda r: (r.page_id, r.lang, r.html))}
    return train([(x, lang) for (_, lang), x in texts.items() if x], lexicon(pages, locales))


def label_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, seg_no, lang, confidence, first_p, last_p, words) of every page that is long enough.

    seg_no 0 is the page with the language of most of its words; 1, 2, ... are the runs of paragraphs
    in one language, only of pages with more than one. Confidence is the mean posterior of the words.
    Null, empty and short pages give no row, repeated rows repeat their segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _cache.setdefault(model.key, {})
        table = np.zeros((max(1024, len(known)), _K), np.float32)
        for w, k in known.items():
            table[k] = model.emission(w)
        for b in batches:
            ids, docs = [], []
            for i, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                if paras := _main(h):
                    ids.append(i), docs.append(paras)
            coded = []
            for paras in docs:
                words = [w for p in paras for w in p]
                for w in set(words).difference(known):
                    known[w] = k = len(known)
                    if k >= len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[k] = model.emission(w)
                coded.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            out: list[tuple] = []
            order = sorted(range(len(ids)), key=lambda i: len(coded[i]))
            start = 0
            while start < len(order):
                width = len(coded[order[min(start + 1023, len(order) - 1)]])
                part = order[start : start + max(1, min(1024, 600_000 // width))]
                start += len(part)
                seq, n = _padded([coded[i] for i in part])
                edge = np.zeros(seq.shape, bool)
                for row, i in enumerate(part):
                    edge[row, np.cumsum([0, *map(len, docs[i])])[:-1]] = True
                post = posteriors(table[seq], edge, n, model)
                for row, i in enumerate(part):
                    out += _segments(ids[i], post[row, : n[row]], np.array([len(p) for p in docs[i]]))
            if len(known) > 400_000:
                known.clear()
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _NAMES)

    src = spread(pages.filter("page_id is not null and html is not null").select("page_id", "html"))
    return src.mapInArrow(run, "page_id long, seg_no int, lang string, confidence double, first_p int, last_p int, words int")


_NAMES = ["page_id", "seg_no", "lang", "confidence", "first_p", "last_p", "words"]


def _segments(page_id: int, post: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    starts = np.cumsum(sizes) - sizes
    mass = np.add.reduceat(post, starts, axis=0)
    best = mass.argmax(1)
    words = np.bincount(best, weights=sizes, minlength=_K)
    top = int(words.argmax())
    rows = [(page_id, 0, LANGS[top], float(mass[best == top, top].sum() / words[top]), 1, len(sizes), int(sizes.sum()))]
    if (best != best[0]).any():
        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1), len(best)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
            total = int(sizes[i:j].sum())
            rows.append((page_id, k, LANGS[best[i]], float(mass[i:j, best[i]].sum() / total), int(i) + 1, int(j), total))
    return rows


def found(pages: DataFrame, locales: DataFrame) -> DataFrame:
    """(page_id, seg_no, lang): mislabelled pages as seg_no 0, stretches of mixed pages from 1 on.

    A page is rightly labelled if one of its locale rows names its language; null, blank and
    placeholder locales and missing rows name none. Empty tables give no row.
    """
    rows = label_pages(pages, fit(pages, locales)).select("page_id", "seg_no", "lang")
    told = locales.select("page_id", named_language(F.col("locale")).alias("lang"), F.lit(0).alias("seg_no")).filter("lang is not null").distinct()
    return rows.join(told, ["page_id", "seg_no", "lang"], "left_anti").distinct()
