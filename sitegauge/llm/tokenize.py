"""Byte-pair encoding of whole corpora with a public vocabulary, by a pair occurrence index.

The distinct pieces of a batch are laid end to end as linked lists of symbols. An index maps every pair
that some merge joins to all its positions in the batch. Ranks in use are taken in ascending order; all
occurrences of a rank are merged in one sweep, left to right, which unlinks symbols and files the new
neighbour pairs. Since pieces don't touch, a global ascending order of ranks merges each piece exactly
as encoding it alone would. Pieces met before are looked up.

Null and empty texts have no ids: their list is empty. Strings of special tokens in a text are ordinary
text. Every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from sitegauge.plans.staging import spread

#: Fixed value: how the vocabulary's authors cut texts into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The default place of the vocabulary; a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a task before it starts anew.
REMEMBER = 1_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary: token bytes to rank, which is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairIndex:
    """Encoder of pieces; keeps what it has learned about pairs and pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}

    def _join(self, pair: tuple[int, int]) -> int:
        rank = self.joined.get(pair)
        if rank is None:
            rank = self.joined[pair] = self.ranks.get(self.token[pair[0]] + self.token[pair[1]], -1)
        return rank

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct new pieces together."""
        symbol: list[int] = []
        starts = []
        for p in pieces:
            starts.append(len(symbol))
            symbol += map(self.single.__getitem__, p.encode())
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            before[s] = -1
            if s:
                after[s - 1] = -1
        if n:
            after[n - 1] = -1
        index: dict[int, list[int]] = {}
        join = self._join
        for i, j in enumerate(after):
            if j >= 0 and (rank := join((symbol[i], symbol[j]))) >= 0:
                index.setdefault(rank, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for i in sorted(index.pop(rank, ())):
                j = after[i]
                # the pair may have been merged away since it was filed
                if symbol[i] < 0 or j < 0 or join((symbol[i], symbol[j])) != rank:
                    continue
                symbol[i], symbol[j] = rank, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left >= 0 and right >= 0 and (new := join((symbol[left], symbol[right]))) >= 0:
                        if new not in index:
                            index[new] = []
                            heapq.heappush(active, new)
                        index[new].append(left)
        for p, s in zip(pieces, starts, strict=True):
            ids = []
            while s >= 0:
                ids.append(symbol[s])
                s = after[s]
            self.known[p] = ids

    def encode(self, texts: list[str | None], split) -> list[list[int]]:
        pieces = [split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        if new := sorted(set(chain.from_iterable(pieces)).difference(self.known)):
            self.learn(new)
        return [list(chain.from_iterable(map(self.known.__getitem__, p))) for p in pieces]


def encode_texts(documents: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of each document, by the vocabulary at ``path``.

    The vocabulary is read on the driver and sent along; its size is fixed, so executors need no file.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        coder, split = PairIndex(shared.value), regex.compile(pattern).findall
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                ids = coder.encode(part.column("text").to_pylist(), split)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")
