"""Evaluation passages inside a corpus, by Wu-Manber search over words.

A passage is any ``PASSAGE`` consecutive words of an item, so layout, case and punctuation don't matter.
The search string is a document's word sequence and a block is two words. A shift table says how far the
window can jump when its last block lies nowhere, or only earlier, in any passage; where the shift is
zero, the passages that end in that block (the suffix bucket) are told apart by their first block, and
direct comparison confirms. Most positions of a clean document are never looked at.

What is broadcast holds at most ``WORDS_AT_ONCE`` words of items, however many or long these are: longer items are
cut into pieces that overlap by a passage less a word, so none is lost, and more words make more blocks, each
searched for in its own pass over the corpus.
Null texts, and items shorter than a passage, match nothing. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from sitegauge.functions.text import words_of
from sitegauge.plans.staging import spread

PASSAGE = 10
WORDS_AT_ONCE = 1_000_000


class Passages:
    """Shift table and suffix buckets of all passages of some items."""

    def __init__(self, items: list[tuple[int, str | None]], length: int = PASSAGE) -> None:
        self.length = length
        self.far = length - 1
        self.shift: dict[tuple[str, str], int] = {}
        # last block -> first block -> passage -> items
        self.bucket: dict[tuple[str, str], dict[tuple[str, str], dict[tuple[str, ...], set[int]]]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(len(words) - length + 1):
                passage = tuple(words[i : i + length])
                for j in range(1, length):
                    block = passage[j - 1], passage[j]
                    away = length - 1 - j
                    if away < self.shift.get(block, self.far):
                        self.shift[block] = away
                last, first = passage[-2:], passage[:2]
                self.bucket.setdefault(last, {}).setdefault(first, {}).setdefault(passage, set()).add(item)

    def items_in(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        shift, bucket, far, length = self.shift.get, self.bucket, self.far, self.length
        end, n = length - 1, len(words)
        while end < n:
            block = words[end - 1], words[end]
            step = shift(block, far)
            if step:
                end += step
                continue
            start = end - length + 1
            same_ends = bucket[block].get((words[start], words[start + 1]))
            if same_ends and (items := same_ends.get(tuple(words[start : end + 1]))):
                found |= items
            end += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, length: int = PASSAGE) -> DataFrame:
    """(doc_id, item_id): every document that holds a passage of an item, each pair once."""
    if length < 3:
        raise ValueError("a passage needs at least three words")
    texts = spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"))

    def search(some: list[tuple[int, str | None]]) -> DataFrame:
        passages = documents.sparkSession.sparkContext.broadcast(Passages(some, length))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = passages.value.items_in
            for b in batches:
                pairs = [
                    (d, i)
                    for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                    for i in sorted(look(words_of(t)))
                ]
                docs, ids = zip(*pairs, strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "item_id"])

        return texts.mapInArrow(run, "doc_id long, item_id long")

    parts, block, size = [], [], 0
    for row in items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        for piece in pieces(words_of(row.text), length):
            if size + len(piece) > WORDS_AT_ONCE and block:
                parts.append(search(block))
                block, size = [], 0
            block.append((row.item_id, " ".join(piece)))
            size += len(piece)
    parts.append(search(block))
    return reduce(DataFrame.unionByName, parts).distinct()


def pieces(words: list[str], length: int = PASSAGE) -> Iterator[list[str]]:
    """An item's words in pieces of at most WORDS_AT_ONCE that hold all its passages between them."""
    step = WORDS_AT_ONCE - length + 1
    for start in range(0, max(1, len(words) - length + 1), step):
        yield words[start : start + WORDS_AT_ONCE]
