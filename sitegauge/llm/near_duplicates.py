"""Near-duplicate texts: one-permutation hashing, banded buckets and star-shaped candidate edges.

1. Texts are reduced to their words. Equal word sequences form a class; only the class's smallest id,
   its representative, goes on, so copies cost nothing beyond one map-side combined aggregation.
2. One hash per shingle of ``SHINGLE`` words fills ``BINS`` bins with their minima (one permutation
   instead of one per bin); empty bins copy a non-empty bin drawn by a universal hash of bin and
   attempt (optimal densification).
3. ``ROWS`` bins make a band; texts that agree on a band share a bucket. A bucket of two or three is
   read off its minimum, maximum and xor. A larger one yields only a star: an edge from each member
   to two hubs drawn anew for each band, so edges grow with members, not with their square.
4. Edges are thinned by ``SKETCH`` one-byte samples and then verified on the exact shingle sets.
   Members of a star whose hub edge verifies are paired in turn (friends of a friend), until nothing
   new appears: work follows the verified links, not the bucket's size.

The threshold, not a cap, decides what is returned; no partner, bucket or candidate is dropped. Hashing itself
is a chance: 80 bands of 4 miss a pair at similarity 0.5 with a chance of 0.6 %, at 0.6 of 0.001 %; so does a star
for a pair whose members both lie below LINK to the hubs of all bands that they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import normal_text, words_of
from sitegauge.operators.html import main_text
from sitegauge.plans.staging import StagedParts, join_by_group, spread, staged

SHINGLE = 3
THRESHOLD = 0.5
#: Links at least this similar to a hub make its members candidates for each other.
LINK = 0.3
BINS, ROWS = 320, 4
BANDS = BINS // ROWS
SKETCH = 128
#: Pairs whose sketches agree on fewer positions than this share can't reach LINK, or, where no star needs them,
#: THRESHOLD, but by a freak: the shares lie four standard deviations of a sample below these.
STAR_SHARE, PAIR_SHARE = 0.2, 0.33
#: A hub counts as hot from this share of all pairs on; at most 1/share hubs travel with their texts.
HUB_SHARE = 1e-2
#: Large buckets that may be broadcast (40 bytes each), and the fields whose texts are compared.
FEW_BUCKETS = 300_000
FIELDS = ("html", "description")
MIN_WORDS = {"html": 40, "description": 12}
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(known) > 2_000_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _shingles(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts and the number of the text each belongs to."""
    split = [t.split(" ") for t in texts]
    n = np.array([len(s) for s in split])
    codes = _word_codes([w for s in split for w in s], known)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(codes) < SHINGLE:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(codes) - SHINGLE + 1
    h = np.zeros(last, np.uint64)
    for k in range(SHINGLE):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + last])
    inside = owner[:last] == owner[SHINGLE - 1 :]
    return h[inside], owner[:last][inside]


def _donors(attempt: int) -> np.ndarray:
    at = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS + 1)
    return (_mix(at * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)


def signatures(texts: list[str], known: dict[str, int]) -> np.ndarray:
    """One row of BINS densified minima for each text; a text without a shingle has only _EMPTY."""
    sig = np.full(len(texts) * BINS, _EMPTY)
    h, owner = _shingles(texts, known)
    if len(h):
        slot = owner * BINS + (h % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(sig, slot, h // np.uint64(BINS))
    sig = sig.reshape(len(texts), BINS)
    full = sig != _EMPTY
    row, col = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    out = sig.copy()
    while len(row):
        donor = _donors(attempt)[col]
        ok = full[row, donor]
        out[row[ok], col[ok]] = sig[row[ok], donor[ok]]
        row, col, attempt = row[~ok], col[~ok], attempt + 1
    return out


def _bands(sig: np.ndarray, field: np.ndarray) -> np.ndarray:
    """A bucket for each band of each text; its last bit is the field, so no row needs to say it."""
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]
    for k in range(ROWS):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::ROWS])
    return (h << np.uint64(1)) | field.astype(np.uint64)[:, None]


def _field_of(bucket: Column) -> Column:
    return F.when(bucket.bitwiseAND(F.lit(1)) == 0, FIELDS[0]).otherwise(FIELDS[1])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        for start in range(0, b.num_rows, 4000):
            part = b.slice(start, 4000)
            sig = signatures(part.column("words").to_pylist(), known)
            alive = (sig != _EMPTY).any(1)
            sig = sig[alive]
            field = np.array([FIELDS.index(f) for f in part.column("field").to_pylist()], np.int64)[alive]
            bands = _bands(sig, field).view(np.int64).ravel()
            low = (_mix(sig[:, :SKETCH]) & np.uint64(255)).astype(np.uint8)
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("field").filter(keep),
                    part.column("rep").filter(keep),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(bands)),
                    pa.array([low[i].tobytes() for i in range(len(low))], pa.binary()),
                ],
                ["field", "rep", "bands", "sketch"],
            )


def _main_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least = MIN_WORDS["html"]
    for b in batches:
        ids, texts = [], []
        for i, h in zip(b.column("id").to_pylist(), b.column("html").to_pylist(), strict=True):
            words = words_of(main_text(h))
            if len(words) >= least:
                ids.append(i)
                texts.append(" ".join(words))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "words"])


def page_words(pages: DataFrame) -> DataFrame:
    """(id, words) of pages whose main text is long enough; columns page_id and html are read."""
    src = spread(pages.filter("page_id is not null and html is not null").select(F.col("page_id").alias("id"), "html"))
    return src.mapInArrow(_main_words, "id long, words string")


def description_words(reports: DataFrame) -> DataFrame:
    """(id, words) of pages whose report has a long enough description."""
    words = normal_text(F.col("meta.description"))
    src = reports.filter("page_id is not null").select(F.col("page_id").alias("id"), words.alias("words"))
    return src.filter(F.size(F.split("words", " ")) >= MIN_WORDS["description"])


def classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (field, id, words) -> representatives (field, rep, words, n) and members (field, id, rep).

    Repeated rows count once; an id that has several texts in one field belongs to several classes.
    """
    keyed = staged(texts.withColumn("key", F.unhex(F.md5(F.concat_ws("\u0001", "field", "words")))))
    reps = staged(
        keyed.groupBy("field", "key").agg(F.min("id").alias("rep"), F.any_value("words").alias("words"), F.count("*").alias("n"))
    )
    many = reps.filter("n > 1").select("field", "key", "rep", "n")
    rows = keyed.select("field", "key", "id")
    total = keyed.count()
    members = staged(join_by_group(rows, many, ["field", "key"], "n", total).select("field", "id", "rep").distinct())
    return reps.select("field", "rep", "words"), members


def _spread(band: Column) -> Column:
    """A number drawn from the band, to choose another hub in every band."""
    return F.xxhash64(band).bitwiseAND(F.lit((1 << 40) - 1))


def candidate_edges(signed: DataFrame) -> DataFrame:
    """(field, a, b, star): distinct candidate pairs a < b; star marks those of buckets above three."""
    rows = signed.select("rep", F.explode("bands").alias("bucket"))
    bucket, rep = F.col("bucket"), F.col("rep")
    code = rep.bitwiseXOR(_spread(bucket))
    found = staged(
        rows.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi"), F.bit_xor("rep").alias("all"))
        .filter("n > 1")
        .withColumns({"lo": F.col("lo").bitwiseXOR(_spread(bucket)), "hi": F.col("hi").bitwiseXOR(_spread(bucket))})
    )
    third = F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    small = found.filter("n <= 3").select(
        _field_of(bucket).alias("field"),
        F.inline(F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, third), pair(hi, third)))),
        F.lit(False).alias("star"),
    )
    large = found.filter("n > 3").drop("all")
    total, buckets = large.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if total:
        # few enough buckets go to the rows; else rows go to buckets, hot ones excepted
        spokes = rows.join(F.broadcast(large), "bucket") if buckets <= FEW_BUCKETS else join_by_group(rows, large, ["bucket"], "n", int(total))
        small = small.unionByName(
            spokes.select(_field_of(bucket).alias("field"), F.inline(F.array(pair(rep, lo), pair(rep, hi))), F.lit(True).alias("star")).filter("a < b")
        )
    return small.groupBy("field", "a", "b").agg(F.max("star").alias("star"))


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        wide = lambda c, b=b: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, SKETCH)
        keep = (wide("sa") == wide("sb")).mean(1) >= np.where(b.column("star").to_numpy(zero_copy_only=False), STAR_SHARE, PAIR_SHARE)
        yield b.filter(pa.array(keep)).select(["field", "a", "b", "star"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist(), strict=True):
            p, q = x.split(" "), y.split(" ")
            s, t = set(zip(p, p[1:], p[2:], strict=False)), set(zip(q, q[1:], q[2:], strict=False))
            both = len(s & t)
            out.append(both / max(1, len(s) + len(t) - both))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("field", "a", "b", "star")), pa.array(out, pa.float64())], ["field", "a", "b", "star", "similarity"]
        )


def _beside(pairs: DataFrame, table: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """Staged pairs with a column of ``table`` (field, rep, ...) for either side; a hub of most pairs is no hot key."""
    total = pairs.count()
    rest = [c for c in pairs.columns if c not in ("field", "a", "b")]
    found = pairs
    for side, name in zip(("a", "b"), names, strict=True):
        degree = pairs.groupBy("field", side).agg(F.count("*").alias("n"))
        own = table.select("field", F.col("rep").alias(side), F.col(value).alias(name)).join(degree, ["field", side])
        found = join_by_group(found, own, ["field", side], "n", total, HUB_SHARE)
    return found.select("field", "a", "b", *rest, *names)


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Staged pairs with their exact similarity where it is at least LINK."""
    wide = _beside(pairs, reps, "words", ("wa", "wb")).select("field", "a", "b", "star", "wa", "wb")
    return wide.mapInArrow(_exact, "field string, a long, b long, star boolean, similarity double").filter(F.col("similarity") >= LINK)


def star_links(reps: DataFrame) -> DataFrame:
    """(field, a, b, star, similarity): the links at LINK or more among small buckets and the stars of large ones.

    Their number grows with the number of texts, however many of them are alike.
    """
    signed = staged(reps.mapInArrow(_sign, "field string, rep long, bands array<long>, sketch binary"))
    edges = staged(candidate_edges(signed.select("rep", "bands")))
    near = _beside(edges, signed, "sketch", ("sa", "sb")).select("field", "a", "b", "star", "sa", "sb")
    return staged(verified(staged(near.mapInArrow(_agree, "field string, a long, b long, star boolean")), reps))


def similar_classes(reps: DataFrame) -> DataFrame:
    """(field, a, b, similarity) for every pair of class representatives found at THRESHOLD or more."""
    links = StagedParts(reps.sparkSession)
    fresh = links.add(star_links(reps)).filter("star")
    while fresh.limit(1).count():
        # only pairs that a verified link joined in this round are extended; each round finds new pairs or is the last
        known = links.all().select("field", "a", "b")
        both = known.unionByName(known.select("field", F.col("b").alias("a"), F.col("a").alias("b")))
        ends = fresh.select("field", F.col("a").alias("hub"), F.col("b").alias("x"))
        ends = ends.unionByName(fresh.select("field", F.col("b").alias("hub"), F.col("a").alias("x")))
        hop = ends.join(both.select("field", F.col("a").alias("hub"), F.col("b").alias("y")), ["field", "hub"]).filter("x != y")
        new = hop.select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = staged(new.join(known, ["field", "a", "b"], "left_anti").withColumn("star", F.lit(True)))
        fresh = links.add(verified(new, reps))
    return links.all().filter(F.col("similarity") >= THRESHOLD).drop("star")


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(field, rep, label): the smallest representative that links lead to, for each of ``nodes`` (field, rep).

    Labels are handed along links until none changes, each round also to what the label itself was given, so the
    number of rounds grows with the logarithm of the longest chain. A hub of most links is no hot key.
    """
    ends = staged(links.select("field", F.col("a").alias("rep"), F.col("b").alias("near")).unionByName(links.select("field", F.col("b").alias("rep"), F.col("a").alias("near"))))
    total = ends.count()
    degree = staged(ends.groupBy("field", "near").agg(F.count("*").alias("n")))
    labels = staged(nodes.select("field", "rep", F.col("rep").alias("label")))
    while True:
        told = join_by_group(ends, degree.join(labels.withColumnRenamed("rep", "near"), ["field", "near"]), ["field", "near"], "n", total)
        step = labels.unionByName(told.select("field", "rep", "label")).groupBy("field", "rep").agg(F.min("label").alias("label"))
        sizes = step.groupBy("field", F.col("label").alias("via")).agg(F.count("*").alias("n"))
        jump = sizes.join(labels.select("field", F.col("rep").alias("via"), F.col("label").alias("further")), ["field", "via"])
        new = staged(join_by_group(staged(step).withColumnRenamed("label", "via"), staged(jump), ["field", "via"], "n", nodes.count()).select("field", "rep", F.least("via", "further").alias("label")))
        if not new.join(labels, ["field", "rep", "label"], "left_anti").limit(1).count():
            return new
        labels = new


def page_reps(pages: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives and members of classes of equal texts, of both fields."""
    field = lambda df, name: df.select(F.lit(name).alias("field"), "id", "words")
    return classes(field(page_words(pages), "html").unionByName(field(description_words(reports), "description")))


def near_duplicate_pages(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """(field, page_id_a, page_id_b) of all pairs of pages at THRESHOLD or more, copies included.

    Null ids, null or short texts never pair; repeated rows count once; empty tables give no row;
    other columns of the inputs are ignored.
    """
    reps, members = page_reps(pages, reports)
    pairs = similar_classes(reps)
    own = members.select("field", "id", "rep")
    for side in ("a", "b"):
        copies = own.select("field", F.col("rep").alias(side), F.col("id").alias(f"page_id_{side}"))
        pairs = pairs.join(copies, ["field", side], "left").withColumn(f"page_id_{side}", F.coalesce(f"page_id_{side}", side))
    across = pairs.select("field", F.least("page_id_a", "page_id_b").alias("page_id_a"), F.greatest("page_id_a", "page_id_b").alias("page_id_b"))
    mine = own.select("field", "rep", F.col("id").alias("page_id_a")).join(own.select("field", "rep", F.col("id").alias("page_id_b")), ["field", "rep"])
    within = mine.select("field", "page_id_a", "page_id_b")
    return across.unionByName(within).filter("page_id_a < page_id_b").distinct()


def near_duplicate_classes(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """(field, page_id, text_id, class_id): one row per page of a long enough text; no class is expanded into pairs.

    ``text_id`` is the smallest page id with the same words, ``class_id`` the smallest that a chain of links at
    THRESHOLD or more leads to. Only star links are verified, so the work grows with the pages even where a third
    of them are alike. Same treatment of nulls, short texts and repeats as ``near_duplicate_pages``.
    """
    reps, members = page_reps(pages, reports)
    links = star_links(reps).filter(F.col("similarity") >= THRESHOLD).select("field", "a", "b")
    own = reps.select("field", "rep")
    labels = grouped(own, links)
    everyone = members.unionByName(own.select("field", F.col("rep").alias("id"), "rep")).distinct()
    sizes = everyone.groupBy("field", "rep").agg(F.count("*").alias("n"))
    everyone = staged(everyone)
    out = join_by_group(everyone, staged(labels.join(sizes, ["field", "rep"])), ["field", "rep"], "n", everyone.count())
    return out.select("field", F.col("id").alias("page_id"), F.col("rep").alias("text_id"), F.col("label").alias("class_id"))
