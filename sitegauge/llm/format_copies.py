"""Records that differ only in white space, letter case, punctuation or field order.

A record's fields are reduced to their words in a fixed field order and hashed to 128 bits; groups are
counted with map-side combining. A second, independent 64-bit hash of the same canonical text checks
for collisions: should one group hold two values of it, records are grouped by the canonical text
itself instead. Copies find their group's first record by a join in which no group is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.text import normal_text
from sitegauge.plans.staging import join_by_group, staged

#: The payload's fields in canonical order.
FIELDS = ("title", "description", "status", "h1Count", "robots")


def canonical(payload: Column, *others: Column) -> Column:
    """Canonical text of a record: words of each field, absent, null and empty alike, fields kept apart.

    A payload that isn't JSON has no fields; its own words tell it from others and from one without words.
    Letters count as they are encoded: composed and decomposed ones are different words, as words are defined.
    """
    schema = ", ".join(f"{f} STRING" for f in (*FIELDS, "broken"))
    told = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "broken"})
    parts = [*others, *(told[f] for f in FIELDS), told["broken"]]
    return F.concat_ws("\u0001", *(F.coalesce(normal_text(p), F.lit("")) for p in parts))


def keyed(feed: DataFrame, exact: bool = False) -> DataFrame:
    """(feed_id, key, check), once for each record however often its row is repeated."""
    text = canonical(F.col("payload"), F.col("url"), F.col("canonical"))
    key = F.encode(text, "UTF-8") if exact else F.unhex(F.md5(text))
    rows = feed.filter("feed_id is not null").select("feed_id", key.alias("key"), F.xxhash64(text).alias("check"))
    return staged(rows.distinct())


def groups(rows: DataFrame) -> DataFrame:
    """One row per group of copies: its first record, its number of records, and whether checks differ."""
    return rows.groupBy("key").agg(
        F.min("feed_id").alias("first"), F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("collided")
    )


def _grouped(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = keyed(feed)
    found = staged(groups(rows))
    if found.filter("collided").limit(1).count():
        rows = keyed(feed, exact=True)
        found = staged(groups(rows))
    return rows, found


def copies(feed: DataFrame) -> DataFrame:
    """(feed_id_first, feed_id_copy): one row for each record that isn't the first of its group.

    Null ids are left out; null payloads have no words, invalid ones only their own; an empty table gives no row.
    """
    rows, found = _grouped(feed)
    total = int(found.agg(F.sum("n")).first()[0] or 0)
    pairs = join_by_group(rows.select("feed_id", "key"), found.filter("n > 1").select("key", "first", "n"), ["key"], "n", total)
    return pairs.filter("feed_id <> first").select(F.col("first").alias("feed_id_first"), F.col("feed_id").alias("feed_id_copy"))


def records(feed: DataFrame) -> DataFrame:
    """(feed_id, copies): the one record that stays for each group, with the number of its copies."""
    return _grouped(feed)[1].select(F.col("first").alias("feed_id"), F.col("n").alias("copies"))
