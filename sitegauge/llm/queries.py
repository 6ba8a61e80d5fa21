"""Queries of the training-data operators, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import format_copies, language_crf, leakage, near_duplicates, subjects, template_residue, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.pages_to_exclude(_table(spark, sf_dir, "page_fetch"), _table(spark, sf_dir, "page_report"))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.message_templates(_table(spark, sf_dir, "page_fetch"), _table(spark, sf_dir, "page_report"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pages(_table(spark, sf_dir, "page_fetch"), _table(spark, sf_dir, "page_report"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "page_fetch"), _table(spark, sf_dir, "page_report"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.found(_table(spark, sf_dir, "page_fetch"), _table(spark, sf_dir, "page_locale"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "page_fetch")
    return language_crf.label_pages(pages, language_crf.fit(pages, _table(spark, sf_dir, "page_locale"))).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.copies(_table(spark, sf_dir, "report_feed"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies.records(_table(spark, sf_dir, "report_feed"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_texts(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(*(_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_templates, p2_found, p2_classes, p4_found, p4_segments, p5_found, p5_records, p6_ids, p7_found, p8_found)}


_WORDS = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_FIELDS = ", ".join(f"coalesce({_WORDS.format(c)}, '')" for c in ("url", "canonical", *(f"payload->>'$.{f}'" for f in format_copies.FIELDS)))
_COPIES = f"with k as (select distinct feed_id, [{_FIELDS}] as words from report_feed where feed_id is not null), g as (select words, min(feed_id) first, count(*) n from k group by 1)"


def oracle_sql() -> dict[str, str]:
    """SQL where words can be said in it: copies hidden by formatting and leaked passages."""

    def passages(key: str, table: str) -> str:
        words = f"select {key}, string_split({_WORDS.format('text')}, ' ') w from {table} where text is not null"
        last = leakage.PASSAGE - 1
        return f"select distinct {key} id, array_to_string(w[i:i + {last}], ' ') passage from (select {key}, w, unnest(range(1, len(w) - {last - 1})) i from ({words}))"

    return {
        "p5_found": f"{_COPIES} select first as feed_id_first, feed_id as feed_id_copy from k join g using (words) where feed_id <> first",
        "p5_records": f"{_COPIES} select first as feed_id, n as copies from g",
        "p7_found": f"with d as ({passages('doc_id', 'documents')}), i as ({passages('item_id', 'eval_items')}) select distinct d.id as doc_id, i.id as item_id from d join i using (passage)",
    }
