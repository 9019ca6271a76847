"""Queries of the text problems, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settled, spread, table
from . import copies, encoding, languages, leaks, lookalikes, markup, splitting


def _keys(spark: SparkSession, d: str, lone: bool = False) -> DataFrame:
    return settled(copies.page_keys(spread(table(spark, d, "wiki_pages").select("page_id", "title", "content")), spread(table(spark, d, "raw_pages").select("page_id", "record")), lone), "page-keys")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_keys(spark, d))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each page that may have copies, with their number, as its SQL has it; p1_pages has all pages."""
    return copies.copy_sets(_keys(spark, d)).select(F.col("first_id").alias("page_id"), "copies")


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """One record for each page with its number of copies, also for those that are never copies."""
    return copies.counted(_keys(spark, d, lone=True))


def p1_collisions(spark: SparkSession, d: str) -> DataFrame:
    return copies.collisions(_keys(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "wiki_pages").select(F.lit("page").alias("src"), F.col("page_id").alias("item_id"), "title", F.lit(None).cast("string").alias("section"), F.col("content").alias("text"))
    return pages.unionByName(table(spark, d, "chunks").select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("item_id"), "title", "section", "text"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(spread(_items(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each item that had to be cut, once: its first piece."""
    return p2_pieces(spark, d).filter("oversized AND piece_index = 0").select("src", "item_id")


def _question_rows(spark: SparkSession, d: str) -> DataFrame:
    return spread(lookalikes.question_rows(table(spark, d, "questions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.alike_questions(_question_rows(spark, d))


def p3_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question and answers in one consistent form."""
    return lookalikes.one_form_questions(_question_rows(spark, d))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.unmarked(spread(table(spark, d, "wiki_pages").select("page_id", "title", "source_file", "content")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_clean(spark, d).select("page_id", F.explode("kinds").alias("markup"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(spread(table(spark, d, "documents").select("doc_id", "text")))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bench_items").select(F.col("id").alias("item_id"), "question")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also re-parameterised copies, with the words of the stretch and the changed ones."""
    return leaks.leaked(spread(table(spark, d, "documents").select("doc_id", "text")), _questions(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).filter("kind = 'verbatim'").select("doc_id", "item_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.languages(_documents(spark, d)).select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "letter_words", F.transform("segments", lambda s: F.struct(s["lang"].alias("lang"), s["words"].alias("words"), F.round(s["confidence"], 6).alias("confidence"))).alias("segments"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(_documents(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p1_pages, p1_collisions, p2_found, p2_pieces, p3_found, p3_questions, p5_found, p5_clean, p6_ids, p7_found, p7_leaks, p8_found, p8_languages)}

#: What stays of a text without white space, punctuation and other signs, in lower case.
_FOLD = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_KEYED = f"""
WITH pages AS (
  SELECT page_id, title, content FROM wiki_pages
  UNION ALL
  SELECT page_id, json_extract_string(record, '$.title'), json_extract_string(record, '$.content') FROM (SELECT page_id, CASE WHEN json_valid(record) THEN record END AS record FROM raw_pages)
), keyed AS (
  SELECT page_id, {_FOLD.format("title")} AS t, {_FOLD.format("content")} AS c FROM pages WHERE title IS NOT NULL AND content IS NOT NULL
), sets AS (SELECT *, min(page_id) OVER (PARTITION BY t, c) AS first_id FROM keyed WHERE c <> '')
"""

ORACLE = {
    "p1_found": _KEYED + "SELECT DISTINCT first_id, page_id AS copy_id FROM sets WHERE page_id > first_id",
    "p1_collapsed": _KEYED + "SELECT first_id AS page_id, count(*) AS copies FROM sets GROUP BY first_id",
    "p2_found": """
WITH items AS (SELECT 'page' AS src, page_id AS item_id, content AS x FROM wiki_pages UNION ALL SELECT 'chunk', chunk_id, text FROM chunks)
SELECT src, item_id FROM items
WHERE length(x) > 2000 OR len(list_filter(string_split_regex(x, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda w: w <> '')) > 196
""",
}
