"""Chunkers: pages (title, content, source_file) to chunks.

Sizes are given in tokens and taken as ``int(tokens / 1.3)`` words, one at least. Blank pages give
no chunk; a missing title is ``Unknown``, a missing file ``unknown``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, words

HEADING = r"==\s*(.+?)\s*=="


def in_words(tokens: int) -> int:
    return max(1, int(tokens / 1.3))


@dataclass(frozen=True)
class Strategy:
    """How pages are chunked: one of the kinds below, or a function from pages to (page_id, title, source_file,
    chunk_index, text) and, where it has them, section and parent_id."""

    kind: str | Callable[[DataFrame], DataFrame]
    size: int = 256
    overlap: int = 32
    parent: int = 512


#: Chunkers by name: fixed windows, sections, parents with children, and the older windows.
STRATEGIES = {"fixed256": Strategy("fixed"), "structure": Strategy("structure"), "parentchild": Strategy("parentchild", 128, 16), "fixed500": Strategy("fixed", 500, 50)}


def windows(w: Column, size: int, overlap: int) -> Column:
    """Windows of a word array: array of (i, text). They start every size - overlap words and stop
    with the first that reaches the end."""
    stride = max(1, size - overlap)
    n = F.size(w)
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, i * stride + 1, F.lit(size)), " ").alias("text")))


def pages_of(pages: DataFrame) -> DataFrame:
    """(page_id, title, content, source_file) of pages that aren't blank, with defaults."""
    return pages.select("page_id", F.coalesce("title", F.lit("Unknown")).alias("title"), "content", F.coalesce("source_file", F.lit("unknown")).alias("source_file")).filter(F.col("content").rlike(r"[^\s\p{Z}]"))


def fixed(pages: DataFrame, tokens: int = 256, overlap: int = 32) -> DataFrame:
    """Windows over the whole page."""
    df = pages_of(pages).withColumn("w", F.explode(windows(words(F.col("content")), in_words(tokens), in_words(overlap))))
    return df.select("page_id", "title", "source_file", F.col("w.i").alias("chunk_index"), F.col("w.text").alias("text"))


def sections(content: Column) -> Column:
    """Array of (section, body): what stands before the first heading has an empty name."""
    names = F.regexp_extract_all(content, F.lit(HEADING), F.lit(1))
    bodies = F.split(content, HEADING, -1)
    return F.transform(bodies, lambda b, i: F.struct(i.alias("s"), F.when(i == 0, "").otherwise(F.try_element_at(names, i)).alias("section"), stripped(b).alias("body")))


def _sections(pages: DataFrame) -> DataFrame:
    return pages_of(pages).withColumn("x", F.explode(sections(F.col("content")))).select("page_id", "title", "source_file", "x.*").filter("body <> ''")


def _head() -> Column:
    return F.concat(F.col("title"), F.when(F.col("section") != "", F.concat(F.lit(": "), "section")).otherwise(""), F.lit("\n"))


def structure(pages: DataFrame, tokens: int = 256, overlap: int = 32) -> DataFrame:
    """A section as it stands where it is short enough, else windows, each after a line with title
    and section; the index runs over the page. Sections are counted in arrays, so no window of a
    page leaves its row before it is numbered."""
    w = words(F.col("body"))
    parts = F.when(F.size(w) <= in_words(tokens), F.array(F.struct(F.lit(0).alias("i"), F.col("body").alias("text")))).otherwise(windows(w, in_words(tokens), in_words(overlap)))
    df = _sections(pages).withColumn("w", F.explode(parts))
    order = Window.partitionBy("page_id").orderBy("s", "w.i")
    return df.select("page_id", "title", "section", "source_file", (F.row_number().over(order) - 1).alias("chunk_index"), F.concat(_head(), "w.text").alias("text"))


def parents(pages: DataFrame, tokens: int = 512) -> DataFrame:
    """Windows of each section without overlap: (parent_id, text, title, section)."""
    n = in_words(tokens)
    df = _sections(pages).withColumn("w", F.explode(windows(words(F.col("body")), n, 0)))
    return df.select("page_id", "s", "source_file", F.concat_ws("::", "source_file", "title", F.concat(F.lit("s"), "s"), F.concat(F.lit("p"), "w.i")).alias("parent_id"), F.col("w.i").alias("m"), F.col("w.text").alias("text"), "title", "section")


def children(parent_rows: DataFrame, tokens: int = 128, overlap: int = 16) -> DataFrame:
    """Windows of each parent after a line with title and section; the index runs over the page."""
    df = parent_rows.withColumn("w", F.explode(windows(words(F.col("text")), in_words(tokens), in_words(overlap))))
    order = Window.partitionBy("page_id").orderBy("s", "m", "w.i")
    return df.select("page_id", "title", "section", "source_file", "parent_id", (F.row_number().over(order) - 1).alias("chunk_index"), F.concat(_head(), "w.text").alias("text"))


def chunked(pages: DataFrame, strategy: str) -> DataFrame:
    """Chunks by a named strategy: (page_id, title, section, source_file, parent_id, is_child, chunk_index, text)."""
    s = STRATEGIES[strategy]
    if callable(s.kind):
        df = s.kind(pages)
    elif s.kind == "fixed":
        df = fixed(pages, s.size, s.overlap)
    elif s.kind == "structure":
        df = structure(pages, s.size, s.overlap)
    else:
        df = children(parents(pages, s.parent), s.size, s.overlap)
    child = s.kind == "parentchild"
    have = lambda c: F.col(c) if c in df.columns else F.lit("")
    return df.select("page_id", "title", have("section").alias("section"), "source_file", have("parent_id").alias("parent_id"), F.lit(child).alias("is_child"), "chunk_index", "text")


def with_parents(hits: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Ranked hits (query_id, rank, doc_id, parent_id, text) with the parent's text in place of the child's,
    one for each parent at its best rank; hits without parent stay as they are."""
    df = hits.join(parent_rows.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    key = F.coalesce(F.when(F.col("parent_text").isNotNull(), F.col("parent_id")), F.col("doc_id").cast("string"))
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "doc_id"))
    return df.withColumn("n", first).filter("n = 1").select("query_id", "rank", "doc_id", F.coalesce("parent_text", "text").alias("text"))
