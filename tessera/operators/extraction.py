"""What goes into and comes out of models that extract or select."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import plain_wiki, stripped


@F.pandas_udf(T.ArrayType(T.StringType()))
def _python_list(replies: pd.Series) -> pd.Series:
    def read(text):
        try:
            found = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return found if isinstance(found, list) and all(isinstance(x, str) for x in found) else None

    return replies.map(read)


def reply_list(reply: Column) -> Column:
    """The list of strings that a reply holds between its first and last bracket, as JSON or as a Python
    list; null where it holds none."""
    inner = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(inner, "array<string>"), _python_list(inner))


def selected(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, text, used): the candidates (query_id, rank, text) that a reply (query_id, reply)
    selects, in the reply's order; numbers and quotes around them don't count and unknown ones are left out.

    A reply without a list selects everything (``used`` is false); an empty list selects nothing.
    """
    r = replies.select("query_id", reply_list(F.col("reply")).alias("chosen"))
    bare = lambda c: stripped(F.regexp_replace(F.regexp_replace(c, r"^\s*\d+\.\s*", ""), "^[\"'„“]+|[\"'“”]+$", ""))
    named = r.filter("chosen IS NOT NULL").select("query_id", F.posexplode("chosen").alias("place", "x")).select("query_id", "place", bare(F.col("x")).alias("key"))
    known = candidates.select("query_id", "text", bare(F.col("text")).alias("key"), "rank")
    hits = named.join(known, ["query_id", "key"]).groupBy("query_id", "text").agg(F.min("place").alias("place")).withColumn("used", F.lit(True))
    rest = candidates.join(r.filter("chosen IS NULL").select("query_id"), "query_id", "left_semi")
    return hits.unionByName(rest.select("query_id", "text", F.col("rank").cast("int").alias("place"), F.lit(False).alias("used")))


def relevant_names(names: DataFrame, texts: DataFrame, k: int = 300) -> DataFrame:
    """(text_id, name): names (name) of which a capitalized part of four or more letters occurs in the text
    (text_id, text), the first k of each text by code point.

    Parts and texts meet at their first four letters, as labels do.
    """
    parts = names.select("name", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit("[А-ЯA-Z][а-яa-z]*"), F.lit(0)))).alias("part")).filter(F.length("part") >= 4)
    parts = parts.select("name", F.lower("part").alias("part"), F.substring(F.lower("part"), 1, 4).alias("start"))
    # a name beyond the first k of its part is beyond the first k of every text
    parts = parts.distinct().withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("name"))).filter(F.col("n") <= k).drop("n")
    low = texts.filter(F.length("text") >= 4).select("text_id", F.lower("text").alias("low"))
    starts = low.select("text_id", "low", F.posexplode(F.transform(F.array("low"), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 3), lambda i: F.substring(x, i, F.lit(4))))[0]).alias("at", "start"))
    dealt = starts.withColumn("part_no", F.pmod(F.xxhash64("text_id", "at"), F.lit(8)).cast("int"))
    each = parts.withColumn("part_no", F.explode(F.array(*map(F.lit, range(8)))))
    held = dealt.join(each, ["start", "part_no"]).filter(F.substring(F.col("low"), F.col("at") + 1, F.length("part")) == F.col("part")).select("text_id", "name").distinct()
    return held.withColumn("n", F.row_number().over(Window.partitionBy("text_id").orderBy("name"))).filter(F.col("n") <= k).drop("n")


def extraction_pages(targets: DataFrame, pages: DataFrame, done: DataFrame, chars: int = 6000) -> DataFrame:
    """(term, title, source_file, text): for each target (term, fetchable, source_pages) that isn't done
    (label) and may be fetched (which is the default), its first source page, cleaned and cut to what an
    extraction model takes."""
    todo = targets.filter(F.coalesce("fetchable", F.lit(True))).select("term", F.try_element_at("source_pages", F.lit(1)).alias("page"))
    todo = todo.withColumn("_k", F.lower(stripped(F.col("term")))).join(done.select(F.lower(stripped(F.col("label"))).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    own = pages.filter("content IS NOT NULL").groupBy("source_file", "title").agg(F.min("content").alias("content"))
    found = todo.join(own, (F.col("page.file") == F.col("source_file")) & (F.col("page.title") == F.col("title")))
    return found.select("term", "title", "source_file", F.substring(plain_wiki(F.col("content")), 1, chars).alias("text"))


def zero_shot(items: DataFrame, models: dict, ask) -> DataFrame:
    """(id, model_answers): items (id, prompt, model_answers) with the answers of the models they lack one of.

    ask: function from (DataFrame (query_id, prompt), model) to (query_id, reply). Answers that are there stay.
    """
    have = items.select("id", F.explode_outer("model_answers").alias("model", "answer")).filter("answer IS NOT NULL AND answer <> ''")
    new = None
    for name, model in models.items():
        todo = items.select("id", "prompt").join(have.filter(F.col("model") == name).select("id"), "id", "left_anti")
        got = ask(todo.select(F.col("id").alias("query_id"), "prompt"), model).select(F.col("query_id").alias("id"), F.lit(name).alias("model"), F.col("reply").alias("answer"))
        new = got if new is None else new.unionByName(got)
    every = have if new is None else have.unionByName(new.filter("answer IS NOT NULL"))
    maps = every.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "answer")))).alias("model_answers"))
    return items.select("id").join(maps, "id", "left")


def diagnostics(counts: list[str], flags: list[str], timings: list[str]) -> Column:
    """A struct of a run's counters, flags and timings (rounded half to even to two decimals)."""
    return F.struct(*counts, *flags, F.struct(*[F.bround(t, 2).alias(t) for t in timings]).alias("timings_s"))


def article_rows(pages: DataFrame) -> DataFrame:
    """(title, content, language) of fetched articles with content, as they are stored."""
    from ..functions.text import plain_article

    return pages.select("title", plain_article(F.col("content")).alias("content"), "language").filter("content <> ''")
