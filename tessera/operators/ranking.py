"""Ranking of candidates (query_id, query, cand_id, text): scores, funnels, budgets.

Higher scores are better; ties go to the smaller candidate. A query's candidates are ranked by a window
over the query, so a limit is per query and never depends on the order of rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vocabulary as v
from ..functions.arrow import pieces
from ..functions.text import bound, keywords, stem, words


def _lexical(words_: Column, low: Column) -> Column:
    return F.aggregate(F.filter(words_, lambda w: F.contains(low, w)), F.lit(0), lambda s, w: s + 2 * F.length(w))


def lexical_score(query: Column, text: Column) -> Column:
    """Twice the length of each keyword of the query that the text contains."""
    return bound(F.lower(text), lambda low: _lexical(keywords(query), low))


def stem_score(query: Column, text: Column) -> Column:
    """The lexical score, and the length of each stem that query and text share."""
    stems = lambda k: F.array_distinct(F.transform(k, stem))
    shared = lambda k: F.array_intersect(stems(k), stems(keywords(text)))
    both = lambda k: lexical(k) + F.aggregate(shared(k), F.lit(0), lambda s, w: s + F.length(w))
    lexical = lambda k: bound(F.lower(text), lambda low: _lexical(k, low))
    return bound(keywords(query), both)


def ready(text: Column) -> Column:
    """What the stem score needs of a text: its keywords, their stems, and the text in lower case."""
    return bound(keywords(text), lambda k: F.struct(k.alias("words"), F.array_distinct(F.transform(k, stem)).alias("stems"), F.lower(text).alias("low")))


def ready_stem_score(query: str, text: str) -> Column:
    """``stem_score`` of two columns made by ``ready``."""
    q, t = F.col(query), F.col(text)
    return _lexical(q["words"], t["low"]) + F.aggregate(F.array_intersect(q["stems"], t["stems"]), F.lit(0), lambda s, w: s + F.length(w))


def word_overlap(queries: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a model that scores pairs: the keywords that a text shares with the query, in thousandths of its own."""
    known: dict = {}

    def own(text):
        if text not in known:
            known[text] = {w for w in (text or "").lower().split() if len(w) > 2 and w not in v.STOP_WORDS}
        return known[text]

    return [float(1000 * len(own(q) & own(t)) // (1 + len(own(t)))) for q, t in zip(queries, texts)]


def model_scores(rows: DataFrame, query: str, text: str, model, out: str = "score", batch: int = 64) -> DataFrame:
    """Rows with the score that a model for pairs (queries, texts) -> scores gives, called for batches in Python
    workers: it is loaded there once, by its first call. A null among the texts scores 0."""
    kept = rows.schema
    schema = pa.schema([*to_arrow_schema(kept), pa.field(out, pa.float64())])

    def run(batches):
        for b in pieces(batches, rows=batch):
            q, t = b.column(kept.names.index(query)).to_pylist(), b.column(kept.names.index(text)).to_pylist()
            at = [k for k in range(len(q)) if q[k] is not None and t[k] is not None]
            scores = [0.0] * len(q)
            for k, s in zip(at, model([q[k] for k in at], [t[k] for k in at]) if at else ()):
                scores[k] = float(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=schema)

    return rows.mapInArrow(run, StructType([*kept.fields, StructField(out, DoubleType())]))


def reranked(candidates: DataFrame, model=word_overlap, k: int | None = None) -> DataFrame:
    """Candidates (query_id, query, cand_id, text) ranked by a model for pairs, the first k of each query."""
    return ranked(model_scores(candidates, "query", "text", model, "_model"), F.col("_model"), k).drop("_model")


SCORES = {"lexical": lexical_score, "stem": stem_score}


def ranked(candidates: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """With ``score`` and ``rank`` from 1, the first k."""
    df = candidates.withColumn("score", score)
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")))
    return df.filter(F.col("rank") <= k) if k else df


def funnel(candidates: DataFrame, coarse: int = 300, fine: int = 100) -> DataFrame:
    """(query_id, cand_id, place) of candidates (query_id, cand_id, protected, coarse_score, fine_score):
    protected ones first; the others by the coarse score within the first budget, then by the fine one within
    the second, both less the protected ones."""
    n = F.count_if("protected").over(Window.partitionBy("query_id"))
    df = candidates.withColumn("held", n)
    by = lambda c: F.row_number().over(Window.partitionBy("query_id", "protected").orderBy(F.desc(c), "cand_id"))
    df = df.withColumn("a", by("coarse_score")).filter(F.col("protected") | (F.col("a") <= F.greatest(F.lit(0), coarse - F.col("held"))))
    df = df.withColumn("b", by("fine_score")).filter(F.col("protected") | (F.col("b") <= F.greatest(F.lit(0), fine - F.col("held"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("protected"), F.desc("fine_score"), "cand_id"))
    return df.select("query_id", "cand_id", place.alias("place"))


def within_budget(hits: DataFrame, budget: int = 2307) -> DataFrame:
    """Hits (query_id, rank, text) in order until the next would take more than ``budget`` words; of equal
    texts the first counts."""
    one = hits.groupBy("query_id", "text").agg(F.min("rank").alias("rank"))
    total = F.sum(F.size(words(F.col("text")))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("words_so_far", total).filter(F.col("words_so_far") <= budget)


def topped_up(hits: DataFrame, least: int = 10) -> DataFrame:
    """Hits (query_id, rank, text, kept) that were kept, and where a query has fewer than ``least`` but some,
    the next ones by rank up to that many."""
    n = F.count_if("kept").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("kept"), "rank"))
    df = hits.withColumn("n", n).withColumn("place", place)
    return df.filter((F.col("n") > 0) & (F.col("place") <= F.greatest(F.lit(least), F.col("n")))).select("query_id", "rank", "text", "kept")


def context_or_fallback(reranked: DataFrame, context: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, context, fallback): the context's texts (query_id, rank, text), or the first k reranked ones."""
    one = lambda df: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("t"))
    first = reranked.filter(F.col("rank") <= k)
    return one(first).withColumnRenamed("t", "f").join(one(context), "query_id", "full").select("query_id", F.coalesce("t", "f").alias("context"), F.col("t").isNull().alias("fallback"))
