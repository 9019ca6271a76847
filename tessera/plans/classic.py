"""The older variants of the pipeline's stages, by option: facts without merging equal sentences, one shared
frontier, plain retrieval, uncapped keyword bonus, a stricter filter."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import bound, holds_any, words
from ..operators import dataset, extraction, graph, ranking, vectors
from ..sources.tables import settled


def all_facts(triples: DataFrame) -> DataFrame:
    """A sentence for each triple, equal ones too."""
    return graph.facts(triples, dedupe=False)


def told_with_missing(triples: DataFrame) -> DataFrame:
    """Sentences also for quantities with a unit but no value, which ``graph.tellable`` leaves out later."""
    return graph.facts(triples, missing=True)


def shared_frontier(seeds: DataFrame, triples: DataFrame, hops: int = 2, each: int = 30) -> DataFrame:
    """(query_id, hop, s, p, o): all seeds of a query as one frontier, without a beam; a hop takes the first
    ``each`` times as many triples as its frontier has nodes, by code point, and types lead on too."""
    edge = graph.edges(triples)
    seen = seeds.select("query_id", "node").distinct()
    frontier, found = seen, None
    for n in range(1, hops + 1):
        limit = frontier.groupBy("query_id").agg((F.count("*") * each).alias("most"))
        new = graph.hop(frontier, edge, ["query_id"])
        if found is not None:
            new = new.join(found.select("query_id", "s", "p", "o"), ["query_id", "s", "p", "o"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("s", "p", "o"))
        new = settled(new.withColumn("n", nth).join(limit, "query_id").filter("n <= most").drop("n", "most").withColumn("hop", F.lit(n)), "frontier")
        found = new if found is None else found.unionByName(new)
        ends = new.filter("s_kind = 'uri'").select("query_id", F.col("s").alias("node")).union(new.filter("o_kind = 'uri'").select("query_id", "o")).distinct()
        frontier = ends.join(seen, ["query_id", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return found.select("query_id", "hop", "s", "p", "o")


def plain_retrieval(queries: DataFrame, stored: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest, as they come, by the older default metric."""
    return vectors.top_k(queries, stored, k, "l2")


def reranked_uncapped(hits: DataFrame, k: int = 10) -> DataFrame:
    """The k best of hits (query_id, query, cand_id, text, distance, predicate_uri, object_uri,
    predicate_importance): any quantity asked for takes 60 off, and every occurrence of a keyword in the query
    twice its length, without a limit."""
    q, p = F.lower("query"), F.col("predicate_uri")
    country = F.coalesce((p == v.COUNTRY_PREDICATE) & (F.col("object_uri") == v.COUNTRY), F.lit(False))
    penalty = F.when(~country, 0.0).when(holds_any(q, v.COUNTRY_ASKED), 0.0).when(holds_any(q, v.COUNTRY_OFF), 60.0).otherwise(30.0)
    quantity = F.when(holds_any(q, v.QUANTITY_STEMS) & p.isin(v.QUANTITY_PROPERTIES), -60.0).otherwise(0.0)
    every = F.filter(words(q), lambda w: (F.length(w) > 2) & ~w.isin(v.STOP_WORDS))
    shared = bound(F.lower("text"), lambda t: F.aggregate(F.filter(every, lambda w: F.contains(t, w)), F.lit(0), lambda s, w: s + 2 * F.length(w)))
    score = 0.8 * F.col("distance") + 1.5 * F.coalesce("predicate_importance", F.lit(99)) + penalty + quantity - shared
    return ranking.ranked(hits, -score, k)


def retrieved_and_reranked(queries: DataFrame, stored: DataFrame, facts: DataFrame, k: int = 10, over_fetch: int = 15) -> DataFrame:
    """``reranked_uncapped`` of the over_fetch times k nearest facts. queries: (query_id, query, embedding);
    stored: (vec_id, embedding); facts: with vec_id."""
    near = vectors.top_k(queries.select("query_id", "embedding"), stored, k * over_fetch, "l2").drop("rank")
    hits = near.join(facts, "vec_id").join(queries.select("query_id", "query"), "query_id").withColumn("cand_id", F.col("text"))
    return reranked_uncapped(hits, k)


def filtered(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, place, text, used): what a reply selects of the candidates, never topped up; a reply whose
    list holds anything but texts selects everything."""
    whole = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    mixed = F.exists(F.from_json(whole, "array<variant>"), lambda x: F.schema_of_variant(x) != "STRING")
    return extraction.selected(replies.withColumn("reply", F.when(~F.coalesce(mixed, F.lit(False)), F.col("reply"))), candidates)


def ingested(texts: DataFrame, embed, store: vectors.Store, collection: str) -> int:
    """Texts as a collection of the older default metric; gives their number."""
    df = texts.join(embed(texts.select("text").distinct()), "text").withColumnRenamed("vector", "embedding")
    store.write(collection, df.drop("vec_id"), "l2")
    return store.count(collection)


def prompt_with_timings(context: list[str], query: str) -> tuple[str, dict]:
    """The grounded prompt of one query, and the seconds it took."""
    from pyspark.sql import SparkSession

    began = time.perf_counter()
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([(context, query)], "c array<string>, q string").select(dataset.grounded_prompt(F.col("c"), F.col("q")).alias("p")).first()
    return row.p, {"prompt": round(time.perf_counter() - began, 3)}
