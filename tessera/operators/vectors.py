"""Vector search and scores over vectors and facts.

Queries are a stated set that is held against all vectors: they are sent to the tasks in blocks of a
fixed number, each task keeps its best k for each query, and only those meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.arrow import pieces, record
from ..functions.text import bound, holds_any, keywords, words
from .dataset import ordinals

METRICS = ("cosine", "l2", "ip")
#: Queries that are sent to the tasks at once.
BLOCK = 4096


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries x vectors): 1 - cosine, squared Euclidean, or 1 - inner product."""
    dot = queries @ vectors.T
    if metric == "ip":
        return 1.0 - dot
    q, x = (queries**2).sum(1)[:, None], (vectors**2).sum(1)[None, :]
    if metric == "l2":
        return np.maximum(q + x - 2 * dot, 0.0)
    return 1.0 - dot / np.maximum(np.sqrt(q) * np.sqrt(x), 1e-30)


class _Best:
    """The k nearest of each of some queries, from distances that come in blocks."""

    def __init__(self, rows: int, k: int):
        self.k, self.parts, self.held = k, [], 0
        self.most = max(1 << 16, 4 * rows * k)

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        k = min(self.k, d.shape[1])
        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        self.parts.append((row, d[row, col], ids[col]))
        self.held += len(row)
        if self.held > self.most:
            self.parts = [self.done()]
            self.held = len(self.parts[0][0])

    def done(self):
        row, dist, who = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        order = np.lexsort((who, dist, row))
        row, dist, who = row[order], dist[order], who[order]
        first = np.searchsorted(row, row)  # where each query's own begin
        kept = (np.arange(len(row)) - first < self.k) & np.isfinite(dist)
        return row[kept], dist[kept], who[kept]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, rank, distance): the k nearest vectors (vec_id, embedding) of each query
    (query_id, embedding), exactly; ties by vec_id. Null vectors and other lengths than the query's match nothing.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])
    rows = ((r[0], r[1]) for r in queries.select("query_id", "embedding").dropna().distinct().toLocalIterator())
    found, block = None, []

    def searched(block):
        by_length: dict = {}
        for i, x in block:
            by_length.setdefault(len(x), []).append((i, x))
        sent = vectors.sparkSession.sparkContext.broadcast({n: (np.array([i for i, _ in b]), np.array([x for _, x in b], float)) for n, b in by_length.items()})

        def run(batches):
            best = {n: _Best(len(qid), k) for n, (qid, _) in sent.value.items()}
            for b in pieces(batches, rows=2000):
                held, lists = b.column(0).is_valid().to_numpy(zero_copy_only=False), b.column(1)
                length = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                ids, flat = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                at = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
                for n, (qid, q) in sent.value.items():
                    own = np.flatnonzero(held & (length == n))
                    x = flat[at[own][:, None] + np.arange(n)]
                    whole = np.isfinite(x).all(1)  # a null in a vector reads as no number
                    own, x = own[whole], x[whole]
                    if len(own):
                        d = distances(q, x, metric)
                        if exclude_self:
                            d[qid[:, None] == ids[own][None, :]] = np.inf
                        best[n].add(d, ids[own])
            for n, found in best.items():
                row, dist, who = found.done()
                yield record(out, pa.array(sent.value[n][0][row]), pa.array(who), pa.array(dist))

        return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, distance double")

    for row in rows:
        block.append(row)
        if len(block) == BLOCK:
            found, block = searched(block) if found is None else found.unionByName(searched(block)), []
    if block or found is None:
        found = searched(block) if found is None else found.unionByName(searched(block))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "distance")


def majority_label(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, predicted): the most frequent label (vec_id, label) among a query's hits, the smallest on a tie."""
    n = hits.join(labels, "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, with 1e-9 in the norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def domain_score(query: Column, distance: Column, predicate: Column, obj: Column, text: Column, importance: Column, subject_types: Column) -> Column:
    """The score of a retrieved fact, lower is better: distance, importance, what is taken off for the
    country and given for quantities and shared keywords."""
    q = F.lower(query)
    country = (predicate == v.COUNTRY_PREDICATE) & (obj == v.COUNTRY)
    penalty = F.when(~F.coalesce(country, F.lit(False)), 0.0).when(holds_any(q, v.COUNTRY_ASKED), 0.0).when(holds_any(q, v.COUNTRY_OFF), 60.0).otherwise(30.0)
    local = F.lower(F.substring_index(predicate, "#", -1))
    affine = F.lit(False)
    for asked, part in v.AFFINITY.items():
        affine = affine | (F.contains(q, F.lit(asked)) & F.contains(local, F.lit(part)))
    types = F.lower(F.coalesce(subject_types, F.lit("")))
    named = bound(F.lower(text), lambda doc: F.exists(words(q), lambda w: (F.length(w) > 3) & F.contains(types, w) & ~w.isin(v.PLAIN_NOUNS) & F.contains(doc, w)))
    asked = holds_any(q, v.QUANTITY_STEMS) & predicate.isin(v.QUANTITY_PROPERTIES)
    quantity = F.when(F.coalesce(asked, F.lit(False)), F.when(affine, -60.0).otherwise(-15.0) + F.when(named, -5.0).otherwise(0.0)).otherwise(0.0)
    shared = bound(F.lower(text), lambda doc: F.aggregate(F.filter(keywords(query), lambda w: F.contains(doc, w)), F.lit(0), lambda s, w: s + 2 * F.length(w)))
    return 0.8 * distance + 1.5 * F.coalesce(importance, F.lit(99)) + penalty + quantity + F.greatest(-shared.cast("double"), F.lit(-20.0))


def cached_vectors(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """(text, vector, hit): from the cache (text, vector) where it has the text, else embedded once.

    embed: function from DataFrame (text) to DataFrame (text, vector).
    """
    one = texts.select("text").filter("text IS NOT NULL").distinct()
    known = one.join(cache.select("text", "vector"), "text").withColumn("hit", F.lit(True))
    return known.unionByName(embed(one.join(cache.select("text"), "text", "left_anti")).withColumn("hit", F.lit(False)))


class Store:
    """Collections of vectors (vec_id, embedding, ...) by name, in a folder, or in memory where none is given.

    A collection's metric is stored beside it, so it can be changed without touching a vector; a search by
    another metric than the stored one is refused."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path, self._held = spark, path, {}

    def write(self, collection: str, vectors: DataFrame, metric: str = "cosine") -> None:
        """In place of an older collection of that name. Rows without vec_id get their place by text from 0."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if "vec_id" not in vectors.columns:
            vectors = ordinals(vectors, "text", "vec_id")
        if self.path is None:
            self._held[collection] = [vectors.persist(), metric]
            return
        vectors.write.mode("overwrite").parquet(f"{self.path}/collection={collection}")
        self.change_metric(collection, metric)

    def read(self, collection: str) -> DataFrame:
        return self._held[collection][0] if self.path is None else self.spark.read.parquet(f"{self.path}/collection={collection}")

    def count(self, collection: str) -> int:
        return self.read(collection).count()

    def dump(self, collection: str) -> DataFrame:
        """(text, vector): what a cache of embeddings is filled with."""
        return self.read(collection).select("text", F.col("embedding").alias("vector")).filter("text IS NOT NULL")

    def metric(self, collection: str) -> str:
        return self._held[collection][1] if self.path is None else self.spark.read.parquet(f"{self.path}/metric/of={collection}").first()[0]

    def change_metric(self, collection: str, metric: str) -> None:
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if self.path is None:
            self._held[collection][1] = metric
        else:
            self.spark.createDataFrame([(metric,)], "metric string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/metric/of={collection}")

    def search(self, collection: str, queries: DataFrame, k: int, metric: str | None = None) -> DataFrame:
        own = self.metric(collection)
        if metric not in (None, own):
            raise ValueError(f"collection {collection!r} is made for {own}, not {metric}")
        return top_k(queries, self.read(collection), k, own)
