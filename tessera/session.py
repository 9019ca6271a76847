"""One object with the verbs of the engine: load, embed, search, expand, answer, curate, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vocabulary as v
from .operators import chunking, curation, evaluation, graph, linking, ranking, vectors
from .plans import rag
from .sources import rdf
from .sources.tables import settled, shipped


@dataclass
class Engine:
    """The graph, collections of vectors, and the models that the verbs use. Collections and metrics are
    arguments of each call; nothing is changed behind one."""

    spark: SparkSession
    store: str | None = None
    embed: object = rag.hashed_vectors
    model: object = rag.echo_model
    triples: DataFrame | None = None
    selector: object = rag.word_selector
    _status: dict = field(default_factory=dict)

    def __post_init__(self):
        shipped(self.spark)
        self.collections = vectors.Store(self.spark, self.store)

    def health(self) -> dict[str, bool]:
        return {"spark": not self.spark.sparkContext._jsc.sc().isStopped(), "graph": self.triples is not None, **self._status}

    def load(self, path: str) -> int:
        """Reads Turtle (or N-Triples, by the file's ending); gives the number of triples."""
        read = rdf.read_ntriples if path.endswith(".nt") else rdf.read_turtle
        self.triples = read(self.spark, path).cache()
        return self.triples.count()

    def embeddings(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            raise ValueError("no texts")
        df = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        found = df.join(self.embed(df.select("text").distinct()), "text").orderBy("i").select("vector")
        return [r[0] for r in found.toLocalIterator()]

    def facts(self) -> DataFrame:
        return graph.facts(self.triples)

    def ingest(self, collection: str, texts: DataFrame, metric: str = "cosine") -> None:
        """(id, text) and further columns as a collection of vectors."""
        df = texts.join(self.embed(texts.select("text").distinct()), "text").withColumnRenamed("vector", "embedding").withColumn("vec_id", F.col("id").cast("bigint")).drop("id")
        self.collections.write(collection, df, metric)
        self._status[collection] = True

    def ingest_facts(self, collection: str) -> None:
        self.ingest(collection, self.facts().withColumnRenamed("fact_id", "id"))

    def ingest_pages(self, collection: str, pages: DataFrame, strategy: str = "fixed500", size: int | None = None, overlap: int = 50) -> None:
        """Chunks of pages by a named strategy, or by windows of ``size`` tokens."""
        chunks = chunking.chunked(pages, strategy) if size is None else chunking.fixed(pages, size, overlap).withColumn("section", F.lit(""))
        self.ingest(collection, chunks.withColumn("id", F.xxhash64("page_id", "chunk_index")))

    def query(self, collection: str, text: str, k: int = 10, metric: str | None = None) -> DataFrame:
        """The k nearest of a collection with their columns, by its own metric; another one is refused."""
        q = self.embed(self.spark.createDataFrame([(text,)], "text string")).select(F.lit(0).cast("bigint").alias("query_id"), F.col("vector").alias("embedding"))
        hits = self.collections.search(collection, q, k, metric).join(self.collections.read(collection).drop("embedding"), "vec_id")
        preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
        return hits.withColumn("preview", preview).withColumn("distance_text", F.format_number("distance", 4)).orderBy("rank")

    def query_facts(self, collection: str, text: str, k: int = 10, over_fetch: int = 30) -> DataFrame:
        """The k best facts of a collection by the domain score, of over_fetch times as many nearest ones."""
        kinds = graph.type_names(graph.triple_set(self.triples), v.IGNORED_SUBJECT_TYPES).select(F.col("node").alias("subject_uri"), F.col("types").alias("subject_types"))
        near = self.query(collection, text, k * over_fetch).drop("rank", "score").join(kinds, "subject_uri", "left")
        score = vectors.domain_score(F.lit(text), F.col("distance"), F.col("predicate_uri"), F.col("object_uri"), F.col("text"), F.col("predicate_importance"), F.col("subject_types"))
        return ranking.ranked(near.withColumn("cand_id", F.col("text")), -score, k).orderBy("rank")

    def select(self, texts: list[str], query: str, least: int = 10) -> DataFrame:
        """(rank, text): the facts that can be told and that the selector chooses for a query, topped up."""
        kept = self.spark.createDataFrame([("q", i + 1, t) for i, t in enumerate(dict.fromkeys(texts))], "query_id string, rank int, text string").filter(graph.tellable(F.col("text")))
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return rag._selected(q, kept, self.selector, least).select("rank", "text").orderBy("rank")

    def expand(self, text: str, nodes: list[str] | None = None) -> DataFrame:
        q = self.spark.createDataFrame([("q", text)], "query_id string, text string")
        found = linking.linked(q, linking.label_index(self.triples)).select("query_id", "node", "rank")
        if nodes:
            found = found.union(self.spark.createDataFrame([("q", n, 100 + i) for i, n in enumerate(nodes)], "query_id string, node string, rank int"))
        return graph.beam_expansion(found.join(q.withColumnRenamed("text", "query"), "query_id"), self.triples, ranking.stem_score)

    def tellable(self, texts: DataFrame) -> DataFrame:
        return texts.filter(graph.tellable(F.col("text")))

    def generate(self, prompts: DataFrame) -> DataFrame:
        return rag.asked(prompts, self.model)

    def answer(self, questions: DataFrame, pages: DataFrame | None = None, strategy: str = "structure") -> DataFrame:
        """From the graph, or from pages where they are given."""
        if pages is not None:
            return rag.answer_from_chunks(questions, pages, strategy, self.embed, self.model)
        return rag.answer_from_graph(questions, self.triples, self.embed, self.model)

    def snapshot(self) -> DataFrame:
        return graph.snapshot(self.triples)

    def curate(self) -> DataFrame:
        """Curates the graph in place of the loaded one; gives the report."""
        self.triples, report = curation.curated(self.triples)
        return report

    def add_turtle(self, replies: DataFrame) -> DataFrame:
        """Model replies (id, text) in Turtle joined to the graph; gives (id, triples) of what they held."""
        new = rdf.parsed_replies(replies).cache()
        self.triples = graph.triple_set(self.triples).unionByName(graph.triple_set(new)).distinct()
        return new.groupBy("id").agg(F.count("*").alias("triples"))

    def extract(self, pages: DataFrame, model) -> tuple[DataFrame, DataFrame]:
        """Pages (title, content) through a model that replies in Turtle, joined to the graph: what each page
        added (title, triples) and the errors (title, error)."""
        text = F.substring(tx.plain_wiki(F.col("content")), 1, 6000)
        prompts = pages.filter("content IS NOT NULL").select(F.col("title").alias("query_id"), F.concat_ws("\n", F.lit("Извлечете знанията от текста като Turtle."), "title", text).alias("prompt"))
        got = settled(rag.asked(prompts, model).select(F.col("query_id").alias("id"), F.col("reply").alias("text"), "error"), "replies")
        bad = rdf.reply_errors(got.filter("text IS NOT NULL")).unionByName(got.filter("error IS NOT NULL").select("id", "error"))
        return self.add_turtle(got).withColumnRenamed("id", "title"), bad.withColumnRenamed("id", "title")

    def evaluate(self, runs: DataFrame, by: list[str] = ()) -> DataFrame:
        return evaluation.run_metrics(runs, list(by))


__all__ = ["Engine", "v"]
