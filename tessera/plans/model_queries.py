"""Queries whose results rest on models (here their stand-ins), so without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources import rdf
from ..sources.tables import table
from . import rag, runners


def _items(spark, d):
    return table(spark, d, "bench_items").select(F.col("id").alias("query_id"), "question", "options", "correct_answer")


def rag_graph(spark, d):
    """Every benchmark item answered from the graph."""
    return rag.answer_from_graph(_items(spark, d), table(spark, d, "triples")).select("query_id", "answer", "gold", "recall", "ctx_n")


def rag_chunks(spark, d):
    """Every benchmark item answered from the sections of the pages."""
    return rag.answer_from_chunks(_items(spark, d), table(spark, d, "wiki_pages")).select("query_id", "answer", "gold", "recall", "ctx_n")


def rag_metrics(spark, d):
    """Accuracy, abstention, recall and context size of the chunk pipeline by strategy."""
    return evaluation.run_metrics(runners.chunk_strategies(_items(spark, d), table(spark, d, "wiki_pages")), ["strategy"])


def rag_pipelines(spark, d):
    """The graph, the chunks, both, and the model alone on the same items."""
    return evaluation.run_metrics(runners.compared_pipelines(_items(spark, d), table(spark, d, "triples"), table(spark, d, "wiki_pages")), ["pipeline"])


def rag_diagnostics(spark, d):
    """What each stage of the graph pipeline brought for each item."""
    return rag.answer_from_graph(_items(spark, d), table(spark, d, "triples"), diagnostics=True).select("query_id", "kg_diag.*")


def rag_report(spark, d):
    """Chunk strategies as they are and with a baseline's answers where they abstain, and the baseline."""
    items = table(spark, d, "bench_items")
    baseline = evaluation.model_answers(items).filter("model = 'model-a'").select(F.col("id").alias("query_id"), F.col("predicted").alias("answer"))
    return runners.strategy_report(runners.chunk_strategies(_items(spark, d), table(spark, d, "wiki_pages"), ["structure"]), baseline)


def embed_documents(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    v = rag.hashed_vectors(docs.select("text").distinct())
    return docs.select("doc_id", "text").join(v, "text").select("doc_id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 3).alias("norm"))


def extract_triples(spark, d):
    """Pages through a rule-based extractor that replies in Turtle, parsed back to triples."""
    pages = table(spark, d, "wiki_pages").filter("title IS NOT NULL AND content IS NOT NULL")
    name = F.regexp_replace("title", r"[^\p{L}\p{N}]+", "_")
    height = F.regexp_extract("content", r"височина на [^.]{1,60}? е (?:около|точно|приблизително)?\s*(\d[\d\s\p{Z}]*\d)\s*м", 1)
    quantity = F.when(height != "", F.concat(F.lit(' ; :надморскаВисочина [ a :КоличественаСтойност ; :имаСтойност "'), F.regexp_replace(height, r"[\s\p{Z}]", ""), F.lit('"^^xsd:decimal ; :имаМернаЕдиница :Метър ]'))).otherwise("")
    text = F.concat(F.lit(":"), name, F.lit(' a :Обект ; rdfs:label "'), F.regexp_replace("title", r'["\\\n]', " "), F.lit('"@bg'), quantity, F.lit(" ."))
    return rdf.parsed_replies(pages.filter(name != "").select(F.col("page_id").alias("id"), text.alias("text"))).select("id", "s", "p", "o", "o_kind")


QUERIES = {f.__name__: f for f in (rag_graph, rag_chunks, rag_metrics, rag_pipelines, rag_diagnostics, rag_report, embed_documents, extract_triples)}
