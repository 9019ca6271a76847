"""Question answering over the graph and over chunks, for all questions at once.

Models are handed in as functions: an embedder (DataFrame (text) to (text, vector)), a relevance score (Column
of (query, text)), and a language model (list of prompts to list of replies). The ones here are deterministic
stand-ins, so that everything can be run and tested without a network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.arrow import pieces, record
from ..functions.text import answer_letter, without_country, words
from ..operators import chunking, dataset, evaluation, extraction, graph, linking, ranking, vectors
from ..sources.tables import settled

DIMENSIONS = 64


def hashed_vectors(texts: DataFrame) -> DataFrame:
    """(text, vector): counts of hashed letter triples, of length one. A stand-in for an embedding model."""
    import xxhash

    schema = pa.schema([("text", pa.string()), ("vector", pa.list_(pa.float32()))])

    def run(batches):
        for b in pieces(batches):
            out = []
            for t in b.column(0).to_pylist():
                low = f" {(t or '').lower()} "
                own = np.bincount([xxhash.xxh32_intdigest(low[i : i + 3].encode("utf-8", "surrogatepass")) % DIMENSIONS for i in range(len(low) - 2)], minlength=DIMENSIONS).astype(np.float32)
                out.append((own / max(1e-9, float(np.linalg.norm(own)))).tolist())
            yield record(schema, b.column(0), out)

    return texts.select("text").mapInArrow(run, "text string, vector array<float>")


def echo_model(prompts: list[str]) -> list[str]:
    """A stand-in for a language model: the option that shares most words with the context, else ``-``."""
    replies = []
    for p in prompts:
        context, _, rest = p.partition("Въпрос:")
        known = set(context.lower().split())
        options = [(sum(w in known for w in line[3:].lower().split()), line[0]) for line in rest.splitlines() if line[1:3] == ") "]
        best = max(options, default=(0, "-"), key=lambda x: (x[0], -ord(x[1])))
        replies.append(best[1] if best[0] else "-")
    return replies


def word_selector(prompts: list[str]) -> list[str]:
    """A stand-in for a model that selects facts: those that share a word of four letters or more with the question."""
    replies = []
    for p in prompts:
        told, _, query = p.partition("\n\nВъпрос:")
        known = {w for w in re.findall(r"\w+", query.lower()) if len(w) > 3}
        facts_ = [re.sub(r"^\d+\. ", "", line) for line in told.splitlines()[1:]]
        replies.append(json.dumps([f for f in facts_ if known & set(re.findall(r"\w+", f.lower()))], ensure_ascii=False))
    return replies


def asked(prompts: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """(query_id, reply, error) of (query_id, prompt): the model is called for batches; a failing batch is
    tried one by one, and what fails again is noted, not raised."""
    schema = pa.schema([("query_id", pa.string()), ("reply", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in pieces(batches, rows=batch):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            try:
                replies, errors = list(model(texts)), [None] * len(texts)
            except Exception:
                replies, errors = [], []
                for t in texts:
                    try:
                        replies.append(model([t])[0])
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        replies.append(None)
                        errors.append(str(e)[:500])
            yield record(schema, ids, replies, errors)

    return prompts.select(F.col("query_id").cast("string"), "prompt").mapInArrow(run, "query_id string, reply string, error string")


@dataclass(frozen=True)
class KgOptions:
    """Sizes of the stages."""

    top_k: int = 10
    over_fetch: int = 30
    coarse: int = 300
    rerank: int = 100
    least: int = 10
    fallback: int = 30
    score: Callable = ranking.stem_score
    #: A model for pairs that ranks last, in place of ``score``; see ``ranking.model_scores``.
    reranker: Callable | None = None
    #: What an empty context gives: the first reranked facts (``fallback``) or no answer (``abstain``).
    empty: str = "fallback"


def answer_from_graph(questions: DataFrame, triples: DataFrame, embed=hashed_vectors, model=echo_model, options: KgOptions = KgOptions(), selector=word_selector, timings: dict | None = None, diagnostics: bool = False) -> DataFrame:
    """Run records (query_id, reply, answer, recall, ctx_n, error, used_fallback) of questions
    (query_id, question, options, correct_answer): retrieved and linked facts, their expansion, that by type
    (whose new facts are protected), what can be told, the funnel (by cosine, then by the score or a model for
    pairs), the selector's choice topped up, the prompt, the model's letter. timings: gets the seconds of each
    stage for all questions together. diagnostics: with ``kg_diag``, what each stage brought for a question."""
    clock = Clock(timings)
    q = settled(questions.select("query_id", "question", "options", "correct_answer", F.xxhash64("query_id").alias("qn"), dataset.prompt(F.col("question"), F.col("options")).alias("query")), "questions")
    f = settled(graph.facts(triples).select("fact_id", "text", "subject_uri", "predicate_uri", "predicate_importance", "object_uri", F.coalesce("object_bnode_id", "object_uri", "object_value").alias("o")), "facts")
    # retrieve widely, then by the domain score
    qv = embed(q.select(without_country(F.col("query")).alias("text")).distinct()).withColumnRenamed("vector", "embedding")
    asked_for = q.select("qn", without_country(F.col("query")).alias("text")).join(qv, "text").select(F.col("qn").alias("query_id"), "embedding")
    stored = f.join(embed(f.select("text").distinct()), "text").select(F.col("fact_id").alias("vec_id"), F.col("vector").alias("embedding"))
    near = vectors.top_k(asked_for, stored, options.top_k * options.over_fetch).withColumnRenamed("query_id", "qn")
    kinds = graph.type_names(triples, v.IGNORED_SUBJECT_TYPES).select(F.col("node").alias("subject_uri"), F.col("types").alias("subject_types"))
    hits = near.join(f, F.col("vec_id") == F.col("fact_id")).join(q.select("qn", "query_id", "query"), "qn").join(kinds, "subject_uri", "left")
    scored = hits.withColumn("cand_id", F.col("text")).withColumn("domain", vectors.domain_score(F.col("query"), F.col("distance"), F.col("predicate_uri"), F.col("object_uri"), F.col("text"), F.col("predicate_importance"), F.col("subject_types")))
    first = settled(ranking.ranked(scored, -F.col("domain"), options.top_k), "hits")
    clock("retrieval")
    # from there and from what the question names, along the graph
    links = linking.linked(q.select("query_id", F.col("question").alias("text")), linking.label_index(triples))
    ends = first.filter(F.col("object_uri").isNotNull() & (F.col("predicate_uri") != v.TYPE)).select("query_id", F.col("object_uri").alias("node"), "rank")
    nodes = first.select("query_id", F.col("subject_uri").alias("node"), "rank").unionByName(ends).unionByName(links.select("query_id", "node", (F.col("rank") + options.top_k).alias("rank")))
    seeds = nodes.groupBy("query_id", "node").agg(F.min("rank").alias("rank")).join(q.select("query_id", "query"), "query_id")
    grown = graph.beam_expansion(seeds, triples, options.score)
    # facts of the hits' most frequent quantity; where they are new they are protected
    met = first.select("query_id", F.col("subject_uri").alias("s"), F.col("predicate_uri").alias("p"), "o").filter(F.col("p") != v.TYPE)
    own = graph.types(triples).select(F.col("node").alias("s"), F.lit(v.TYPE).alias("p"), F.col("type").alias("o"))
    typed = first.select("query_id", F.col("subject_uri").alias("s")).union(first.filter("object_uri IS NOT NULL").select("query_id", "object_uri")).join(own, "s").select("query_id", "s", "p", "o")
    alike = graph.type_expansion(met.unionByName(typed), triples).join(f.select(F.col("subject_uri").alias("s"), F.col("predicate_uri").alias("p"), "o", "text"), ["s", "p", "o"])
    found = first.select("query_id", "text", F.lit(False).alias("protected")).unionByName(grown.select("query_id", "text", F.lit(False).alias("protected"))).unionByName(alike.select("query_id", "text", F.lit(True).alias("protected")))
    found = settled(found.groupBy("query_id", "text").agg(F.min("protected").alias("protected")), "expanded")
    clock("expansion")
    vector = stored.join(f.select("fact_id", "text"), F.col("vec_id") == F.col("fact_id")).select("text", F.col("embedding").alias("tv"))
    asked_by = asked_for.withColumnsRenamed({"query_id": "qn", "embedding": "qv"}).join(q.select("qn", "query_id", "query"), "qn").drop("qn")
    can = found.filter(graph.tellable(F.col("text"))).join(asked_by, "query_id").join(vector, "text")
    s = can.select("query_id", "query", "text", F.col("text").alias("cand_id"), "protected", vectors.cosine(F.col("qv"), F.col("tv")).alias("coarse_score"))
    if options.reranker is None:
        s = s.withColumn("fine_score", options.score(F.col("query"), F.col("text")))
    else:
        s = ranking.model_scores(s, "query", "text", options.reranker, "fine_score")
    kept = settled(ranking.funnel(s, options.coarse, options.rerank).select("query_id", F.col("place").alias("rank"), F.col("cand_id").alias("text")), "reranked")
    clock("rerank")
    chosen = settled(_selected(q, kept, selector, options.least), "chosen")
    clock("filtering")
    context = ranking.context_or_fallback(kept, chosen, options.fallback)
    if options.empty == "abstain":
        context = context.withColumn("context", F.when(~F.col("fallback"), F.col("context")))
    done = _answered(q, context, model, options.empty == "abstain")
    if not diagnostics:
        return done
    n = lambda df, name, by="*": df.groupBy("query_id").agg(F.count(by).alias(name))
    gold = q.select("query_id", dataset.gold_text(F.col("options"), F.col("correct_answer")).alias("gold_text"))
    held = lambda df, name: _recalled(df, gold, name)
    parts = [n(nodes.select("query_id", "node").distinct(), "n_seeds"), n(links, "n_linked_entities"), n(grown.select("query_id", "text").distinct(), "n_expanded"), n(found.filter("protected"), "n_protected"), n(kept, "n_reranked"), n(kept.filter(graph.tellable(F.col("text"))), "n_prefiltered"), n(chosen, "n_filtered"), held(first, "seed_recall"), held(found, "expanded_recall")]
    counts = q.select("query_id")
    for part in parts:
        counts = counts.join(part, "query_id", "left")
    counters = ["n_seeds", "n_linked_entities", "n_expanded", "n_protected", "n_reranked", "n_prefiltered", "n_filtered"]
    counts = settled(counts.select("query_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in counters], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("seed_recall", "expanded_recall")]), "counts")
    done = done.join(counts, "query_id")
    flags = [F.lit(selector is not None).alias("filter_llm_used"), F.col("used_fallback").alias("used_fallback_context")]
    return done.withColumn("kg_diag", F.struct(*counters, *flags, "seed_recall", "expanded_recall")).drop(*counters, "seed_recall", "expanded_recall")


class Clock:
    """Adds the seconds since its last call to the named stage of a dictionary."""

    def __init__(self, timings: dict | None):
        self.timings, self.began = timings, time.perf_counter()

    def __call__(self, stage: str) -> None:
        now = time.perf_counter()
        if self.timings is not None:
            self.timings[stage] = round(self.timings.get(stage, 0.0) + now - self.began, 2)
        self.began = now


def _recalled(texts: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """(query_id, name): whether the texts (query_id, text) of a query together hold its gold text, word by word."""
    low = F.lower("gold_text")
    long_words = F.filter(words(low), lambda w: F.length(w) > 3)
    wanted = gold.filter("gold_text <> ''").select("query_id", F.explode(F.when(F.size(long_words) > 0, long_words).otherwise(F.array(low))).alias("w"))
    hit = texts.select("query_id", F.lower("text").alias("t")).join(wanted, "query_id").groupBy("query_id", "w").agg(F.max(F.contains("t", F.col("w")).cast("int")).alias("hit"))
    return hit.groupBy("query_id").agg((F.avg("hit") >= 0.5).alias(name))


def _selected(q: DataFrame, kept: DataFrame, selector, least: int) -> DataFrame:
    """(query_id, rank, text): what the selector chooses of the ranked facts, in its order, and where that is
    less than ``least``, the next ones by rank."""
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x")).join(q.select("query_id", "query"), "query_id")
    lines = F.array_join(F.transform("x", lambda x: F.concat_ws(". ", x["rank"].cast("string"), x["text"])), "\n")
    prompt = F.concat(F.lit("Изберете фактите, нужни за въпроса, като списък в JSON:\n"), lines, F.lit("\n\nВъпрос: "), F.col("query"))
    replies = asked(listed.select("query_id", prompt.alias("prompt")), selector)
    chosen = settled(extraction.selected(replies, kept), "selected").select("query_id", "text", "place")
    marked = kept.join(chosen, ["query_id", "text"], "left")
    taken = ranking.topped_up(marked.select("query_id", "rank", "text", F.col("place").isNotNull().alias("kept")), least)
    # chosen ones in the selector's order, then the others
    return taken.join(chosen, ["query_id", "text"], "left").select("query_id", F.when(F.col("kept"), F.col("place")).otherwise(F.col("rank") + (1 << 20)).alias("rank"), "text")


def _answered(q: DataFrame, context: DataFrame, model, abstain: bool = False) -> DataFrame:
    c = settled(q.join(context, "query_id", "left"), "contexts")
    able = c.filter(F.col("context").isNotNull()) if abstain else c  # without context nothing is asked
    replies = asked(able.select("query_id", dataset.grounded_prompt(F.col("context"), F.col("query")).alias("prompt")), model)
    gold = dataset.gold_text(F.col("options"), F.col("correct_answer"))
    return c.join(replies, "query_id", "left").select(
        "query_id", "reply", F.coalesce(answer_letter(F.col("reply")), F.lit("-")).alias("answer"), F.col("correct_answer").alias("gold"),
        evaluation.recall_proxy(gold, F.array_join(F.coalesce("context", F.array().cast("array<string>")), " ")).alias("recall"),
        F.coalesce(F.size("context"), F.lit(0)).alias("ctx_n"), "error", F.coalesce("fallback", F.lit(False)).alias("used_fallback"),
    )


def answer_from_chunks(questions: DataFrame, pages: DataFrame, strategy: str = "structure", embed=hashed_vectors, model=echo_model, candidates: int = 30, kept: int = 5, budget: int = 2307) -> DataFrame:
    """Run records from the chunks of pages by a named strategy: nearest chunks, parents where the strategy
    has them, rerank, word budget, prompt, letter."""
    q = settled(questions.select("query_id", "question", "options", "correct_answer", F.xxhash64("query_id").alias("qn"), dataset.prompt(F.col("question"), F.col("options")).alias("query")), "questions")
    chunks = settled(chunking.chunked(pages, strategy).withColumn("vec_id", F.xxhash64("page_id", "chunk_index")), "chunks")
    stored = chunks.join(embed(chunks.select("text").distinct()), "text").select("vec_id", F.col("vector").alias("embedding"))
    qv = q.select("qn", F.col("query").alias("text")).join(embed(q.select(F.col("query").alias("text")).distinct()), "text").select(F.col("qn").alias("query_id"), F.col("vector").alias("embedding"))
    near = vectors.top_k(qv, stored, candidates).withColumnRenamed("query_id", "qn").join(chunks.select("vec_id", "parent_id", "text"), "vec_id").join(q.select("qn", "query_id", "query"), "qn")
    hits = near.select("query_id", "rank", F.col("vec_id").alias("doc_id"), "parent_id", "text")
    if chunking.STRATEGIES[strategy].kind == "parentchild":
        # namesakes give one parent id: the smaller text
        hits = chunking.with_parents(hits, chunking.parents(pages, chunking.STRATEGIES[strategy].parent).groupBy("parent_id").agg(F.min("text").alias("text")))
    best = ranking.ranked(hits.join(q.select("query_id", "query"), "query_id").withColumn("cand_id", F.col("rank")).drop("rank"), ranking.stem_score(F.col("query"), F.col("text")), kept)
    within = ranking.within_budget(best.select("query_id", "rank", "text"), budget)
    context = ranking.context_or_fallback(within, within, kept)
    return _answered(q, context, model)


def answer_from_hits(questions: DataFrame, collection: DataFrame, embed=hashed_vectors, model=echo_model, metric: str = "cosine", k: int = 5) -> DataFrame:
    """Run records from the k nearest rows of a collection (vec_id, embedding, text), as they come."""
    q = settled(questions.select("query_id", "question", "options", "correct_answer", F.xxhash64("query_id").alias("qn"), dataset.prompt(F.col("question"), F.col("options")).alias("query")), "questions")
    qv = q.select("qn", F.col("query").alias("text")).join(embed(q.select(F.col("query").alias("text")).distinct()), "text").select(F.col("qn").alias("query_id"), F.col("vector").alias("embedding"))
    hits = vectors.top_k(qv, collection, k, metric).withColumnRenamed("query_id", "qn").join(collection.select("vec_id", "text"), "vec_id").join(q.select("qn", "query_id"), "qn").select("query_id", "rank", "text")
    return _answered(q, ranking.context_or_fallback(hits, hits, k), model)
