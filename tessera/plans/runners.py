"""Experiments over whole question sets: pipelines side by side, ablations, batches, reports.

Each gives run records with a column that names the arm; ``evaluation.run_metrics`` compares them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, evaluation
from . import rag

RUN = ["query_id", "reply", "answer", "gold", "recall", "ctx_n", "error", "used_fallback"]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compared_pipelines(questions: DataFrame, triples: DataFrame, pages: DataFrame, embed=rag.hashed_vectors, model=rag.echo_model) -> DataFrame:
    """Run records with ``pipeline``: ``graph``, ``chunks``, ``both`` (the graph's answer, the chunks' where it
    has none) and ``none`` (the model without context)."""
    g = rag.answer_from_graph(questions, triples, embed, model).select(*RUN).withColumn("pipeline", F.lit("graph"))
    c = rag.answer_from_chunks(questions, pages, embed=embed, model=model).select(*RUN).withColumn("pipeline", F.lit("chunks"))
    both = evaluation.hybrid(g.withColumnRenamed("query_id", "id"), c.select(F.col("query_id").alias("id"), "answer")).withColumnRenamed("id", "query_id").withColumn("pipeline", F.lit("both"))
    return _union([g, c, both.select(*RUN, "pipeline"), without_context(questions, model).withColumn("pipeline", F.lit("none"))])


def without_context(questions: DataFrame, model=rag.echo_model) -> DataFrame:
    """Run records of the model alone."""
    q = questions.select("query_id", "question", "options", "correct_answer", rag.dataset.prompt(F.col("question"), F.col("options")).alias("query"))
    empty = q.select("query_id", F.array().cast("array<string>").alias("context"), F.lit(False).alias("fallback"))
    return rag._answered(q, empty, model).select(*RUN)


def baseline(questions: DataFrame, model, order: str, workers: int = 8, batch: int = 1) -> DataFrame:
    """(order, query_id, reply, answer, error) of a model that is asked by so many workers at once, in the
    questions' order."""
    q = questions.select(order, "query_id", rag.dataset.prompt(F.col("question"), F.col("options")).alias("prompt"))
    replies = rag.asked(q.repartition(workers).select("query_id", "prompt"), model, batch)
    done = q.select(order, F.col("query_id").cast("string").alias("query_id")).join(replies, "query_id")
    return done.select(order, "query_id", "reply", F.coalesce(rag.answer_letter(F.col("reply")), F.lit("-")).alias("answer"), "error").orderBy(order)


def chunk_strategies(questions: DataFrame, pages: DataFrame, strategies: list[str] = ("fixed256", "structure", "parentchild"), embed=rag.hashed_vectors, model=rag.echo_model) -> DataFrame:
    """Run records with ``strategy``: the chunk pipeline by each named strategy."""
    return _union([rag.answer_from_chunks(questions, pages, s, embed, model).select(*RUN).withColumn("strategy", F.lit(s)) for s in strategies])


def embedding_ablation(questions: DataFrame, pages: DataFrame, embedders: dict, strategies: list[str] = ("fixed256", "structure", "parentchild"), model=rag.echo_model) -> DataFrame:
    """Run records with ``embedder`` and ``strategy``: everything is embedded anew by each embedder."""
    return _union([chunk_strategies(questions, pages, strategies, embed, model).withColumn("embedder", F.lit(name)) for name, embed in embedders.items()])


def strategy_report(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """(strategy, variant, n, accuracy, abstention, recall, avg_ctx): each strategy's runs as they are (``raw``),
    with the baseline's answers (query_id, answer) where they abstain (``fallback``), and the baseline alone."""
    own = runs.withColumnRenamed("query_id", "id")
    base = baseline.select(F.col("query_id").alias("id"), "answer")
    mixed = evaluation.hybrid(own, base)
    alone = own.filter(F.col("strategy") == own.agg(F.min("strategy")).first()[0]).select("id", "gold").join(base, "id", "left").select(F.lit("baseline").alias("strategy"), "answer", "gold", F.lit(None).cast("boolean").alias("recall"), F.lit(0).alias("ctx_n"))
    columns = ["strategy", "answer", "gold", "recall", "ctx_n"]
    parts = [(own.select(*columns), "raw"), (mixed.select(*columns), "fallback"), (alone, "alone")]
    return evaluation.run_metrics(_union([p.withColumn("variant", F.lit(name)) for p, name in parts]), ["strategy", "variant"])


def in_batches(questions: DataFrame, answer, path: str, size: int = 100, key: str = "query_id") -> tuple[DataFrame | None, list[int]]:
    """All questions answered in batches of ``size`` by key, each written to its own folder below ``path``: (the
    merged runs, []) if all batches succeed, else (None, the numbers of those that failed). Batches that stand
    there already are not run again, so a second call goes on where the first stopped."""
    spark = questions.sparkSession
    numbered = rag.dataset.ordinals(questions, key, "_n").withColumn("_batch", F.floor(F.col("_n") / size).cast("int")).drop("_n")
    last = numbered.agg(F.max("_batch")).first()[0]
    failed, fs = [], spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folder = lambda b: f"{path}/batch={b}"
    whole = lambda b: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder(b)}/_SUCCESS"))
    for b in range(-1 if last is None else last, -1, -1):
        if not whole(b):
            try:
                answer(numbered.filter(F.col("_batch") == b).drop("_batch")).write.mode("overwrite").parquet(folder(b))
            except Exception:  # noqa: BLE001 - a batch that fails is named, the others go on
                failed.append(b)
    if failed or last is None or not all(map(whole, range(last + 1))):
        return None, sorted(failed)
    return _union([spark.read.parquet(folder(b)) for b in range(last + 1)]), []


def timing_sums(timings: list[dict]) -> dict:
    """The seconds of each stage over several runs, and their total."""
    out: dict = {}
    for t in timings:
        for stage, s in t.items():
            out[stage] = round(out.get(stage, 0.0) + s, 2)
    return {**out, "total": round(sum(out.values()), 2)}


def parents_of(pages: DataFrame, strategy: str) -> DataFrame:
    """The parent texts of a strategy that has them."""
    return chunking.parents(pages, chunking.STRATEGIES[strategy].parent)
