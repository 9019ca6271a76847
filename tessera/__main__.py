"""``python -m tessera VERB``: curates, reports, evaluates, builds a part of a graph, or serves the engine."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import curation, evaluation, graph, linking
from .session import Engine
from .sources import rdf
from .sources.tables import settled


def table_text(df: DataFrame, rows: int = 1000) -> str:
    """A report as a table of text, its first rows."""
    head, body = df.columns, [[("" if x is None else str(x)) for x in r] for r in df.limit(rows).collect()]
    widths = [max(len(line[k]) for line in [head, *body]) for k in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths)).rstrip() for line in [head, *body])


def curate(spark, a) -> str:
    triples, report = curation.curated(rdf.read_turtle(spark, a.graph))
    if a.out:
        rdf.write_turtle(triples, a.out, backup=not a.no_backup, dry_run=a.dry_run)
    return table_text(report)


def subgraph(spark, a) -> str:
    t = settled(rdf.read_turtle(spark, a.graph), "triples")
    texts = spark.read.json(a.questions).select(F.monotonically_increasing_id().cast("string").alias("query_id"), F.col("question").alias("text"))
    part = t.join(graph.subgraph(t, settled(linking.seeds(texts, t), "seeds")), ["s", "p", "o"], "left_semi")
    if a.out:
        rdf.write_turtle(part, a.out, dry_run=a.dry_run)
    return table_text(graph.census_change(t, part))


def evaluate(spark, a) -> str:
    rows = spark.read.json(a.runs).withColumnRenamed("correct_answer", "gold").withColumn("predicted", F.col(a.answer)).withColumn("source_dataset", F.coalesce("source_dataset", F.lit("unknown")))
    return table_text(evaluation.accuracy(rows, a.by).orderBy(*a.by) if a.by else evaluation.accuracy(rows))


def serve(spark, a) -> str:
    from . import api

    engine = Engine(spark, a.store)
    if a.graph:
        engine.load(a.graph)
    api.serve(engine, a.host, a.port)
    return ""


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="tessera")
    verbs = parser.add_subparsers(required=True)
    c = verbs.add_parser("curate")
    c.add_argument("graph"), c.add_argument("--out"), c.add_argument("--dry-run", action="store_true"), c.add_argument("--no-backup", action="store_true")
    c.set_defaults(run=curate)
    c = verbs.add_parser("subgraph")
    c.add_argument("graph"), c.add_argument("questions"), c.add_argument("--out"), c.add_argument("--dry-run", action="store_true")
    c.set_defaults(run=subgraph)
    c = verbs.add_parser("evaluate")
    c.add_argument("runs"), c.add_argument("answer"), c.add_argument("--by", nargs="*", default=[])
    c.set_defaults(run=evaluate)
    c = verbs.add_parser("serve")
    c.add_argument("--graph"), c.add_argument("--store"), c.add_argument("--host", default="127.0.0.1"), c.add_argument("--port", type=int, default=8000)
    c.set_defaults(run=serve)
    a = parser.parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("tessera").getOrCreate(), a)


if __name__ == "__main__":
    print(main())
