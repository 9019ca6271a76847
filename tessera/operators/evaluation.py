"""Scores of answers and of the context they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import bound, holds_any, keyword_hits, words


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, 4)).otherwise(0.0)


def accuracy(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, total, correct, accuracy) of (predicted, gold); rows without a prediction or gold aren't counted."""
    seen = rows.filter("predicted IS NOT NULL AND predicted <> '' AND gold IS NOT NULL")
    return seen.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.expr("predicted = gold")).alias("correct")).withColumn("accuracy", percent(F.col("correct"), F.col("total")))


def errors(rows: DataFrame) -> DataFrame:
    """The rows (predicted, gold, ...) that ``accuracy`` counts as wrong."""
    return rows.filter("predicted IS NOT NULL AND predicted <> '' AND gold IS NOT NULL AND predicted <> gold")


def model_answers(items: DataFrame) -> DataFrame:
    """(id, source_dataset, model, predicted, gold) of benchmark items, one row for each model's answer."""
    return items.select("id", F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"), F.explode("model_answers").alias("model", "predicted"), F.col("correct_answer").alias("gold"))


def run_metrics(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, n, accuracy, abstention, recall, avg_ctx) of (answer, gold, recall, ctx_n), all over all rows; no context counts 0."""
    abstained = "answer IS NULL OR answer IN ('', '-')"
    a = runs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.expr("answer = gold"), F.lit(False))).alias("c"), F.count_if(F.expr(abstained)).alias("a"), F.count_if(F.coalesce("recall", F.lit(False))).alias("r"), F.sum(F.coalesce("ctx_n", F.lit(0))).alias("x"))
    return a.select(*by, "n", percent(F.col("c"), F.col("n")).alias("accuracy"), percent(F.col("a"), F.col("n")).alias("abstention"), percent(F.col("r"), F.col("n")).alias("recall"), F.round(F.col("x") / F.col("n"), 4).alias("avg_ctx"))


def console_metrics(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, recall, avg_ctx): recall over the rows that have it, context over those that aren't 0."""
    a = runs.groupBy(*by).agg(F.count("recall").alias("k"), F.count_if("recall").alias("r"), F.avg(F.nullif("ctx_n", F.lit(0))).alias("x"))
    return a.select(*by, percent(F.col("r"), F.col("k")).alias("recall"), F.round("x", 4).alias("avg_ctx"))


def hybrid(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs (id, answer) with the baseline's answer where the run abstained."""
    b = baseline.select("id", F.col("answer").alias("_b"))
    gone = F.col("answer").isNull() | F.col("answer").isin("", "-")
    return runs.join(b, "id", "left").withColumn("answer", F.when(gone, F.coalesce("_b", "answer")).otherwise(F.col("answer"))).drop("_b")


def recall_proxy(gold: Column, context: Column) -> Column:
    """Whether at least half of the gold text's words of four and more letters occur in the context; a text
    without such words must occur as a whole, a missing one is no recall."""
    low, ctx = F.lower(gold), F.lower(F.coalesce(context, F.lit("")))
    long_words = F.filter(words(low), lambda w: F.length(w) > 3)
    hits = F.size(bound(ctx, lambda c: F.filter(long_words, lambda w: F.contains(c, w))))
    return F.when(gold.isNull() | (gold == ""), False).when(F.size(long_words) > 0, hits / F.size(long_words) >= 0.5).otherwise(F.contains(ctx, low))


def domain(text: Column) -> Column:
    """The domain of a question with its options, the first whose keywords occur."""
    low = F.lower(text)
    c = None
    for name, parts in v.DOMAINS.items():
        c = F.when(holds_any(low, parts), name) if c is None else c.when(holds_any(low, parts), name)
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(c.otherwise("bg_physical_geo"))


def topic(text: Column) -> Column:
    """The topic with the most keywords in the text, the first declared on a tie, ``other`` without any."""
    low = F.lower(text)
    scored = F.array(*[F.struct(keyword_hits(low, parts).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, parts) in enumerate(v.TOPICS.items())])
    best = F.array_max(scored)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(best["n"] > 0, best["name"]).otherwise("other")


def about_country(text: Column) -> Column:
    return holds_any(F.lower(text), v.COUNTRY_MARKS)


def coverage(rows: DataFrame) -> DataFrame:
    """(domain, n, covered, gap_rate) of (domain, recall), by domain, in scope (all but the world) and in all."""
    scope = F.array(F.col("domain"), F.when(F.col("domain") != "world_geo", F.lit("in_scope")), F.lit("all"))
    one = rows.select(F.explode(scope).alias("domain"), "recall").filter("domain IS NOT NULL")
    return one.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("recall").alias("covered")).withColumn("gap_rate", percent(F.col("n") - F.col("covered"), F.col("n")))


def survival(rows: DataFrame) -> DataFrame:
    """(arm, oracle, at_60, at_15) of (arm, oracle, r60, r15): the shares of the questions whose evidence
    was there at all that still have it in the first 60 and 15."""
    seen = rows.filter("oracle")
    return seen.groupBy("arm").agg(F.count("*").alias("oracle"), F.count_if("r60").alias("a"), F.count_if("r15").alias("b")).select("arm", "oracle", percent(F.col("a"), F.col("oracle")).alias("at_60"), percent(F.col("b"), F.col("oracle")).alias("at_15"))
