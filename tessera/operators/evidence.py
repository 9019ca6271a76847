"""Evidence for test items: texts that share a name with the question, ranked by several scorers, and
whether the gold answer is in the first of them.

An item and a text meet where they share a capitalized word. Of a name that any share of the texts hold the
texts are dealt over parts, and the items, a stated set, are repeated for each. Scores are compared within an
item; ties go to the smaller text id.

Defined results: null questions and texts meet nothing; an item without evidence or without gold recalls
nothing; repeated texts are compared each. Columns of other names aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, words
from ..sources.tables import settled
from . import ranking

SALTS = 8
#: A name: a capital and three small letters or more.
NAME = "[А-ЯA-Z][а-яa-z]{3,}"
CUTS = (60, 15)


def _names(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NAME), F.lit(0)))


def meeting(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, doc_id) of items (id, question) and texts (doc_id, text) that share a name."""
    asked = items.select("id", F.explode(_names("question")).alias("name")).withColumn("part", F.explode(F.array(*map(F.lit, range(SALTS)))))
    held = texts.select("doc_id", F.explode(_names("text")).alias("name")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return held.join(asked, ["name", "part"]).select("id", "doc_id").distinct()


def ranked(items: DataFrame, texts: DataFrame, model=ranking.word_overlap) -> DataFrame:
    """(id, doc_id, text, lexical, stem, pair): the texts that meet an item with their place by each of three
    scorers, the last one a model for pairs. What the first two need of a question and of a text is found once
    for each of them that meets another."""
    met = settled(meeting(items, texts), "meeting")
    asked = settled(items.select("id", "question", ranking.ready(F.col("question")).alias("q")), "asked")
    held = texts.select("doc_id", "text").join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    held = settled(held.select("doc_id", "text", ranking.ready(F.col("text")).alias("t")), "held")
    pairs = met.join(held, "doc_id").join(asked, "id")
    a, b = ranking._lexical(F.col("q.words"), F.col("t.low")), ranking.ready_stem_score("q", "t")
    scored = ranking.model_scores(pairs.select("id", "doc_id", "text", "question", a.alias("a"), b.alias("b")), "question", "text", model, "c")
    by = lambda c: F.row_number().over(Window.partitionBy("id").orderBy(F.desc(c), "doc_id"))
    return scored.select("id", "doc_id", "text", by("a").alias("lexical"), by("b").alias("stem"), by("c").alias("pair"))


ARMS = ("lexical", "stem", "pair")


def recalls(gold: DataFrame, placed: DataFrame, cuts=CUTS) -> DataFrame:
    """gold (id, gold, ...) with ``ctx_n``, ``recall`` over all evidence and ``{arm}_{cut}`` over the first of it.

    Evidence is never put together in one row: for each word of the gold text, what counts is whether some
    text holds it."""
    low = F.lower("gold")
    long_words = F.filter(words(low), lambda w: F.length(w) > 3)
    wanted = gold.select("id", F.when(F.col("gold").isNull() | (F.col("gold") == ""), F.array().cast("array<string>")).when(F.size(long_words) > 0, long_words).otherwise(F.array(low)).alias("w"))
    hits = bound(F.lower("text"), lambda t: F.transform("w", lambda w: F.contains(t, w).cast("int")))
    one = placed.join(wanted, "id").select("id", *ARMS, F.posexplode(hits).alias("i", "hit"))
    within = {"recall": F.max("hit"), **{f"{a}_{n}": F.max(F.when(F.col(a) <= n, F.col("hit"))) for a in ARMS for n in cuts}}
    found = one.groupBy("id", "i").agg(*[c.alias(k) for k, c in within.items()]).groupBy("id").agg(*[(F.sum(F.coalesce(k, F.lit(0))) / F.count("*") >= 0.5).alias(k) for k in within])
    n = placed.groupBy("id").agg(F.count("*").alias("ctx_n"))
    both = gold.join(found, "id", "left").join(n, "id", "left")
    return both.select(*gold.columns, F.coalesce("ctx_n", F.lit(0)).alias("ctx_n"), *[F.coalesce(k, F.lit(False)).alias(k) for k in within])
