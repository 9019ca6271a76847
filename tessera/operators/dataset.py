"""Building and sampling question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import mended, option_text, question_key, stripped
from ..sources.tables import settled


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def deduplicated_pages(pages: DataFrame) -> DataFrame:
    """The first page of each title; pages with a missing or blank title are left out."""
    return first_of(pages.filter(F.col("title").rlike(r"[^\s\p{Z}]")), ["title"], ["page_id"])


def repeated_titles(pages: DataFrame) -> DataFrame:
    return pages.filter("title IS NOT NULL").groupBy("title").agg(F.count("*").alias("n")).filter("n > 1")


def halves(df: DataFrame, key: str) -> DataFrame:
    """With ``half`` 1 for the first half (rounded down) by key, else 2.

    The place of a row comes from the counts of its range partition, not from one global window.
    """
    ordered = settled(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "halves")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("c"), F.min(key).alias("least"))
    # one row for each partition
    w = Window.orderBy("least")
    before = counts.select("_part", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) + F.col("before")
    return ordered.join(before, "_part").withColumn("half", F.when(place <= F.floor(F.col("total") / 2), 1).otherwise(2)).drop("_part", "before", "total")


def with_answers(questions: DataFrame, keys: DataFrame, url: str = "url") -> DataFrame:
    """Questions with ``correct`` from the key (qid, url, correct from 1 to 4), where there is one; of several
    keys the smallest counts."""
    k = keys.filter("qid IS NOT NULL AND url IS NOT NULL AND correct BETWEEN 1 AND 4").groupBy("qid", F.col("url").alias(url)).agg(F.min("correct").alias("_k"))
    return questions.join(k, ["qid", url], "left").withColumn("correct", F.coalesce(F.try_element_at("answers", F.col("_k")), "correct")).drop("_k")


def with_long_urls(rows: DataFrame, url_map: DataFrame) -> DataFrame:
    """Rows with the long url where the map has the short one."""
    m = url_map.filter("current_url IS NOT NULL").groupBy(F.col("current_url").alias("url")).agg(F.min("new_url").alias("_new"))
    return rows.join(m, "url", "left").withColumn("url", F.coalesce("_new", "url")).drop("_new")


def mended_questions(questions: DataFrame) -> DataFrame:
    """Question, answers and correct with mixed words mended, and whether that changed anything."""
    q = questions.select("*", mended(F.col("question")).alias("_q"), F.transform("answers", mended).alias("_a"), mended(F.col("correct")).alias("_c"))
    changed = ~(F.col("_q").eqNullSafe(F.col("question")) & F.col("_a").eqNullSafe(F.col("answers")) & F.col("_c").eqNullSafe(F.col("correct")))
    return q.withColumn("changed", changed).withColumn("question", F.col("_q")).withColumn("answers", F.col("_a")).withColumn("correct", F.col("_c")).drop("_q", "_a", "_c")


def answer_label(answers: Column, correct: Column) -> Column:
    """A to D by the first answer equal to the correct one but for blanks at the ends, else ``-``."""
    at = F.array_position(F.transform(answers, stripped), stripped(correct))
    return F.coalesce(F.when(at.between(1, 4), F.element_at(F.array(*map(F.lit, "ABCD")), F.when(at.between(1, 4), at).otherwise(1).cast("int"))), F.lit("-"))


def test_records(questions: DataFrame, source: str) -> DataFrame:
    """(id, qid, source_url, source_dataset, question, options, correct_answer)."""
    options = F.transform(F.slice("answers", 1, 4), lambda a, i: F.struct(F.element_at(F.array(*map(F.lit, "ABCD")), i + 1).alias("label"), a.alias("text")))
    return questions.select("id", "qid", F.col("url").alias("source_url"), F.lit(source).alias("source_dataset"), "question", options.alias("options"), answer_label(F.col("answers"), F.col("correct")).alias("correct_answer"))


def merged_questions(older: DataFrame, newer: DataFrame, compose: bool = True) -> DataFrame:
    """Both sets without repeated questions (by key); the older set's goes first, then the smaller id."""
    both = older.withColumn("_p", F.lit(0)).unionByName(newer.withColumn("_p", F.lit(1))).withColumn("_key", question_key(F.col("question"), compose))
    return first_of(both.filter("_key IS NOT NULL"), ["_key"], ["_p", "id", "qid"]).drop("_p", "_key")


def overlap(pool: DataFrame, known: DataFrame, new_only: bool = False, compose: bool = True) -> DataFrame:
    """Questions of the pool that are among the known ones, or those that aren't."""
    a = pool.withColumn("_key", question_key(F.col("question"), compose))
    b = known.select(question_key(F.col("question"), compose).alias("_key")).distinct()
    return a.join(b, "_key", "left_anti" if new_only else "left_semi").drop("_key")


def annotated(pool: DataFrame, known: DataFrame, compose: bool = True) -> DataFrame:
    """The pool with ``known``: whether a question is among the known ones."""
    a = pool.withColumn("_key", question_key(F.col("question"), compose))
    b = known.select(question_key(F.col("question"), compose).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("known", F.lit(True))
    return a.join(b, "_key", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("_key")


def merged_batches(batches: DataFrame, key: str = "question", order: list[str] = (), dedupe: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of all batches, and (rows, repeated). Repeated rows stay unless ``dedupe``: then the first of
    each key by ``order`` is kept."""
    counts = batches.agg(F.count("*").alias("rows"), (F.count(key) - F.count_distinct(key)).alias("repeated"))
    return (first_of(batches, [key], list(order) or [key]) if dedupe else batches), counts


def ordinals(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """With the place of each row by key, from 0: counts of range partitions, not one global window."""
    ordered = settled(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ordinals")
    w = Window.orderBy("least")  # one row for each partition
    before = ordered.groupBy("_part").agg(F.count("*").alias("c"), F.min(key).alias("least")).select("_part", (F.sum("c").over(w) - F.col("c")).alias("before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("before")
    return ordered.join(before, "_part").withColumn(out, place.cast("bigint")).drop("_part", "before")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (or all), each stratum by its share (rounded half to even, one at least), drawn by the hash of seed
    and key. Where the shares give fewer than n, the next ones by hash are added, where more, the last are left out."""
    sizes = df.groupBy(F.coalesce(stratum, F.lit("unknown")).alias("_s")).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    quota = sizes.join(F.broadcast(total)).withColumn("_q", F.greatest(F.lit(1), F.bround(F.col("_c") * n / F.col("_t")).cast("int"))).select("_s", "_q")
    order = F.row_number().over(Window.partitionBy("_s").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key))
    return df.withColumn("_s", F.coalesce(stratum, F.lit("unknown"))).withColumn("_n", order).join(F.broadcast(quota), "_s").withColumn("_in", F.col("_n") <= F.col("_q")).orderBy(F.desc("_in"), F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n).drop("_s", "_n", "_q", "_in")


def pending(questions: DataFrame, done: DataFrame, key: str = "id", retry_errors: bool = False) -> DataFrame:
    """Questions without an answer so far (done: key, answer); an abstention counts as one unless errors are retried."""
    answered = done.filter("answer IS NOT NULL AND answer <> ''")
    if retry_errors:
        answered = answered.filter("answer <> '-'")
    return questions.join(answered.select(key).distinct(), key, "left_anti")


def batch(df: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` by key, a stated slice."""
    return df.orderBy(key).offset(offset).limit(size)


def prompt(question: Column, options: Column) -> Column:
    """The prompt of a question with options (label, text)."""
    lines = F.transform(options, lambda o: F.concat(o["label"], F.lit(") "), o["text"], F.lit("\n")))
    return F.concat(F.lit(v.MCQ_HEAD), question, F.lit("\n"), F.array_join(lines, ""), F.lit(v.MCQ_TAIL))


def grounded_prompt(context: Column, query: Column) -> Column:
    """The prompt of a query with its facts, numbered."""
    numbered = F.array_join(F.transform(context, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    given = F.when(F.coalesce(F.size(context), F.lit(0)) > 0, numbered).otherwise(v.NO_CONTEXT)
    return F.concat(F.lit(v.GROUNDED_HEAD), given, F.lit(v.GROUNDED_MIDDLE), query, F.lit(v.GROUNDED_TAIL))


def gold_text(options: Column, correct: Column) -> Column:
    """The text of the option with the correct label."""
    return option_text(F.try_element_at(F.filter(options, lambda o: o["label"] == correct), F.lit(1))["text"])
