"""JSON files of pages, questions and runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dataset import first_of, repeated_titles

PAGE = "title string, content string, language string"
QUESTION = "id string, qid int, url string, question string, answers array<string>, correct string"
PARENT = "parent_id string, title string, section string, text string"
RUN = "question string, answer string, recall boolean, ctx_n int"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_pages(spark: SparkSession, path: str, excluded: list[str] = ()) -> DataFrame:
    """(title, content, language, source_file) of files that each hold a JSON list of pages; files that
    aren't JSON give none."""
    df = _named(spark.read.schema(PAGE).option("multiLine", True).option("mode", "PERMISSIVE").json(path))
    # what a file without JSON leaves is a row of nulls
    return df.filter("title IS NOT NULL OR content IS NOT NULL OR language IS NOT NULL").filter(~F.col("source_file").isin(list(excluded)))


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.schema(PAGE).option("mode", "DROPMALFORMED").json(path))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of all .json and .jsonl files of a folder, the first of each title by file and text."""
    both = read_pages(spark, f"{folder}/*.json").unionByName(read_page_lines(spark, f"{folder}/*.jsonl"))
    return first_of(both.filter(F.col("title").rlike(r"[^\s\p{Z}]")), ["title"], ["source_file", "content", "language"])


def read_folder_counted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The pages of a folder, and (title, n) of the titles that stood there several times."""
    both = read_pages(spark, f"{folder}/*.json").unionByName(read_page_lines(spark, f"{folder}/*.jsonl"))
    return read_folder(spark, folder), repeated_titles(both)


def read_page_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pages of a JSON list, and (title, n) of the titles it holds several times."""
    pages = read_pages(spark, path)
    return pages, repeated_titles(pages)


def read_exam(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, answer keys, url map) of an exam's JSON lists in a folder: questions_{name}.json,
    answers_{name}.json and url_mapping.json."""
    read = lambda file, schema: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{file}")
    return read(f"*questions_{name}.json", QUESTION), read(f"answers_{name}.json", "qid int, url string, correct int"), read("url_mapping.json", "current_url string, new_url string")


def read_benchmark(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Benchmark records, one a line; the first n by file and line where n is given."""
    df = spark.read.json(path)
    if n is None:
        return df
    lines = spark.read.text(path).select("value", "_metadata.file_name", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    first = lines.filter("trim(value) <> ''").orderBy("file_name", "block", "line").limit(n)
    return first.select(F.from_json("value", df.schema).alias("x"), "file_name", "block", "line").orderBy("file_name", "block", "line").select("x.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records by question; of several lines of one question, which resumed runs append, the last counts."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).withColumn("line", F.monotonically_increasing_id())
    rows = lines.select("file", "line", F.from_json("value", RUN).alias("x")).filter("x.question IS NOT NULL").select("file", "line", "x.*")
    last = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("file"), F.desc("line")))
    return rows.withColumn("n", last).filter("n = 1").drop("n", "file", "line")


def read_nested_questions(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """(id, qid, url, question, answers, correct) of a file {"data": {topic: [{url, questions: [...]}]}}."""
    q = "array<struct<id:string,qid:int,question:string,answers:array<string>,correct:string>>"
    df = spark.read.schema(f"data map<string, array<struct<url:string,questions:{q}>>>").option("multiLine", True).json(path)
    page = df.select(F.explode(F.col("data")[topic]).alias("page"))
    return page.select("page.url", F.explode("page.questions").alias("q")).select("q.id", "q.qid", "url", "q.question", "q.answers", "q.correct")


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, null fields included."""
    df.write.mode("append" if append else "error").option("ignoreNullFields", False).json(path)


def write_in_order(df: DataFrame, path: str, *order: str) -> None:
    """One JSON object a line, in order: that of the files by name and of their lines."""
    df.orderBy(*order).write.mode("error").option("ignoreNullFields", False).json(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """Indented JSON: each file holds one list, null fields included."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

    def listed(batches):
        first = True
        for b in batches:
            texts = [("[\n" if first and k == 0 else ",\n") + t for k, t in enumerate(b.column(0).to_pylist())]
            first = first and not texts
            yield pa.RecordBatch.from_pydict({"value": texts}, pa.schema([("value", pa.string())]))
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]}, pa.schema([("value", pa.string())]))

    rows.mapInArrow(listed, "value string").write.mode("error").option("lineSep", "\n").text(path)


def write_parents(parents: DataFrame, path: str) -> None:
    """Parent texts (parent_id, title, section, text), one JSON object a line, in place of older ones."""
    parents.select("parent_id", "title", "section", "text").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARENT).json(path)


def category_members(links: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """(title, depth): pages reached from a category over (parent, member, is_category) within ``depth``
    levels of sub-categories, each at its first level."""
    frontier = links.sparkSession.createDataFrame([(root,)], "parent string")
    seen, found = frontier, None
    for level in range(depth + 1):
        below = links.join(frontier, "parent")
        pages = below.filter("NOT is_category").select(F.col("member").alias("title")).distinct().withColumn("depth", F.lit(level))
        found = pages if found is None else found.unionByName(pages)
        frontier = below.filter("is_category").select(F.col("member").alias("parent")).distinct().join(seen, "parent", "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy("title").agg(F.min("depth").alias("depth"))
