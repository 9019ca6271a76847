"""Questions that arrive as files, answered as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.dataset import pending

QUESTION = "id string, question string"


def answer_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], schema: str = QUESTION):
    """Starts a query that answers each new question of ``folder`` (JSON lines) once and appends (id, answer)
    to ``out`` as Parquet. ``answer``: function from questions to (id, answer).

    A micro-batch that is run again after a failure leaves out what its first run has already written, so
    a question has one answer however often the query is restarted.
    """

    def one(batch: DataFrame, _: int) -> None:
        todo = batch.dropDuplicates(["id"])
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            todo = pending(todo, spark.read.schema("id string, answer string").parquet(out))
        answer(todo).select("id", "answer").write.mode("append").parquet(out)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
