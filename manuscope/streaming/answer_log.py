"""The answer log as a stream: appended answers, their bridges to texts and images, and windowed quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph


def read_answers(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Answers as they are added to a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def store(answers: DataFrame, folder: str) -> StreamingQuery:
    """Appends answers and their bridges below ``folder``, each batch once: a repeated batch overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        texts, images = graph.bridges(batch)
        for name, df in (("answers", batch), ("based_on_text", texts), ("includes_image", images)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return answers.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


def quality(answers: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Answers and mean stated confidence per window of answering time; rows later than ``late`` are left out.

    Works on a stream (with a watermark) and on a table.  Null times are in no window; confidences out of range
    don't count.
    """
    a = answers.where("answered_at is not null").withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    stated = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    w = F.window("answered_at", window)
    return a.withWatermark("answered_at", late).groupBy(w).agg(F.count("*").alias("answers"), F.avg(stated).alias("mean_confidence")).select(F.col("window.start").alias("start"), "answers", "mean_confidence")
