"""Sessions and lines that arrive as files: a stream that appends each record once. An extension; late records count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LINE = "codebook_id string, id string, unit string, unit_date string, pos int, who string, text string, loaded_at timestamp"


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_new(spark: SparkSession, target: str, keys: list[str]):
    """A batch function: writes the rows whose keys the target has not. A batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        try:
            have = spark.read.parquet(target).select(*keys)
            new = new.join(have, keys, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(target)

    return write


def ingest_lines(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the lines of JSON files under ``source`` to ``target``; stops when all files there are taken in.

    Repeats are told by the target alone, so a line is taken in however late it comes.
    """
    stream = line_stream(spark, source).where("codebook_id is not null and id is not null")
    return stream.writeStream.foreachBatch(append_new(spark, target, ["codebook_id", "id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(lines: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """(codebook_id, from, lines): lines by day of delivery, closed once ``delay`` has passed."""
    w = lines.withWatermark("loaded_at", delay).groupBy("codebook_id", F.window("loaded_at", window)).agg(F.count("*").alias("lines"))
    return w.select("codebook_id", F.col("window.start").alias("from"), "lines")
