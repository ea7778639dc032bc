"""JSON lines: results appended record by record, read back although the last line may be cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, broken): the records of a schema, and the lines that are none."""
    kind = T._parse_datatype_string(schema)
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", _with_bad(kind), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad"), parsed.where("r is null or r._bad is not null").select("value")


def _with_bad(kind: T.StructType) -> T.StructType:
    return T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of the work has no record yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
