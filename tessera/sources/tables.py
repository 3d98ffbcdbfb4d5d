"""Sources and sinks: strict TSV, lenient TSV, Parquet with layout, sharded and submission sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NEVER = "\x00never\x00"


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a small table of fewer splits than cores to all cores; a table of more splits stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_tsv(spark: SparkSession, path: str, columns: list[str], strict: bool = True) -> DataFrame:
    """All columns are strings and never null: an empty field is "", the text NA is NA. Strict: a malformed row fails."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    r = spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", NEVER).option("emptyValue", "")
    r = r.option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("multiLine", True) if strict else r.option("quote", "").option("escape", "")
    df = r.csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def profile_lines(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Lines, lines of another width, lines with quotes, carriage returns or a byte order mark, by file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    width = F.size(F.split("value", "\t", -1))
    return lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if(width != columns).alias("bad_width"), F.count_if(F.col("value").contains('"')).alias("quoted"),
        F.count_if(F.col("value").endswith("\r")).alias("crlf"), F.count_if(F.col("value").startswith("﻿")).alias("bom"), F.count_if(F.col("value").contains("�")).alias("undecodable"),
    )


def write_partitioned(df: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """Refuses to overwrite; the committer publishes all files or none."""
    df.repartition(*by).sortWithinPartitions(*by, *order).write.mode("errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """`shard` by CRC-32: all rows of a key share one."""
    return df.withColumn("shard", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n)).cast("int"))


def id_lists(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q, ids): every query, its targets sorted and joined by commas; empty without one."""
    lists = pairs.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set(F.col("t").cast("string"))), ",").alias("ids"))
    return queries.select("q").join(lists, "q", "left").na.fill("", ["ids"])


def write_lists(lists: DataFrame, path: str) -> None:
    lists.repartitionByRange(F.col("q")).sortWithinPartitions("q").write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)
