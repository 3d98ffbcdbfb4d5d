"""Plumbing shared by the training-data operators: tables, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark removes an execution's shuffle files as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back, which cuts its lineage.

    The table outlives the loss of any executor, unlike a local checkpoint. forget() deletes it; what is not
    forgotten, because a result that the caller has yet to read rests on it, goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = [path]
    return out


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(df: DataFrame) -> None:
    """Deletes the files behind a table made by written(), once nothing will read them; other frames are left alone."""
    for path in getattr(df, "written_to", []):
        where, files = _files(df.sparkSession, path)
        files.delete(where, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts pass to Python in small Arrow batches, so that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def per_row(columns: list[str], schema: pa.Schema, make: Callable[[], Callable[..., tuple]]):
    """A mapInArrow function: make() builds a per-worker row function over the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            ins = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            rows = [row(*x) for x in zip(*ins, strict=True)]
            outs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(o, type=f.type) for o, f in zip(outs, schema, strict=True)], schema=schema)

    return run


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Minima are
    pre-aggregated before each shuffle, so a hub with very many edges is no single task's work;
    each round is a table in the shared folder. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b").distinct()
    now, before = written(e, name), None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        old, now = now, written(star.distinct(), name)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(old)
        if sums == before:
            break
        before = sums
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out.written_to = now.written_to
    return out
