"""From documents to packed training sequences, in stages that each call one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is
written and read again before the next. All but the last return the columns of documents, whatever columns there
are beside doc_id and text; a stage's own columns take names that are free.

Defined results: an empty table stays empty. A null or empty text has a quality score as any other, has no letter, so
language drops it, and would be no one's near duplicate. A null doc_id is nobody's duplicate. Rows are judged one by
one: two that share a doc_id but not the text stay or go by their own texts; rows alike in doc_id and text are one
document, of which near_duplicates leaves one. Of a group of near duplicates the least doc_id stays, of equal ones the
text with the least hash. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, packing, quality
from tessera.llm.common import fresh, table, written
from tessera.llm.queries import remainder, tokenizer_path

#: Removed rows, two numbers each, that are sent to every executor at most; beyond that many they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score 0.5 or more."""
    model, name = quality.learn(docs, table(spark, sf_dir, "labels"), remainder(3) != 1), fresh("quality_score", docs.columns)
    return quality.scored(docs, model, docs.columns, name).where(F.col(name) >= 0.5).drop(name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those too far from every learned language."""
    model, name = language.learn(docs, remainder(5) != 0), fresh("language_found", docs.columns)
    return language.identified(docs, model, docs.columns, name).where(~F.col(f"{name}.rejected")).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a Jaccard ratio of 0.8 or more on five words."""
    rows = written(jaccard.components(docs, shingle=5, percent=80, text_hash=F.xxhash64("text")), "rows")
    stays = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(stays, "component").where(F.struct("doc_id", "text_hash") != F.col("stays")).select("doc_id", "text_hash").distinct()
    gone = written(gone, "gone")
    mark = fresh("text_hash", docs.columns)
    kept = docs.withColumn(mark, F.xxhash64("text"))
    same = (kept["doc_id"].cast("long") == gone["doc_id"]) & (kept[mark] == gone["text_hash"])
    kept = kept.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    twice = rows.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():  # rows alike in both, of which the one with the least hash of all columns stays
        twice = written(twice.select(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash")), "twice")
        pair = (F.col("doc_id").cast("long") == F.col("key")) & (F.col(mark) == F.col("hash"))
        every = [F.col(f"`{c}`") for c in docs.columns]
        once = kept.join(twice, pair, "left_semi").groupBy("doc_id", mark).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("row")).select("row.*")
        return kept.join(twice, pair, "left_anti").drop(mark).unionByName(once)
    return kept.drop(mark)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 1024."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages, tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
