"""A k-mer index on disk, built once and joined with by later searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.sequences import kmers

BUCKETS = 64


def _grams(texts: DataFrame, id_col: str, k: int, buckets: int, name: str) -> DataFrame:
    rows = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name), F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("kmer"), F.lit(buckets)).cast("int"))


def build(texts: DataFrame, path: str, k: int = 5, id_col: str = "id", buckets: int = BUCKETS) -> None:
    """Writes ``(did, kmer)`` of ``texts(id, seq)``, a folder per hash bucket, sorted by
    k-mer, so that row groups of other k-mers are skipped. Texts shorter than k, and
    null ones, have no entry."""
    rows = _grams(texts, id_col, k, buckets, "did")
    rows.repartition("bucket").sortWithinPartitions("bucket", "kmer").write.mode("overwrite").partitionBy("bucket").parquet(path)


def shared_kmers(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, id_col: str = "id", least: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(qid, did, n)``: texts of the index with at least ``least`` k-mers of the query,
    the query's own id left out. Buckets that no query needs are not read."""
    index = spark.read.schema("did long, kmer string, bucket int").parquet(path)
    q = _grams(queries, id_col, k, buckets, "qid")
    met = q.join(index, ["bucket", "kmer"]).where("qid <> did")
    return met.groupBy("qid", "did").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
