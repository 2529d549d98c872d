"""Search hits as tab-separated text: query, target, e-value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, query, target, evalue)``. Lines with fewer than three fields are
    skipped; a field that is no number raises, as silence would hide a broken
    file. ``line_no`` rises with the line within a file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.split(F.trim("value"), "\t").alias("f"))
    return lines.where(F.size("f") >= 3).select("line_no", F.col("f")[0].cast("long").alias("query"), F.col("f")[1].cast("long").alias("target"), F.col("f")[2].cast("double").alias("evalue"))


def write_hits(hits: DataFrame, path: str) -> None:
    """``query``, ``target`` and ``evalue`` as lines, a file per task; rows with a null in
    one of them are left out, as a line would be short."""
    fields = [F.col(c).cast("string") for c in ("query", "target", "evalue")]
    hits.dropna(subset=["query", "target", "evalue"]).select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)


def read_dataset(spark: SparkSession, name: str, path: str, clans: str | None = None) -> DataFrame:
    """Labelled proteins of a named dataset, ``scope`` (FASTA) or ``pfam`` (Stockholm
    with a clan file)."""
    from kinfold.sources.fasta import classified, read_fasta
    from kinfold.sources.stockholm import clan_members, read_clans, read_stockholm

    if name == "scope":
        return classified(read_fasta(spark, path))
    if name == "pfam":
        return clan_members(read_stockholm(spark, path), read_clans(spark, clans))
    raise ValueError(f"unknown dataset {name!r}")
