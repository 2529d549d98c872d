"""Hits of an outside search: ranking and label mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.ordering import first_rows


def rank_hits(hits: DataFrame, k: int = 100, dedupe: bool = True) -> DataFrame:
    """``(qid, did, evalue, rk)`` of ``hits(line_no, query, target, evalue)``: self hits
    and rows without query or target dropped, ascending e-value, ties in line
    order, null e-values last. With ``dedupe`` a target counts once per query, by
    its best hit; without, as often as it is listed, so that recall may exceed 1."""
    rows = hits.where(F.col("query") != F.col("target")).select("query", "target", "evalue", "line_no")
    order = [F.col("evalue").asc_nulls_last(), F.col("line_no")]
    if dedupe:
        rows = first_rows(rows, ["query", "target"], order, 1)
    w = Window.partitionBy("query").orderBy(*order)
    ranked = rows.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)
    return ranked.select(F.col("query").alias("qid"), F.col("target").alias("did"), "evalue", "rk")


def last_mapping(lines: DataFrame, key: str, value: str, line: str) -> DataFrame:
    """One value per key: that of the last line with a non-empty value."""
    kept = lines.where((F.col(value) != "") & F.col(key).isNotNull())
    return kept.groupBy(key).agg(F.max_by(value, line).alias(value))
