"""Cleaning and validating residue sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 20 standard residues (fixed values).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH, MAX_LENGTH = 20, 512


def clean_sequence(seq: Column) -> Column:
    """ASCII letters only, upper case, then the standard residues only. The
    first step comes before upper-casing, which may turn other scripts' letters
    into ASCII."""
    letters = F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))
    return F.regexp_replace(letters, f"[^{RESIDUES}]", "")


def clean_sequence_sql(column: str) -> str:
    return f"regexp_replace(upper(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '[^{RESIDUES}]', '', 'g')"


def is_strict(seq: Column) -> Column:
    """Whole sequence over the alphabet; unlike ``$``, ``\\z`` admits no newline."""
    return seq.rlike(rf"\A[{RESIDUES}]+\z")


def length_ok(seq: Column, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    return F.length(seq).between(low, high)


def one_row_per_id(df: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row for each non-null ``key``: the last by ``latest``, ties by a hash
    of the row, so that any partitioning gives the same row."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(*([F.col(latest)] if latest else []), F.xxhash64(*cols) if cols else F.lit(0))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__kf_r"))
    return kept.select(key, "__kf_r.*")


def usable_proteins(proteins: DataFrame, *extra: str, with_seq: bool = True) -> DataFrame:
    """``(pid, [seq,] n, *extra)``: one row per protein whose clean sequence has 20
    to 512 residues. Rows with a null ``pid`` belong to no protein. Without ``seq``
    only lengths are shuffled."""
    own = ["seq", "n"] if with_seq else ["n"]
    cleaned = proteins.withColumn("seq", clean_sequence(F.col("sequence"))).where(length_ok(F.col("seq")))
    slim = cleaned.select("pid", "loaded_at", F.length("seq").alias("n"), *(["seq"] if with_seq else []), *extra)
    return one_row_per_id(slim, "pid", "loaded_at").select("pid", *own, *extra)


def kmers(seq: Column, k: int) -> Column:
    """Distinct substrings of length k; none for shorter texts (``sequence(1, 0)``
    would count down)."""
    grams = F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
