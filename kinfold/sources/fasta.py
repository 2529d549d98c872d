"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.sequences import is_strict, length_ok

NO_CLASS = "x.x.x.x"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(sid, sccs, sequence)``: records as they are. Lines are trimmed and blank
    ones skipped; a header begins with ``>``, its first token is the id, the second
    the class (``x.x.x.x`` if there is none); body lines are put together in upper
    case. Files are split at ``\\n>`` by Spark's own reader, so a large file has many
    tasks; a header that is indented is found within its record."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    # the separator eats the mark of all records but a file's first; an indented
    # mark is an ordinary line of the record before
    lines = F.transform(F.split(F.regexp_replace("value", r"^\s*>", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    whole = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    parts = raw.where(F.trim("value") != "").select(whole.alias("w")).where("w <> ''").select(F.explode(F.split("w", "\n>")).alias("r"))
    head = F.split(F.trim(F.substring_index("r", "\n", 1)), r"\s+")
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    return parts.select(
        head[0].alias("sid"), F.coalesce(F.try_element_at(head, F.lit(2)), F.lit(NO_CLASS)).alias("sccs"),
        F.upper(F.regexp_replace(body, r"\n", "")).alias("sequence")).where("sid <> ''")


def classified(records: DataFrame) -> DataFrame:
    """Records with a sequence wholly of residues and of 20 to 512: ``(sid, sequence,
    superfamily, family, family_name)``. Others are dropped, not repaired."""
    kept = records.where(is_strict(F.col("sequence")) & length_ok(F.col("sequence")))
    return kept.select("sid", "sequence", F.substring_index("sccs", ".", 3).alias("superfamily"), F.col("sccs").alias("family"), F.lit("").alias("family_name"))


def write_fasta(df: DataFrame, path: str, id_col: str = "pid", seq_col: str = "seq") -> None:
    """``>id`` and the sequence on a line each, a file per task."""
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col)).alias("value")).write.mode("overwrite").text(path)
