"""Row numbers, first rows and samples in a deterministic order, without a task
that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    """Stands for a seeded shuffle: ascending order of this is the permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Row numbers from 1 within ``keys`` (or over all rows) by ``order``. ``bucket``
    must not fall as ``order`` rises: rows are counted per bucket, the counts added
    up, and only rows of one bucket are ranked together."""
    own = [F.lit(1).alias("__kf_all")] if not keys else []
    by = [*(list(keys) or ["__kf_all"]), "__kf_b"]
    rows = df.select("*", *own).withColumn("__kf_b", bucket)
    counts = rows.groupBy(*[F.col(c).alias(f"__kf_o{i}") for i, c in enumerate(by)]).agg(F.count(F.lit(1)).alias("__kf_n"))
    run = Window.partitionBy(*[f"__kf_o{i}" for i in range(len(by) - 1)]).orderBy(f"__kf_o{len(by) - 1}").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.withColumn("__kf_off", F.coalesce(F.sum("__kf_n").over(run), F.lit(0)))
    joined = rows.join(offset, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__kf_o{i}")) for i, c in enumerate(by)]))
    w = Window.partitionBy(*by).orderBy(*order)
    return joined.withColumn(name, F.col("__kf_off") + F.row_number().over(w)).select(*df.columns, name)


def hashed_numbers(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, name: str = "rn") -> DataFrame:
    """:func:`number_rows` in :func:`hash_order` of ``id_col``."""
    h = df.withColumn("__kf_h", hash_order(seed, F.col(id_col)))
    return number_rows(h, keys, F.substring("__kf_h", 1, 3), [F.col("__kf_h"), F.col(id_col)], name).drop("__kf_h")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group. A bound on the rank lets Spark keep n rows
    per group and map task before the shuffle, so a large group is no burden."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__kf_rk", F.row_number().over(w)).where(F.col("__kf_rk") <= n).drop("__kf_rk")


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the first in hash order."""
    return df.orderBy(hash_order(seed, F.col(id_col)), id_col).limit(n)
