"""Per-key results when a few keys hold most rows.

Both operators aggregate before they join: each input shrinks to one compact
state per key, the states are joined, counts are multiplied or summed, and the
result is rolled up. No task ever holds the rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import Scratch


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: str,
    group: Sequence[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    left_group: Sequence[str] = (),
) -> DataFrame:
    """``left join right using (on)`` grouped by ``group`` (columns of ``right``) and
    ``left_group`` (columns of ``left``), with ``n_pairs = count(*)`` and the named sums, without forming the joined
    rows.

    Each side is first reduced to ``(key, [group], count, sums)``, which combines
    on the map side, so a key with a third of all rows arrives as one row per map
    task. A joined pair of states stands for ``n_left * n_right`` rows: a sum over
    the left is multiplied by the right's count and the other way round.
    Null keys join nothing. Null values add nothing; a sum with no value is null.
    ``group`` columns that also exist in ``left`` are taken from ``right``.
    """
    left_sums, right_sums = left_sums or {}, right_sums or {}
    a = (
        left.where(F.col(on).isNotNull())
        .groupBy(F.col(on).alias("_k"), *[F.col(g).alias(f"_f_{g}") for g in left_group])
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_l_{c}") for c, v in left_sums.items()])
    )
    b = (
        right.where(F.col(on).isNotNull())
        .groupBy(F.col(on).alias("_k"), *[F.col(g).alias(f"_g_{g}") for g in group])
        .agg(F.count(F.lit(1)).alias("_m"), *[F.sum(v).alias(f"_r_{c}") for c, v in right_sums.items()])
    )
    return (
        a.join(b, "_k")
        .groupBy(*[F.col(f"_g_{g}").alias(g) for g in group], *[F.col(f"_f_{g}").alias(g) for g in left_group])
        .agg(
            F.sum(F.col("_n") * F.col("_m")).alias("n_pairs"),
            *[F.sum(F.col(f"_l_{c}") * F.col("_m")).alias(c) for c in left_sums],
            *[F.sum(F.col(f"_r_{c}") * F.col("_n")).alias(c) for c in right_sums],
        )
    )


def rank_bins(hist: DataFrame, keys: Sequence[str], digit: str, place: Column) -> DataFrame:
    """The bin of each key that holds ``place``: ``hist`` is ``(*keys, digit, _cnt,
    ...)``, one row per key and digit; ``_cum`` runs over the compact state only.
    Adds ``_rest``, the place within the bin."""
    w = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("_cum", F.sum("_cnt").over(w))
    return run.where((F.col("_cum") >= place) & (F.col("_cum") - F.col("_cnt") < place)).withColumn(
        "_rest", place - (F.col("_cum") - F.col("_cnt"))
    )


def middle_rows(rows: DataFrame, names: DataFrame, on: str, key: str, size: str, id_col: str, scratch: Scratch, id_bits: int = 16) -> DataFrame:
    """``(key, id)``: of ``rows(on, size, id) join names(on, key) using (on)``, the row of
    each key at place ``ceil(n/2)`` in the order of ``size``, then ``id``. ``names`` tells
    which keys the values of ``on`` stand for, such as spellings of one label.

    An eager aggregation, then a radix selection over its states. Both inputs are reduced
    before they are joined (:func:`eager_join_aggregate`): rows to counts per ``(on,
    size)``, names to counts per ``(on, key)``; the products are rolled up to counts per
    ``(key, size)``. These and their totals per key give, by a running sum, the bin with
    the middle place. Only rows of that bin go on, are counted by the high bits of ``id``,
    and so on, until the last bin (at most ``2**id_bits`` distinct ids) is ranked. A key
    with most rows costs what the others do: its states have as many rows as it has sizes.

    Rows with a null in any of these columns are left out. Repeated rows and names count
    as many times as they occur; the result holds each key once.
    """
    slim = rows.select(F.col(on).alias("_on"), F.col(size).cast("long").alias("_size"), F.col(id_col).cast("long").alias("_id")).dropna()
    given = names.select(F.col(on).alias("_on"), F.col(key).alias("_key")).dropna()
    by_size = scratch.write(eager_join_aggregate(slim, given, "_on", ["_key"], left_group=["_size"]).withColumnRenamed("n_pairs", "_cnt"), "by_size")
    totals = by_size.groupBy("_key").agg(F.ceil(F.sum("_cnt") / F.lit(2)).alias("_place"))
    bins = rank_bins(by_size.join(totals, "_key"), ["_key"], "_size", F.col("_place"))
    bins = given.join(bins.select("_key", "_size", F.col("_rest").alias("_place")), "_key")

    inside = slim.join(bins, ["_on", "_size"]).withColumn("_high", F.shiftright("_id", id_bits))
    inside = scratch.write(inside.select("_key", "_place", "_high", "_id"), "inside")
    by_high = inside.groupBy("_key", "_place", "_high").agg(F.count(F.lit(1)).alias("_cnt"))
    last = rank_bins(by_high, ["_key"], "_high", F.col("_place")).select("_key", "_high", F.col("_rest"))
    w = Window.partitionBy("_key", "_high").orderBy("_id")
    return (
        inside.select("_key", "_high", "_id")
        .join(last, ["_key", "_high"])
        .withColumn("_rk", F.row_number().over(w))
        .where(F.col("_rk") == F.col("_rest"))
        .select(F.col("_key").alias(key), F.col("_id").alias(id_col))
    )
