"""Group statistics, group-disjoint splits, stratified subsamples, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ordering import first_rows, hash_order, hashed_numbers


def group_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def members_of_large_groups(df: DataFrame, label: str, least: int) -> DataFrame:
    return df.join(group_sizes(df, label).where(F.col("n") >= least).select(label), label, "left_semi")


def profile(df: DataFrame, label: str, length: str) -> DataFrame:
    """One row: median and greatest length and group size, medians cut to whole
    numbers, and the number of groups. Zero rows give nulls and no group."""
    lengths = df.groupBy(F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    sizes = group_sizes(df, label).groupBy(F.col("n").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def middle(hist: DataFrame, name: str) -> DataFrame:
        return hist.agg(F.expr("cast(percentile(v, 0.5, n) as int)").alias(f"median_{name}"), F.max("v").cast("long").alias(f"max_{name}"), F.sum("n").alias(f"n_{name}"))

    return middle(lengths, "length").crossJoin(middle(sizes, "group")).drop("n_length").withColumn("n_group", F.coalesce("n_group", F.lit(0)))


def split_groups(df: DataFrame, label: str, test_frac: float = 0.15, min_members: int = 3, seed: int = 42) -> DataFrame:
    """``(label, part)``: groups of at least ``min_members`` in hash order, the first
    ``max(1, floor(groups * test_frac))`` are ``test``, the others ``train``; groups,
    and so all their members, are on one side."""
    groups = group_sizes(df, label).where(F.col("n") >= min_members).select(label)
    numbered = hashed_numbers(groups, [], label, seed)
    n_test = groups.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(float(test_frac)))).alias("__kf_t"))  # one row
    return numbered.crossJoin(F.broadcast(n_test)).select(label, F.when(F.col("rn") <= F.col("__kf_t"), "test").otherwise("train").alias("part"))


def subsample(df: DataFrame, label: str, id_col: str, budget: int, per_group: int = 2, seed: int = 42) -> DataFrame:
    """All rows if there are at most ``budget``. Else ``per_group`` rows of each group,
    in hash order and whatever the budget, and the first of all others in a second
    hash order until the budget is full (it may be exceeded by the first pass)."""
    df = df.where(F.col(label).isNotNull())
    sure = first_rows(df, [label], [hash_order(seed, F.col(id_col)), F.col(id_col)], per_group)
    rest = df.join(sure.select(id_col), id_col, "left_anti")
    room = sure.agg(F.greatest(F.lit(budget) - F.count(F.lit(1)), F.lit(0)).alias("__kf_room"))  # one row
    more = hashed_numbers(rest, [], id_col, seed + 1, "__kf_rn").crossJoin(F.broadcast(room)).where(F.col("__kf_rn") <= F.col("__kf_room"))
    return sure.unionByName(more.select(*sure.columns))


def training_pairs(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """``(draw, label, anchor, positive)``: as many draws as there are members of
    groups of two or more; each takes a group, all groups being equally likely, and
    two different members. Members are numbered in hash order, and a draw's hash
    picks two numbers, so a draw costs the same in a group of any size."""
    sizes = group_sizes(df, label).where("n >= 2")
    groups = hashed_numbers(sizes, [], label, seed, "g")
    count = groups.agg(F.count(F.lit(1)).alias("__kf_groups"))  # one row
    members = hashed_numbers(df.where(F.col(label).isNotNull()).select(label, id_col), [label], id_col, seed, "m")
    large = members.join(sizes, label)
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}{salt}:"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = hashed_numbers(large.select(id_col), [], id_col, seed, "draw").select("draw")
    picked = (
        draws.crossJoin(F.broadcast(count))
        .withColumn("g", number("g") % F.col("__kf_groups") + 1)
        .join(groups, "g")
        .withColumn("i", number("i") % F.col("n"))
        .withColumn("j", (F.col("i") + 1 + number("j") % (F.col("n") - 1)) % F.col("n"))
    )
    a = members.select(label, (F.col("m") - 1).alias("i"), F.col(id_col).alias("anchor"))
    b = members.select(label, (F.col("m") - 1).alias("j"), F.col(id_col).alias("positive"))
    return picked.join(a, [label, "i"]).join(b, [label, "j"]).select("draw", label, "anchor", "positive")
