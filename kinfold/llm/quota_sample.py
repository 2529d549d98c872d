"""A sample with given shares per category, allocated top-down over a tree.

A leaf's quota is what the targets want of it, as far as it has records. What a
leaf cannot give passes to its siblings, in proportion to what they have left,
what those cannot give to its cousins, and so on up to the root. At the leaves the
records with the least ranks in a hashed permutation are drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.skew import rank_bins
from kinfold.session import Scratch

OTHERS = "*"


def superfamily_tree(leaf: Column) -> list[Column]:
    """Ancestors of a superfamily key, the nearest first: fold, class, root. Clans
    are one fold and class; ``*`` (all that is not named) is alone in its class."""
    clan = leaf.startswith("cl")
    return [
        F.when(clan, "cl").otherwise(F.substring_index(leaf, ".", 2)),
        F.when(clan, "cl").otherwise(F.substring_index(leaf, ".", 1)),
        F.lit("root"),
    ]


def _running_share(total: str, run: str, whole: str) -> Column:
    """``total * run / whole`` rounded down, for a running sum ``run`` of parts that
    add up to ``whole >= total``: its differences add up to ``total``, none is above
    its part."""
    return F.expr(f"(cast({total} as decimal(19,0)) * cast({run} as decimal(19,0))) div greatest({whole}, 1)")


def allocate(leaves: DataFrame, ancestors: list[Column]) -> DataFrame:
    """``leaves(leaf, wanted, available, ...)`` with ``quota`` and ``unmet``, the
    part of the leaf's wish that nobody could take over. One row per category that
    the targets name, and one for the rest: windows over the targets, never over
    records."""
    df = leaves.withColumn("quota", F.least("wanted", "available")).withColumn("unmet", F.col("wanted") - F.col("quota"))
    for level in ancestors:
        everyone = Window.partitionBy("_up")
        so_far = everyone.orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_up", level).withColumn("_spare", F.col("available") - F.col("quota"))
        df = df.withColumn("_u", F.sum("unmet").over(everyone)).withColumn("_s", F.sum("_spare").over(everyone))
        df = df.withColumn("_give", F.least("_u", "_s"))
        for part, whole in (("_spare", "_s"), ("unmet", "_u")):
            df = df.withColumn("_run", F.sum(part).over(so_far)).withColumn("_prev", F.col("_run") - F.col(part))
            df = df.withColumn(f"_cut{whole}", _running_share("_give", "_run", whole) - _running_share("_give", "_prev", whole))
        df = df.withColumn("quota", F.col("quota") + F.col("_cut_s")).withColumn("unmet", F.col("unmet") - F.col("_cut_u"))
        df = df.drop("_up", "_spare", "_u", "_s", "_give", "_run", "_prev", "_cut_s", "_cut_u")
    return df


def wanted_rows(targets: DataFrame) -> DataFrame:
    """``(leaf, wanted)`` from ``(leaf, share_per_10000, min_rows, sample_rows)``; a
    null leaf is the rest (``*``). Of a leaf named more than once the shares are
    added up and the greatest minimum counts. Nulls count as 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    per_leaf = targets.groupBy(F.coalesce("leaf", F.lit(OTHERS)).alias("leaf")).agg(
        F.sum(n("share_per_10000")).alias("s"), F.max(n("min_rows")).alias("m"), F.max(n("sample_rows")).alias("r"))
    return per_leaf.select("leaf", F.greatest(F.col("m"), F.expr("(s * r + 9999) div 10000")).alias("wanted"))


class QuotaSample:
    """``records(id, leaf)``: distinct non-null ids, ``leaf`` null where a record has
    no category. ``targets``: see :func:`wanted_rows`.

    ``report``: ``(leaf, wanted, available, quota, short, unmet)``, one row per named
    leaf and one (``*``) for the rest if the targets have it; ``short`` is how many
    of the wanted the leaf lacks, ``unmet`` how many nobody could take over.
    ``sample``: ``(id, leaf)``, ``quota`` records of each leaf.

    Without records every wish is short; without targets nothing is drawn. The
    permutation is ``md5(seed:id)``, so the sample doesn't depend on partitions.
    Ranking is by radix: records are counted per leaf and leading hash digits, and
    only those in the digit where the quota ends are ranked, so that a leaf with
    most records has no task of its own.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, scratch: Scratch, seed: int = 42, tree=superfamily_tree):
        wanted = scratch.write(wanted_rows(targets), "wanted")
        named = wanted.where(F.col("leaf") != OTHERS).select(F.col("leaf").alias("_leaf"), F.lit(True).alias("_named"))
        rows = records.join(named, F.col("leaf") == F.col("_leaf"), "left").select(
            "id", F.when(F.col("_named"), F.col("leaf")).otherwise(F.lit(OTHERS)).alias("leaf"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("_h"))
        rows = scratch.write(rows, "rows").withColumn("_digits", F.substring("_h", 1, 4))
        hist = scratch.write(rows.groupBy("leaf", "_digits").agg(F.count(F.lit(1)).alias("_cnt")), "hist")
        available = hist.groupBy("leaf").agg(F.sum("_cnt").alias("available"))
        leaves = wanted.join(available, "leaf", "left").select("leaf", "wanted", F.coalesce("available", F.lit(0)).alias("available"))
        quotas = scratch.write(allocate(leaves, tree(F.col("leaf"))), "quotas")
        self.report = quotas.select("leaf", "wanted", "available", "quota",
                                    F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("short"), "unmet")
        some = quotas.where("quota > 0").select("leaf", "quota")
        ends = rank_bins(hist.join(some, "leaf"), ["leaf"], "_digits", F.col("quota")).select("leaf", F.col("_digits").alias("_end"), "_rest")
        reach = rows.join(ends, "leaf").where(F.col("_digits") <= F.col("_end"))
        whole = reach.where(F.col("_digits") < F.col("_end")).select("id", "leaf")
        w = Window.partitionBy("leaf").orderBy("_h", "id")
        last = reach.where(F.col("_digits") == F.col("_end")).withColumn("_rk", F.dense_rank().over(w)).where(F.col("_rk") <= F.col("_rest"))
        self.sample = whole.unionByName(last.select("id", "leaf"))
