"""Recall at k with a capped denominator, summaries, losses and timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.ordering import number_rows

KS = (1, 5, 10, 100)


def recall_per_query(ranked: DataFrame, labels: DataFrame, queries: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """``(qid, k, hits, rel, recall)`` from ``ranked(qid, did, rk)``, ``labels(id,
    label)`` of the corpus and ``queries(id)``.

    ``rel`` is the size of the query's group less one; queries without any other
    member are left out, queries without ranked rows have recall 0. The denominator
    is ``min(k, rel)``. One ranking serves every k.
    """
    labels = labels.where(F.col("label").isNotNull())
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("rel"))
    asked = queries.select("id").join(labels, "id").join(sizes, "label").where("rel > 0").select(F.col("id").alias("qid"), F.col("label").alias("_ql"), "rel")
    seen = ranked.where(F.col("rk") <= max(ks)).join(labels.select(F.col("id").alias("did"), F.col("label").alias("_dl")), "did").select("qid", "rk", "_dl")
    joined = asked.join(seen, "qid", "left")
    same = F.col("_ql") == F.col("_dl")
    counts = joined.groupBy("qid", "rel").agg(*[F.count(F.when(same & (F.col("rk") <= k), 1)).alias(f"_h{k}") for k in ks])
    long = counts.select("qid", "rel", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_h{k}").alias("hits")) for k in ks])).alias("_e")).select("qid", "rel", "_e.*")
    return long.select("qid", "k", "hits", "rel", (F.col("hits") / F.least("k", "rel").cast("double")).alias("recall"))


def recall_at_k(per_query: DataFrame, ks: Sequence[int] = KS, digits: int = 6) -> DataFrame:
    """``(k, recall, n)``: the mean over queries; 0 if there are none."""
    spark = per_query.sparkSession
    every = spark.createDataFrame([(k,) for k in ks], "k int")
    means = per_query.groupBy("k").agg(F.avg("recall").alias("_r"), F.count(F.lit(1)).alias("_n"))
    # a row per k, a row per method
    return every.join(F.broadcast(means), "k", "left").select("k", F.round(F.coalesce("_r", F.lit(0.0)), digits).alias("recall"), F.coalesce("_n", F.lit(0)).alias("n"))


def summary(recalls: DataFrame, latency: DataFrame | None = None, ks: Sequence[int] = KS) -> DataFrame:
    """One row per method with ``r_at_<k>`` as text of four decimals and, with
    ``latency(method, median_ms)``, its median or ``n/a``."""
    wide = recalls.groupBy("method").agg(*[F.format_string("%.4f", F.max(F.when(F.col("k") == k, F.col("recall")))).alias(f"r_at_{k}") for k in ks])
    if latency is None:
        return wide
    shown = F.when(F.col("median_ms").isNotNull(), F.format_string("%.2f", "median_ms")).otherwise("n/a").alias("median_ms")
    return wide.join(F.broadcast(latency), "method", "left").select("method", *[f"r_at_{k}" for k in ks], shown)


def median_after_warm_up(timings: DataFrame, warm_up: int = 5) -> DataFrame:
    """``(method, n, median_ms)`` of ``timings(method, qi, ms)`` with ``qi >= warm_up``; a
    method with nothing after that has no row."""
    return timings.where(F.col("qi") >= warm_up).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.median("ms").alias("median_ms"))


def info_nce(pairs: DataFrame, score: Column, temperature: float = 1.0) -> DataFrame:
    """``(batch, n, loss)`` of ``pairs(batch, i, anchor, positive)``: the mean of the
    cross entropies along rows and columns of each batch's score matrix, the
    diagonal being positive. Same-label pairs off the diagonal count as negatives.
    ``score`` is an expression of ``anchor`` and ``positive``. The matrix is formed by
    an equi-join on the batch: as many rows as a batch is large, squared."""
    a = pairs.select("batch", "i", "anchor")
    b = pairs.select("batch", F.col("i").alias("j"), "positive")
    m = a.join(b, "batch").select("batch", "i", "j", (score / F.lit(float(temperature))).alias("s"))

    def one_way(axis: str) -> DataFrame:
        w = Window.partitionBy("batch", axis)
        shifted = m.withColumn("_m", F.max("s").over(w))
        rows = shifted.groupBy("batch", axis).agg(
            (F.first("_m") + F.log(F.sum(F.exp(F.col("s") - F.col("_m")))) - F.sum(F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(0.0))).alias("ce"))
        return rows.groupBy("batch").agg(F.avg("ce").alias(f"ce_{axis}"), F.count(F.lit(1)).alias(f"n_{axis}"))

    return one_way("i").join(one_way("j"), "batch").select("batch", F.col("n_i").alias("n"), ((F.col("ce_i") + F.col("ce_j")) / 2).alias("loss"))


def loss_ema(steps: DataFrame, decay: float = 0.98, bucket_bits: int = 10) -> DataFrame:
    """``(epoch, n, ema)`` of ``steps(epoch, step, loss)``: the running mean
    ``r = decay r + (1 - decay) x`` in order of ``step``, seeded with the first loss
    of the epoch. Unrolled, each loss has the weight ``decay**(n - i)``, so an epoch
    is a weighted sum that any number of tasks can share, not a fold in one."""
    steps = steps.where(F.col("loss").isNotNull())
    numbered = number_rows(steps, ["epoch"], F.shiftright("step", bucket_bits), [F.col("step")], "i")
    sizes = steps.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.lit(decay), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, F.lit(1.0)).otherwise(F.lit(1 - decay))
    return numbered.join(sizes, "epoch").groupBy("epoch", "n").agg(F.sum(weight * F.col("loss")).alias("ema"))
