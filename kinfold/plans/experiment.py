"""The whole evaluation: split, subsample, encode, search by each method, report."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import groups, hits, minhash, search
from kinfold.operators.align import align_block
from kinfold.operators.encode import Encoder, encode_pooled, encode_tokens
from kinfold.operators.evaluate import KS, median_after_warm_up, recall_at_k, recall_per_query, summary
from kinfold.operators.latency import time_queries
from kinfold.session import Scratch


def experiment(
    proteins: DataFrame,
    encoder: Encoder,
    scratch: Scratch,
    test_frac: float = 0.15,
    min_members: int = 3,
    max_test: int = 3000,
    ks: Sequence[int] = KS,
    outside_hits: DataFrame | None = None,
    latency: DataFrame | None = None,
    timed: int = 0,
) -> DataFrame:
    """``(method, r_at_<k>..., median_ms)`` of ``proteins(pid, seq, label)``.

    Groups of at least ``min_members`` are split, the test side is cut to ``max_test``
    with two of each group kept, and each of its proteins is a query against the
    others: late interaction on token vectors, the mean vector by dot product and
    by cosine, MinHash, and, if given, hits of an outside search. ``max_test`` bounds
    the corpus, so its square is bounded too. Rows without sequence or label take no
    part; without any test protein every recall is 0. Times are those given as
    ``latency(method, median_ms)``, or the medians over ``timed`` queries, the first five
    left out, see :func:`method_latencies`, or else ``n/a``.
    """
    usable = proteins.where("pid is not null and seq is not null and label is not null").select("pid", "seq", "label")
    parts = groups.split_groups(usable, "label", test_frac, min_members)
    test = usable.join(parts.where("part = 'test'").select("label"), "label", "left_semi")
    test = groups.subsample(test, "label", "pid", max_test).select(F.col("pid").alias("id"), "seq", "label")
    # few bytes, but each row is a query against all others: more tasks than the bytes ask for
    tasks = 4 * proteins.sparkSession.sparkContext.defaultParallelism
    test = scratch.write(test.repartition(tasks, "id"), "test")
    labels, k = test.select("id", "label"), max(ks)

    pooled = scratch.write(encode_pooled(test, encoder), "pooled")
    inner = scratch.write(encode_pooled(test, encoder, inner=True), "inner")
    tokens = scratch.write(encode_tokens(test, encoder).withColumnRenamed("toks", "vec"), "tokens")
    signed = scratch.write(minhash.signatures(test).withColumnRenamed("sig", "vec"), "signed")
    ranked = {
        "late interaction": search.top_k(tokens, tokens.repartition(tasks, "id"), search.maxsim_block, k),
        "mean pool, dot": search.top_k(pooled, pooled, search.dot_block, k),
        "mean pool, cosine": search.top_k(inner, inner, search.cosine_block, k),
        "MinHash": search.top_k(signed, signed, search.agreement_block, k),
    }
    if outside_hits is not None:
        # the search ran over more than the test side: only its own pairs compete
        own = outside_hits.join(test.select(F.col("id").alias("query")), "query", "left_semi").join(test.select(F.col("id").alias("target")), "target", "left_semi")
        ranked["outside search"] = hits.rank_hits(own, k)
    out = None
    for method, rows in ranked.items():
        r = recall_at_k(recall_per_query(rows, labels, labels, ks), ks).select(F.lit(method).alias("method"), "k", "recall")
        out = r if out is None else out.unionByName(r)
    if latency is None and timed:
        corpora = {"late interaction": tokens, "mean pool, dot": pooled, "mean pool, cosine": inner, "MinHash": signed, "outside search": test.withColumnRenamed("seq", "vec")}
        latency = method_latencies(test, encoder, {m: corpora[m] for m in ranked}, k, timed)
    latency = latency if latency is not None else proteins.sparkSession.createDataFrame([], "method string, median_ms double")
    return summary(out, latency, ks)


def method_latencies(test: DataFrame, encoder: Encoder, corpora: dict[str, DataFrame], k: int, n: int) -> DataFrame:
    """``(method, median_ms)``: up to ``n`` test proteins, one after another, from the
    sequence to the ranked list. Encoding the query (or signing it) is part of the time,
    the corpus is there. The outside search is stood for by the exhaustive local
    alignment. What is timed is a Spark job each, with its floor of some 100 ms."""

    def tokens(seq: str) -> pa.Array:
        vec, _ = encoder.encode(pa.array([seq]))
        return pa.array([vec.tolist()], pa.list_(pa.list_(pa.float32())))

    def pooled(seq: str, inner: bool) -> pa.Array:
        vec, _ = encoder.encode(pa.array([seq]))
        mean = (vec[1:-1] if inner else vec).mean(axis=0, dtype=np.float64)
        return pa.array([(mean / max(np.linalg.norm(mean), 1e-12) if inner else mean).tolist()], pa.list_(pa.float64()))

    encode = {
        "late interaction": (tokens, search.maxsim_block),
        "mean pool, dot": (lambda seq: pooled(seq, False), search.dot_block),
        "mean pool, cosine": (lambda seq: pooled(seq, True), search.cosine_block),
        "MinHash": (lambda seq: pa.array(minhash.sign(pa.array([seq]))[1].tolist(), pa.list_(pa.int64())), search.agreement_block),
        "outside search": (lambda seq: pa.array([seq]), align_block),
    }
    out = None
    for method, corpus in corpora.items():
        few = corpus.coalesce(corpus.sparkSession.sparkContext.defaultParallelism)
        of, block = encode[method]
        one = lambda r, few=few, of=of, block=block: search.top_k_of_block(np.array([r["id"]]), of(r["seq"]), few, block, k)
        times = time_queries(method, test.select("id", "seq"), "id", one, n)
        out = times if out is None else out.unionByName(times)
    return median_after_warm_up(out).select("method", "median_ms")
