"""Times one query after another, as a user would wait for them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row

from kinfold.operators.ordering import hashed_sample


def time_queries(method: str, queries: DataFrame, id_col: str, search: Callable[[Row], DataFrame], n: int = 100, seed: int = 42) -> DataFrame:
    """``(method, qi, ms)``: up to ``n`` queries in hash order, each row given to
    ``search`` and what comes back written to a sink that drops its rows. Building
    or caching the corpus is the caller's and not timed. Feed it to
    ``median_after_warm_up``. A Spark job has a floor of tens of milliseconds; the
    throughput of a batch is what to look at for speed."""
    spark = queries.sparkSession
    out = []
    for i, r in enumerate(hashed_sample(queries, id_col, n, seed).collect()):  # at most n rows
        began = time.perf_counter()
        search(r).write.format("noop").mode("overwrite").save()
        out.append((method, i, (time.perf_counter() - began) * 1000))
    return spark.createDataFrame(out, "method string, qi int, ms double")
