import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.operators import align, evaluate, kmer_index, latency, search
from kinfold.streaming.search import search_stream


def brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (align.MATCH if x == y else align.MISMATCH), h[i, j + 1] + align.GAP, h[i + 1, j] + align.GAP)
    return h.max()


def test_local_scores_against_the_table():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, 30)
    others = [rng.integers(0, 4, n) for n in (0, 1, 7, 40, 25)] + [np.r_[a[:10], a[14:]]]
    assert align.local_scores(a, others).tolist() == [brute(a, b) for b in others]
    assert align.local_scores(a[:0], others).tolist() == [0] * 6 and len(align.local_scores(a, [])) == 0


def test_align_top_k(spark):
    base = "ACDEFGHIKLMNPQRSTVWY" * 2
    df = spark.createDataFrame([(1, base), (2, base[:15] + base[18:]), (3, base), (4, "WWWWWWWWWW"), (5, None), (None, base), (6, "")], "id long, seq string")
    got = align.align_top_k(df.where("id = 1"), df, 2).orderBy("rk").collect()
    assert [(r["did"], r["score"]) for r in got] == [(3, 80), (2, 68)]
    assert align.align_top_k(df.where("false"), df).count() == 0


def test_byte_scores_against_the_table():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 20, 150).astype(np.uint8)
    others = [rng.integers(0, 20, n).astype(np.uint8) for n in (1, 7, 90, 200)]
    others += [np.r_[a[:60], a[64:]], np.r_[a, a], np.r_[a[:125], others[2]], a[:123], a[:1]]
    for q in (a, a[:40], a[:1], a % 3):
        got = align._byte_scores(q, align._lanes(others))
        want = align.local_scores(q, others)
        assert (np.where(got > align.FULL, want, got) == want).all() and ((got > align.FULL) == (want > align.FULL)).all()
    assert align.local_scores(a, others).tolist() == [brute(a, b) for b in others]


def test_align_top_k_misses_no_partner(spark):
    """Partners that share no 5-mer with the query, and scores beyond a byte."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 20, 160)
    apart = base.copy()
    apart[3::4] = (apart[3::4] + 1) % 20  # every fourth residue differs: no 5-mer in common
    rows = [base, apart, base] + [rng.integers(0, 20, n) for n in rng.integers(20, 200, 57)]
    text = lambda x: "".join("ACDEFGHIKLMNPQRSTVWY"[c] for c in x)
    df = spark.createDataFrame([(i, text(x)) for i, x in enumerate(rows)], "id long, seq string")
    got = [(r["qid"], r["rk"], r["did"], r["score"]) for r in align.align_top_k(df.where("id in (0, 7)"), df, 20).collect()]
    want = []
    for q in (0, 7):
        scores = align.local_scores(rows[q], rows)
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:20]
        want += [(q, rk, i, -s) for rk, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want) and (0, 2, 1, 201) in want


def test_align_top_k_in_java_machines(spark, monkeypatch):
    """Same rows as numpy's: other letters, several bytes a letter, ties, scores beyond a
    byte, fewer than k partners, more than one block of queries."""
    from kinfold.operators import align_jvm

    assert align_jvm.ready(spark)
    rng = np.random.default_rng(9)
    text = lambda x: "".join("ACDEFGHIKLMNPQRSTVWY"[c] for c in x)
    base = rng.integers(0, 20, 300)
    rows = [text(rng.integers(0, 20, n)) for n in rng.integers(1, 90, 120)]
    rows += [text(base)] * 3 + [text(np.r_[base[:124], rng.integers(0, 20, 9)]), text(base[:125]), text(base[:126]), text(np.r_[base[:150], base[157:]])]
    rows += ["", None, "A", "XXBXXB", "acd", "\u00c5\u00c5C\u20acD", "W" * 40, "W" * 200]
    df = spark.createDataFrame([(7 * i - 300, x) for i, x in enumerate(rows)] + [(None, "ACD")], "id long, seq string")
    monkeypatch.setattr(search, "QUERY_ROWS", 30)
    for k, queries in ((5, df.where("id % 2 = 0")), (500, df.where("id > 480"))):
        got = align.align_top_k(queries, df, k)
        with monkeypatch.context() as m:
            m.setattr(align_jvm, "ready", lambda _: False)
            want = align.align_top_k(queries, df, k)
        assert got.dtypes == want.dtypes
        got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
        assert got == want and max(r[2] for r in got) > 500


def test_align_in_java_machines_against_the_table(spark):
    from kinfold.operators import align_jvm

    rng = np.random.default_rng(10)
    rows = [rng.integers(0, 4, n) for n in (1, 3, 4, 5, 30, 33, 64, 70)] + [rng.integers(0, 2, 150) for _ in range(3)]
    text = lambda x: "".join("ACDE"[c] for c in x)
    df = spark.createDataFrame([(i, text(x)) for i, x in enumerate(rows)], "id long, vec string").coalesce(1)
    asked = df.toPandas()
    got = align_jvm.found(asked["id"].to_numpy(), pa.array(asked["vec"]), df, 100, skip_self=False).collect()
    assert {(r["qid"], r["did"]): r["score"] for r in got} == {(i, j): s for i, a in enumerate(rows) for j, b in enumerate(rows) if (s := brute(a, b))}


def test_align_bits_leave_out_no_pair_that_counts(spark):
    """Enough rows that the tables of bits decide: lanes of more than one register, scores at
    every bound, ties by id, partners far apart; all rows as the full tables have them."""
    from kinfold.operators import align_jvm

    rng = np.random.default_rng(11)
    some = lambda n, kinds=20: rng.integers(0, kinds, n)
    rows = [some(n) for n in rng.integers(20, 60, 1500)] + [some(n, 4) for n in rng.integers(1, 40, 60)]
    asked = [some(40), some(41), some(42), some(30, 4), some(7), np.r_[rows[0][:12], rows[1][:9]]]
    for a in asked[:3]:  # two sparse partners, and shifted ones
        rows += [np.where(np.arange(len(a)) % 3 == 2, (a + 1) % 20, a), np.where(np.arange(len(a)) % 2 == 1, (a + 1) % 20, a), np.r_[some(5), a[:9], some(2), a[9:20]], np.r_[a[:8], a[10:17]]]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    text = lambda x: "".join("ACDEFGHIKLMNPQRSTVWY"[c] for c in x)
    df = spark.createDataFrame([(i, text(x)) for i, x in enumerate(rows)], "id long, seq string")
    queries = spark.createDataFrame([(10**6 + i, text(x)) for i, x in enumerate(asked)], "id long, seq string")
    for parts in (1, 3):  # one after another, and with what others found
        corpus = df.withColumnRenamed("seq", "vec").repartitionByRange(parts, "id").sortWithinPartitions("id")
        for k in (1, 2, 3, 5, 40):
            found = align_jvm.found(np.arange(10**6, 10**6 + len(asked)), pa.array([text(x) for x in asked]), corpus, k)
            got = search.ranked(found, k).collect()
            want = []
            for i, a in enumerate(asked):
                best = sorted((-s, j) for j, s in enumerate(align.local_scores(a, rows).tolist()) if s)[:k]
                want += [(10**6 + i, j, -s, rk) for rk, (s, j) in enumerate(best, 1)]
            assert sorted((r["qid"], r["did"], int(r["score"]), r["rk"]) for r in got) == sorted(want)
    assert len(align.align_top_k(queries, df, 5).collect()) == 5 * len(asked)


def test_align_tasks_share_what_they_found(spark):
    """Later tasks give only what may still be among the best, not k rows for each query."""
    from kinfold.operators import align_jvm

    rng = np.random.default_rng(12)
    texts = ["".join("ACDEFGHIKLMNPQRSTVWY"[c] for c in rng.integers(0, 20, 40)) for _ in range(1600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, vec string").repartitionByRange(80, "id")
    found = align_jvm.found(np.arange(4), pa.array(texts[:4]), df, 10)
    rows = found.collect()
    assert len(rows) < 80 * 10 * 4 / 2 and len(set(rows)) == len(rows)
    assert search.ranked(found, 10).count() == search.ranked(found, 10).count() == 40  # a search may run again


def affine(a, b, s):
    """Cell by cell, a matrix each for gaps in either sequence."""
    h, e, f = (np.full((len(a) + 1, len(b) + 1), v) for v in (0, -(10**6), -(10**6)))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i, j] = max(h[i, j - 1] - s.gap_open, e[i, j - 1] - s.gap_extend)
            f[i, j] = max(h[i - 1, j] - s.gap_open, f[i - 1, j] - s.gap_extend)
            h[i, j] = max(0, h[i - 1, j - 1] + s.matrix[a[i - 1], b[j - 1]], e[i, j], f[i, j])
    return h.max()


def test_affine_scores_against_the_tables():
    rng = np.random.default_rng(6)
    matrix = rng.integers(-4, 3, (20, 20))
    matrix = np.minimum(matrix, matrix.T) + np.diag(rng.integers(4, 9, 20))
    base = rng.integers(0, 20, 50)
    others = [rng.integers(0, 20, n) for n in (0, 1, 30, 70)] + [base, np.r_[base[:20], base[26:]], np.r_[base[:30], rng.integers(0, 20, 7), base[30:]]]
    for first, more in ((11, 1), (3, 3), (5, 2)):
        s = align.Scoring(matrix, first, more)
        for a in (base, base[:9], base[:0]):
            assert align.affine_scores(a, others, s).tolist() == [affine(a, b, s) for b in others]


def test_align_hits_round_trip(spark, tmp_path):
    from kinfold.functions.sequences import RESIDUES
    from kinfold.sources.m8 import read_hits, write_hits

    lines = ["# a comment", "   " + " ".join(RESIDUES + "X")] + [" ".join([a, *("5" if a == b else "-2" for b in RESIDUES + "X")]) for a in RESIDUES + "X"]
    matrix = align.read_matrix("\n".join(lines))
    assert matrix.shape == (20, 20) and (np.diag(matrix) == 5).all() and matrix.sum() == 100 - 2 * 380
    base = RESIDUES * 2
    df = spark.createDataFrame([(1, base), (2, base[:15] + base[18:]), (3, base), (5, None), (None, base), (6, "")], "id long, seq string")
    got = align.align_hits(df.where("id = 1"), df, align.Scoring(matrix)).orderBy("rk").collect()
    assert [(r["target"], r["score"]) for r in got] == [(3, 200), (2, 185 - 13)]
    assert abs(got[0]["evalue"] / (0.041 * 40 * 117 * np.exp(-0.267 * 200)) - 1) < 1e-9
    write_hits(spark.createDataFrame([tuple(r) for r in got] + [(1, 9, None, 1, 3)], "query long, target long, evalue double, score long, rk long"), str(tmp_path / "h"))
    back = sorted(read_hits(spark, str(tmp_path / "h")).select("query", "target", "evalue").collect(), key=lambda r: r["evalue"])
    assert [tuple(r) for r in back] == [(r["query"], r["target"], r["evalue"]) for r in got]


def test_kmer_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACDEFG"), (2, "ACDEFG"), (3, "XCDEFG"), (4, "AC"), (5, None)], "id long, seq string")
    kmer_index.build(df, str(tmp_path / "ix"), 5)
    got = {(r["qid"], r["did"]): r["n"] for r in kmer_index.shared_kmers(spark, str(tmp_path / "ix"), df).collect()}
    assert got == {(1, 2): 2, (2, 1): 2, (1, 3): 1, (3, 1): 1, (2, 3): 1, (3, 2): 1}
    assert kmer_index.shared_kmers(spark, str(tmp_path / "ix"), df, least=2).count() == 2


def test_stream_of_queries(spark, tmp_path):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)], "id long, vec array<double>")
    for part in (0, 1):
        corpus.where(F.col("id") % 2 == part).limit(5).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in" / "*"))
    q = search_stream(stream, corpus, search.dot_block, 3, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "did", "rk")
    want = search.top_k(spark.read.parquet(str(tmp_path / "in" / "*")), corpus, search.dot_block, 3).select("qid", "did", "rk")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latency(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "id long, vec array<double>")
    t = latency.time_queries("dot", df, "id", lambda r: search.top_k_of_one(df.where(F.col("id") == r["id"]), df, V.dot, 3), n=8)
    assert t.count() == 8
    got = evaluate.median_after_warm_up(t, 5).first()
    assert got["n"] == 3 and got["median_ms"] > 0
    assert evaluate.median_after_warm_up(t, 8).count() == 0


def test_experiment_summary_has_the_production_budget(monkeypatch, spark):
    import inspect

    from kinfold.plans import catalog

    seen = {}
    real = inspect.signature(catalog.experiment)

    def record(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)

    monkeypatch.setattr(catalog, "experiment", record)
    catalog.experiment_summary(spark, "/root/testdata/sf0.001")
    assert seen["max_test"] == 3000 and seen["timed"] == 100


def test_maxsim_block_in_tiles(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, d = ([rng.normal(size=(n, 4)).astype(np.float32) for n in sizes] for sizes in ((3, 0, 9, 1, 2), (2, 7, 0, 1, 1, 4)))
    want = [[-np.inf if not len(y) else (x @ y.T).max(axis=1).sum() if len(x) else 0.0 for y in d] for x in q]
    kind = pa.list_(pa.list_(pa.float32()))
    monkeypatch.setattr(search, "QUERY_TOKENS", 4)
    monkeypatch.setattr(search, "CORPUS_TOKENS", 5)
    got = search.maxsim_block(pa.array([x.tolist() for x in q], kind), pa.array([x.tolist() for x in d], kind))
    assert np.allclose(got, want, atol=1e-5)
    assert [(s.stop - s.start, t.stop - t.start) for s, _, t in search._spans(np.array([2, 7, 1, 1, 4]), 5)] == [(1, 2), (1, 7), (2, 2), (1, 4)]
