import gzip

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import kmers as K
from kinfold.functions import vectors as V
from kinfold.functions.labels import family_key, superfamily_key
from kinfold.functions.sequences import RESIDUES, clean_sequence, is_strict, kmers, usable_proteins
from kinfold.operators import evaluate, groups, hits, minhash, ordering, search
from kinfold.operators.encode import HashEncoder, ProjectedEncoder, encode_pooled, encode_tokens, read_weights, tokenize
from kinfold.plans.experiment import experiment
from kinfold.operators.skew import eager_join_aggregate, middle_rows
from kinfold.session import Scratch
from kinfold.sources.fasta import classified, read_fasta, write_fasta
from kinfold.sources.m8 import read_dataset, read_hits
from kinfold.sources.stockholm import block_counts, read_clans, read_stockholm

SEQ = RESIDUES  # exactly 20 residues


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("label, key", [
    ("CL990001", "cl990001"), ("CL990001.12", "cl990001"), (" c.901​.1\xa0", "c.901.1"), ("C.901.1.7", "c.901.1"), ("", None),
    (None, None), ("-", None), ("X.x.x", None), ("x.x.x.x", None), ("﻿ㅤ - ", None), ("a.1", "a.1"), ("c­.1.2", "c.1.2"),
])
def test_superfamily_key(spark, label, key):
    assert one(spark, superfamily_key(F.col("x")), x=label) == key


@pytest.mark.parametrize("label, key", [("PF00001.12", "pf00001"), ("a.1.2.3", "a.1.2.3"), ("x.x.x.x", None), ("x.x.x", "x.x.x"), (None, None), (" ", None)])
def test_family_key(spark, label, key):
    assert one(spark, family_key(F.col("x")), x=label) == key


def test_clean_and_strict(spark):
    assert one(spark, clean_sequence(F.col("x")), x="ac-d 1\nEzxé*") == "ACDE"
    assert one(spark, clean_sequence(F.col("x")), x=None) is None
    assert not one(spark, is_strict(F.col("x")), x="ACD\n")
    assert one(spark, kmers(F.col("x"), 5), x="ACD") == []
    assert one(spark, kmers(F.col("x"), 2), x="AAAC") == ["AA", "AC"]


def proteins(spark, rows):
    return spark.createDataFrame(rows, "pid long, sequence string, superfamily string, loaded_at long, seq string, n string")


def test_usable_proteins_nulls_repeats_and_clashing_names(spark):
    df = proteins(spark, [(1, SEQ, "a", 1, "x", "y"), (1, SEQ, "a", 2, "x", "y"), (2, SEQ[:19], "a", 1, None, None), (3, None, "a", 1, None, None),
                          (None, SEQ, "a", 1, None, None), (4, SEQ * 25 + SEQ[:12], None, None, None, None), (5, SEQ * 26, "a", 1, None, None)])
    got = {r["pid"]: (r["n"], r["superfamily"]) for r in usable_proteins(df, "superfamily").collect()}
    assert got == {1: (20, "a"), 4: (512, None)}
    assert usable_proteins(df.where("false")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ACDY", max_size=30), max_size=12), st.lists(st.text(alphabet="ACDY", max_size=30), max_size=12))
def test_common_counts_against_sets(a, b):
    n = min(len(a), len(b))
    sets = lambda x: [{s[i : i + 3] for i in range(len(s) - 2)} for s in x[:n]]
    x, y, both = K.common_counts(pa.array(a[:n], pa.string()), pa.array(b[:n], pa.string()), 3)
    assert x.tolist() == [len(s) for s in sets(a)] and y.tolist() == [len(s) for s in sets(b)]
    assert both.tolist() == [len(p & q) for p, q in zip(sets(a), sets(b), strict=True)]


def test_middle_rows_against_sorting(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 else f"k{i % 11}", int(rng.integers(20, 40)), int(i * 7919 % 100003)) for i in range(3000)]
    rows += [(None, 25, 1), ("k", None, 2), ("k", 25, None), ("single", 20, 5), ("even", 20, 1), ("even", 20, 2)]
    df = spark.createDataFrame(rows, "key string, size int, id long").withColumn("_cnt", F.lit(1)).withColumn("_key", F.lit("x"))
    # spellings of a key, one that no row has, one of no key
    names = spark.createDataFrame([("hot", "hot"), ("k", "k"), *((f"k{i}", f"k{i % 6}") for i in range(11)), ("single", "single"), ("even", "even"), ("other", "y"), ("z", None)], "key string, name string")
    names = names.withColumn("size", F.lit(7))
    got = {r["name"]: r["id"] for r in middle_rows(df, names, "key", "name", "size", "id", Scratch(spark, "t"), id_bits=8).collect()}
    rows = [(f"k{int(k[1:]) % 6}" if k and k[1:].isdigit() else k, s, i) for k, s, i in rows]
    want = {}
    for k in {r[0] for r in rows if None not in r}:
        own = sorted((s, i) for key, s, i in rows if key == k and s is not None and i is not None)
        want[k] = own[(len(own) + 1) // 2 - 1][1]
    assert got == want
    assert middle_rows(df.where("false"), names, "key", "name", "size", "id", Scratch(spark, "t")).count() == 0
    assert middle_rows(df, names.where("false"), "key", "name", "size", "id", Scratch(spark, "t")).count() == 0
    twice = middle_rows(df, names.unionByName(names), "key", "name", "size", "id", Scratch(spark, "t"))
    assert {r["name"] for r in twice.collect()} == set(want) and twice.count() == len(want)


def test_eager_join_equals_join(spark):
    left = spark.createDataFrame([(i % 5 if i % 7 else None, i, "x") for i in range(200)], "k int, v int, g string")
    right = spark.createDataFrame([(i % 6, f"g{i % 3}" if i % 4 else None, i) for i in range(60)], "k int, g string, w int")
    got = eager_join_aggregate(left, right, "k", ["g"], {"v": F.col("v")}, {"w": F.col("w")})
    j = left.select("k", "v").join(right, "k").groupBy("g").agg(F.count("*").alias("n_pairs"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, j.collect()), key=repr)
    assert eager_join_aggregate(left.where("false"), right, "k", ["g"]).count() == 0
    got = eager_join_aggregate(left, right, "k", ["g"], left_group=["v"])
    j = left.select("k", "v").join(right, "k").groupBy("g", "v").agg(F.count("*").alias("n_pairs")).select("g", "v", "n_pairs")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, j.collect()), key=repr)


def test_number_rows_order_and_clashes(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 2, i, i) for i in range(100)], "k int, id long, _b long")
    got = ordering.number_rows(df, ["k"], F.shiftright("id", 3), [F.col("id")])
    assert got.columns == ["k", "id", "_b", "rn"]
    for k in (None, 0, 1):
        ids = [r["id"] for r in got.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("rn").collect()]
        assert ids == sorted(ids) and len(ids) > 10
    assert [r["rn"] for r in ordering.number_rows(df, [], F.shiftright("id", 3), [F.col("id")]).orderBy("id").collect()] == list(range(1, 101))
    assert ordering.number_rows(df.where("false"), [], F.lit(1), [F.col("id")]).count() == 0


def test_splits_are_disjoint_and_subsample_keeps_two(spark):
    df = spark.createDataFrame([(i, f"g{i % 13}" if i % 10 else None) for i in range(400)], "id long, label string")
    parts = {r["label"]: r["part"] for r in groups.split_groups(df, "label", 0.3).collect()}
    assert len(parts) == 13 and sum(p == "test" for p in parts.values()) == 3
    got = groups.subsample(df, "label", "id", 50).collect()
    assert len(got) == 50 and min(np.unique([r["label"] for r in got], return_counts=True)[1]) >= 2
    assert groups.subsample(df, "label", "id", 10).count() == 26  # two of each group, beyond the budget
    assert groups.subsample(df, "label", "id", 10_000).count() == 360
    pairs = groups.training_pairs(df, "label", "id").collect()
    label = {r["id"]: r["label"] for r in df.collect()}
    assert len(pairs) == 360 and all(p["anchor"] != p["positive"] and label[p["anchor"]] == label[p["positive"]] == p["label"] for p in pairs)
    assert groups.training_pairs(df.where("false"), "label", "id").count() == 0


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"id long, vec {kind}, label string")


def test_block_search_equals_expressions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "a") for i in range(60)] + [(100 + i, [1.0] * 8, "a") for i in range(5)]
    df = vectors(spark, rows)
    for block, expr in ((search.dot_block, V.dot), (search.cosine_block, V.cosine)):
        a = search.top_k(df.where("id % 7 = 0"), df, block, 10)
        b = search.top_k_expr(df.where("id % 7 = 0"), df, expr, 10)
        assert sorted((r["qid"], r["rk"], r["did"]) for r in a.collect()) == sorted((r["qid"], r["rk"], r["did"]) for r in b.collect())
    toks = vectors(spark, [(i, [[float(x) for x in rng.normal(size=4)] for _ in range(i % 4)], "a") for i in range(40)], "array<array<float>>")
    a = search.top_k(toks.where("id % 5 = 1"), toks, search.maxsim_block, 50)
    b = search.top_k_expr(toks.where("id % 5 = 1"), toks, V.maxsim, 50)
    key = lambda r: (r["qid"], r["rk"], r["did"], round(r["score"], 5))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_search_edges(spark):
    df = vectors(spark, [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, None, "a"), (None, [1.0, 1.0], "a")])
    got = search.top_k(df, df, search.dot_block, 100).collect()
    assert sorted((r["qid"], r["did"]) for r in got) == [(1, 2), (2, 1)]  # fewer than k rows, never itself
    assert search.top_k(df.where("false"), df, search.dot_block, 5).count() == 0
    assert search.top_k(df, df.where("false"), search.dot_block, 5).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_maxsim_properties(n, m, rnd):
    rng = np.random.default_rng(rnd.randint(0, 10**6))
    unit = lambda k: (x := rng.normal(size=(k, 4))) / np.linalg.norm(x, axis=1, keepdims=True)
    q, d = unit(n), unit(m)
    pack = lambda x: pa.array([x.tolist()], pa.list_(pa.list_(pa.float64())))
    s = search.maxsim_block(pack(q), pack(d))[0, 0]
    assert abs(s - search.maxsim_block(pack(q), pack(d[rng.permutation(m)]))[0, 0]) < 1e-9
    assert abs(search.maxsim_block(pack(q), pack(q))[0, 0] - n) < 1e-9 and abs(s) <= n + 1e-9


def test_recall_edges(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "id long, label string")
    ranked = spark.createDataFrame([(1, 2, 1), (1, 4, 2), (1, 3, 3), (4, 1, 1)], "qid long, did long, rk long")
    per = {(r["qid"], r["k"]): r["recall"] for r in evaluate.recall_per_query(ranked, labels, labels.select("id"), (1, 2, 3)).collect()}
    assert per[1, 1] == 1.0 and per[1, 2] == 0.5 and per[1, 3] == 1.0
    assert per[2, 1] == 0.0 and not any(q in (4, 5) for q, _ in per)  # no hits: 0; alone in its group: left out
    none = evaluate.recall_at_k(evaluate.recall_per_query(ranked.where("false"), labels.where("false"), labels.select("id")))
    assert [(r["recall"], r["n"]) for r in none.collect()] == [(0.0, 0)] * 4


def test_hits_ranking(spark):
    h = spark.createDataFrame([(1, 1, 1, 0.0), (2, 1, 2, 1e-5), (3, 1, 3, 1e-5), (4, 1, 2, 1e-9), (5, 1, 4, None), (6, None, 4, 1.0), (7, 2, 1, 0.0)],
                              "line_no long, query long, target long, evalue double")
    ranked = lambda **x: [(r["qid"], r["did"]) for r in hits.rank_hits(h, **x).orderBy("qid", "rk").collect()]
    assert ranked() == [(1, 2), (1, 3), (1, 4), (2, 1)]
    assert ranked(dedupe=False) == [(1, 2), (1, 2), (1, 3), (1, 4), (2, 1)]
    assert ranked(k=1) == [(1, 2), (2, 1)]
    lines = spark.createDataFrame([(1, "f", "c1"), (2, "f", ""), (3, "f", "c2"), (4, "g", None), (5, None, "c")], "n long, f string, c string")
    assert [tuple(r) for r in hits.last_mapping(lines, "f", "c", "n").collect()] == [("f", "c2")]


def test_minhash_estimates_jaccard(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list(RESIDUES), 300))
    rows = [(0, base)] + [(i, "".join(c if rng.random() > i * 0.01 else "A" for c in base)) for i in range(1, 6)] + [(9, "ACD"), (10, None)]
    df = spark.createDataFrame(rows, "id long, seq string")
    sigs = {r["id"]: np.array(r["sig"]) for r in minhash.signatures(df).collect()}
    assert set(sigs) == set(range(6))
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    for i, s in rows[1:6]:
        exact = len(grams(base) & grams(s)) / len(grams(base) | grams(s))
        assert abs((sigs[0] == sigs[i]).mean() - exact) < 4 * np.sqrt(0.25 / 256)


def test_loss_ema_is_the_fold(spark):
    rng = np.random.default_rng(4)
    rows = [("e" if i % 2 else "f", i * 3, float(rng.random())) for i in range(3000)] + [("g", 1, 2.0), ("h", 1, None)]
    got = {r["epoch"]: r["ema"] for r in evaluate.loss_ema(spark.createDataFrame(rows, "epoch string, step long, loss double"), bucket_bits=6).collect()}
    for e in "efg":
        xs = [x for k, _, x in rows if k == e]
        r = xs[0]
        for x in xs[1:]:
            r = 0.98 * r + 0.02 * x
        assert abs(got[e] - r) < 1e-9
    assert "h" not in got


def test_encoder_and_tokens(spark):
    df = spark.createDataFrame([(1, SEQ), (2, SEQ * 20), (3, None)], "id long, seq string")
    got = {r["id"]: r["toks"] for r in encode_tokens(df, HashEncoder(8)).collect()}
    assert len(got[1]) == 22 and len(got[2]) == 256 and abs(np.linalg.norm(got[1][3]) - 1) < 1e-5
    assert {r[0]: len(r[1]) for r in df.dropna().select("id", tokenize(F.col("seq"))).collect()} == {1: 22, 2: 256}


def test_pooled_encodings_equal_the_expression(spark):
    df = spark.createDataFrame([(1, SEQ), (2, SEQ[:7] * 3), (3, None), (4, "")], "id long, seq string")
    enc = HashEncoder(8)
    toks = encode_tokens(df, enc)
    for inner, expr in ((False, V.mean_pool(F.col("toks"), 8)), (True, V.mean_pool_inner(F.col("toks"), 8))):
        want = {r["id"]: r["v"] for r in toks.select("id", expr.alias("v")).collect()}
        got = {r["id"]: r["vec"] for r in encode_pooled(df, enc, inner).collect()}
        assert set(got) == set(want) == {1, 2, 4}
        assert all(np.allclose(got[i], want[i], atol=1e-6) for i in got)


def test_experiment(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = rng.choice(list(RESIDUES), 60)
        rows += [(g * 10 + i, "".join(c if rng.random() > 0.1 else "A" for c in base), f"g{g}") for i in range(5)]
    df = spark.createDataFrame([*rows, (999, None, "g1"), (998, SEQ, None)], "pid long, seq string, label string")
    got = {r["method"]: r for r in experiment(df, HashEncoder(16), Scratch(spark, "x"), test_frac=0.5, max_test=1000).collect()}
    assert set(got) == {"late interaction", "mean pool, dot", "mean pool, cosine", "MinHash"}
    assert float(got["late interaction"]["r_at_5"]) > 0.95 and float(got["MinHash"]["r_at_5"]) > 0.9
    assert {r["median_ms"] for r in got.values()} == {"n/a"}
    assert experiment(df.where("false"), HashEncoder(16), Scratch(spark, "x")).count() == 4


def test_projections(spark, tmp_path):
    df = spark.createDataFrame([(1, SEQ), (2, SEQ[:7] * 3), (4, "")], "id long, seq string")
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(3, 8))
    spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "row int, weights array<double>").write.parquet(str(tmp_path / "w"))
    assert np.allclose(read_weights(spark, str(tmp_path / "w")), weights)
    plain = {r["id"]: np.array(r["toks"]) for r in encode_tokens(df, HashEncoder(8)).collect()}
    for r in encode_tokens(df, ProjectedEncoder(HashEncoder(8), weights)).collect():
        want = plain[r["id"]] @ weights.T
        assert np.allclose(r["toks"], want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)
    given = spark.createDataFrame([(i, t.tolist()) for i, t in plain.items()], "id long, toks array<array<double>>")
    want = {r["id"]: r["v"] for r in given.select("id", V.project(V.mean_pool(F.col("toks"), 8), weights).alias("v")).collect()}
    got = {r["id"]: r["vec"] for r in encode_pooled(df, HashEncoder(8), weights=weights).collect()}
    assert set(got) == {1, 2, 4} and all(np.allclose(got[i], want[i], atol=1e-6) for i in got)
    with pytest.raises(ValueError):
        ProjectedEncoder(HashEncoder(4), weights)


def test_blocks_of_queries_one_after_another(spark, monkeypatch):
    """More than one block: each is written before the next; all scores and the k best."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame([*rows, (None, [0.0] * 4), (99, None)], "id long, vec array<double>")
    asked = df.where("id < 11 or id is null")
    want = sorted(map(tuple, search.top_k(asked, df, search.dot_block, 5).collect()))
    every = sorted(map(tuple, search.all_scores(asked, df, search.dot_block).collect()))
    monkeypatch.setattr(search, "QUERY_ROWS", 4)
    assert sorted(map(tuple, search.top_k(asked, df, search.dot_block, 5).collect())) == want and len(want) == 55
    assert sorted(map(tuple, search.all_scores(asked, df, search.dot_block).collect())) == every and len(every) == 11 * 29


def test_jaccard_and_agreement_blocks_against_sets():
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("ACDE"), n)) for n in (0, 3, 5, 9, 40, 41, 60)]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    got = minhash.jaccard_block(3)(pa.array(texts[:4]), pa.array(texts))
    for i in range(4):
        for j in range(7):
            both = len(sets[i] & sets[j])
            assert got[i, j] == (both / len(sets[i] | sets[j]) if both else -np.inf)
    a, b = rng.integers(0, 3, (70, 16)), rng.integers(0, 3, (5, 16))
    kind = pa.list_(pa.int64())
    got = search.agreement_block(pa.array(a.tolist(), kind), pa.array(b.tolist(), kind))
    assert np.allclose(got, (a[:, None, :] == b[None, :, :]).mean(axis=2))


@pytest.mark.parametrize("first", [5, 10**6])
def test_agreement_by_value_is_that_of_all_pairs(spark, monkeypatch, first):
    """Ties by id, ranks filled up with pairs that agree nowhere, few matches and rows at once."""
    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list(RESIDUES), 60)) for _ in range(4)]
    rows = [(7 * i - 20, "".join(c if rng.random() > 0.2 else "A" for c in base[i % 4])[: 8 + i]) for i in range(50)] + [(900, "ACD"), (901, None), (None, base[0]), (-99, base[0][:40])]
    df = spark.createDataFrame(rows, "id long, seq string").repartition(3)
    asked = df.where("id % 3 = 0 or id in (-99, 900)")
    sign = lambda x: minhash.signatures(x, n=32).withColumnRenamed("sig", "vec")
    monkeypatch.setattr(minhash, "FIRST", first)
    monkeypatch.setattr(minhash, "QUERY_ROWS", 6)
    monkeypatch.setattr(minhash, "MATCHES", 50)
    monkeypatch.setattr(minhash, "HELD", 40)
    # signatures of all are held by no block of pairs
    for top in (3, 40):
        want = sorted(map(tuple, search.top_k(sign(asked), sign(df), search.agreement_block, top).select("qid", "did", "score", "rk").collect()))
        got = minhash.agreement_top_k(asked, df, Scratch(spark, "test"), top, n=32)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_stockholm_paths_and_empty_lines(spark, tmp_path):
    one = "# STOCKHOLM 1.0\n#=GF AC PF1.2\n#=GF AC\nA/1 " + SEQ + "\n//\n"
    (tmp_path / "a.sto").write_text(one)
    (tmp_path / "b.sto.gz").write_bytes(gzip.compress(one.replace("PF1", "PF2").encode()))
    (tmp_path / "_c.sto").write_text(one)
    for path, families in ((str(tmp_path), {"PF1", "PF2"}), (f"file://{tmp_path}/*.gz", {"PF2"}), (f"file://{tmp_path}/a.sto", {"PF1"})):
        rows = read_stockholm(spark, path).where("sid is not null").collect()
        assert {r["family"] for r in rows} == families and {r["gapped"] for r in rows} == {SEQ}


FASTA = ">d1 a.1.1.1 (A:) x\nacdefghikl\n\nmnpqrstvwy\n>d2\r\nACDEFGHIKLMNPQRSTVW\r\n  >d3 b.1.2.3.4\nACDEFGHIKLMNPQRSTVWY\n>d4 c.1\nACDEFGHIKLMNPQRSTVWX\n>d5 c.1.1.1"


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    raw = {r["sid"]: (r["sccs"], r["sequence"]) for r in read_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert raw == {"d1": ("a.1.1.1", SEQ), "d2": ("x.x.x.x", SEQ[:19]), "d3": ("b.1.2.3.4", SEQ), "d4": ("c.1", SEQ[:19] + "X"), "d5": ("c.1.1.1", "")}
    kept = {r["sid"]: (r["superfamily"], r["family"]) for r in classified(read_fasta(spark, str(tmp_path / "x.fa"))).collect()}
    assert kept == {"d1": ("a.1.1", "a.1.1.1"), "d3": ("b.1.2", "b.1.2.3.4")}
    write_fasta(spark.createDataFrame([(7, SEQ)], "pid long, seq string"), str(tmp_path / "out"))
    assert [(r["sid"], r["sequence"]) for r in read_fasta(spark, str(tmp_path / "out")).collect()] == [("7", SEQ)]


def test_stockholm(spark, tmp_path):
    block = "# STOCKHOLM 1.0\n#=GF ID   fam one\n#=GF AC   PF00001.12\n" + "".join(f"S{i}/1-20  {SEQ[:10]}..{SEQ[10:].lower()}Z\n" for i in range(52)) + "S0/1-20 AC\n//\n"
    other = "# STOCKHOLM 1.0\n#=GF AC PF00009.1\nA/1-4 " + SEQ + "\n//\n# STOCKHOLM 1.0\n#=GF ID no acc\nB/1 " + SEQ + "\n//\n#=GF AC PF00001.1\nC/1 " + SEQ + "\n"
    (tmp_path / "s.gz").write_bytes(gzip.compress((block + "#=GF CC \xdf\n" + other).encode("latin-1")))
    (tmp_path / "c.tsv.gz").write_bytes(gzip.compress("PF00001\tCL1\tx\ty\tz\nPF00009\t\tx\ty\tz\nPF00001\tCL0002\tx\ty\tz\nPF00003\n".encode("latin-1")))
    got = read_dataset(spark, "pfam", str(tmp_path / "s.gz"), str(tmp_path / "c.tsv.gz")).collect()
    assert len(got) == 50 and {r["superfamily"] for r in got} == {"CL0002"} and {r["sequence"] for r in got} == {SEQ} and {r["family_name"] for r in got} == {"fam one"}
    counts = block_counts(read_stockholm(spark, str(tmp_path / "s.gz")), read_clans(spark, str(tmp_path / "c.tsv.gz"))).first()
    assert tuple(counts) == (3, 1)  # the last block isn't closed
    with pytest.raises(ValueError):
        read_dataset(spark, "other", "x")


def test_m8(spark, tmp_path):
    (tmp_path / "h.m8").write_text("0\t1\t1e-5\n0\t2\n0\t3\t2.5\textra\n")
    assert [(r["query"], r["target"], r["evalue"]) for r in read_hits(spark, str(tmp_path / "h.m8")).collect()] == [(0, 1, 1e-5), (0, 3, 2.5)]
    (tmp_path / "bad.m8").write_text("0\tx\t1e-5\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_hits(spark, str(tmp_path / "bad.m8")).collect()


def test_plans(spark):
    """Ranks are cut before the shuffle, and counts are combined before a join."""
    df = spark.createDataFrame([(1, "a", 2)], "id long, label string, k int")
    plan = ordering.first_rows(df, ["label"], [F.col("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = eager_join_aggregate(df, df.select("k", F.col("label").alias("g")), "k", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.index("HashAggregate") < plan.index("Join")
