import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions.sequences import RESIDUES
from kinfold.llm import chunking, leakage, near_duplicates, overlap, packed_join, packing, tokens
from kinfold.llm.components import GroupedSplits, grouped_splits, hash_to_min
from kinfold.llm.near_duplicates import NearDuplicates
from kinfold.llm.overlap import SplitOverlap, current_split
from kinfold.llm.packing import best_fit, evolve, pack
from kinfold.llm.quota_sample import QuotaSample
from kinfold.session import Scratch

PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\p{C}]"


def scratch(spark):
    return Scratch(spark, "test")


# --- 1: splits ----------------------------------------------------------------


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_hash_to_min_on_chains_stars_and_nulls(spark):
    rnd = random.Random(5)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("star", f"s{i}") for i in range(200)] + [("self", "self"), ("x", "y"), ("y", "x"), ("x", "y")]
    edges += [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, "q"), ("q2", None)], "a string, b string")
    got = {r["node"]: r["root"] for r in hash_to_min(df, scratch(spark)).collect()}
    assert got == roots(edges)
    assert hash_to_min(df.where("false"), scratch(spark)).count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "pid long, superfamily string, family string, component string, n long")


KEYS = {"superfamily": "s", "family": "f"}


def test_grouped_splits_close_to_the_shares_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 400}", f"f{i % 1000}" if i % 7 == 1 else None, "x", 1) for i in range(6000)]
    rows += [(6000 + i, None, None, None, None) for i in range(200)] + [rows[0]] * 50 + [(None, "hot", "f1", None, None)]
    got = grouped_splits(records(spark, rows), "pid", KEYS, {"train": 0.8, "validation": 0.05, "test": 0.15, "none": 0.0, "null": None}, scratch(spark)).collect()
    assert len(got) == 6200 == len({r["pid"] for r in got})
    n = {s: sum(r["split"] == s for r in got) / 6200 for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.03 and abs(n["test"] - 0.15) < 0.03 and abs(n["validation"] - 0.05) < 0.03
    split = {r["pid"]: r["split"] for r in got}
    for col in (1, 2):
        by = {}
        for r in rows:
            if r[0] is not None and r[col] is not None:
                by.setdefault(r[col], set()).add(split[r[0]])
        assert all(len(s) == 1 for s in by.values())


def test_a_new_record_moves_no_other_component(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 300}", f"f{i % 900}" if i % 7 == 1 else None, "x", 1) for i in range(3000)]
    first = GroupedSplits(records(spark, rows), "pid", KEYS, {"train": 0.8, "test": 0.2}, scratch(spark))
    more = [*rows, *[(9000 + i, "new", None, "x", 1) for i in range(400)], (9900, "hot", None, "x", 1), (9901, None, None, "x", 1), (None, "n1", "n2", "x", 1)]
    again = GroupedSplits(records(spark, more), "pid", KEYS, {"train": 0.8, "test": 0.2}, scratch(spark), seed=first.seed)
    before = {r["pid"]: r["split"] for r in first.splits.collect()}
    after = {r["pid"]: r["split"] for r in again.splits.collect()}
    assert len(after) == 3402 and all(after[p] == s for p, s in before.items())
    assert {r["component"]: r["n"] for r in again.assigned.collect()}["f:n2"] == 0


def test_the_seed_that_is_taken_comes_close(spark):
    rows = [(i, "big" if i < 300 else f"s{i % 70}", None, "x", 1) for i in range(1000)]
    for tolerance in (0.0, 0.03):
        got = GroupedSplits(records(spark, rows), "pid", KEYS, {"a": 0.6, "b": 0.4}, scratch(spark), tolerance=tolerance)
        a = sum(r["n"] for r in got.assigned.where("split = 'a'").collect())
        assert abs(a / 1000 - 0.6) < 0.03
    assert GroupedSplits(records(spark, rows), "pid", KEYS, {"a": 1.0}, scratch(spark)).seed == 0


def test_linked_keys_are_those_of_one_split(spark):
    rows = [(1, "a", "f", None, None), (2, "b", "f", None, None), (None, "b", "g", None, None), (3, "c", "g", None, None), (4, "d", "h", None, None), (5, None, None, None, None)]
    got = GroupedSplits(records(spark, rows), "pid", KEYS, {"x": 1.0, "y": 1.0}, scratch(spark))
    pairs = got.linked("superfamily").collect()
    assert {(r[0], r[1]) for r in pairs} == {("a", "b"), ("a", "c"), ("b", "c")} and len({r["split"] for r in pairs}) == 1


def test_ids_whose_rows_differ_link_their_keys(spark):
    rows = [(1, "a", None, None, None), (1, "b", None, None, None), (1, "c", None, None, None), (2, "a", None, None, None), (3, "b", None, None, None), (4, "c", None, None, None)]
    got = grouped_splits(records(spark, rows), "pid", KEYS, {"a": 1.0, "b": 1.0}, scratch(spark)).collect()
    assert len(got) == 4 and len({r["component"] for r in got}) == 1
    assert grouped_splits(records(spark, rows).where("false"), "pid", KEYS, {"a": 1.0}, scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        grouped_splits(records(spark, rows), "pid", KEYS, {"a": 0.0}, scratch(spark))


# --- 3 and 4: near duplicates, overlap -----------------------------------------


def grams(s, k=5):
    return {s[i : i + k] for i in range(len(s) - k + 1)}


def mutated(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], [rnd.choice(RESIDUES)], [s[i], rnd.choice(RESIDUES)]])
    return "".join(s)


def family(seed):
    """Edits, insertions, moved halves, copies, repeats, few letters, short texts."""
    rnd = random.Random(seed)
    out = []
    for _ in range(25):
        base = "".join(rnd.choice(RESIDUES) for _ in range(rnd.choice([20, 40, 120, 300])))
        cut = len(base) // 2
        out += [base, base, base[cut:] + base[:cut], base[: max(5, cut)], base + base[:7]]
        out += [mutated(rnd, base, n) for n in (1, 2, 4, 7, 10)]
    out += ["A" * 20, "A" * 30, "AC" * 15, "AC" * 20, "ACD" * 9, "AAC" * 12, "ACDE", "", "AAAAAC", "AAAAACA"]
    return [(i, s) for i, s in enumerate(out)]


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_near_duplicates_lose_no_pair(spark, t):
    rows = family(1)
    near = NearDuplicates(spark.createDataFrame(rows, "id long, seq string").withColumn("sig", F.lit(1)), scratch(spark), 5, t)
    sets = {i: grams(s) for i, s in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * t.denominator >= len(sets[a] | sets[b]) * t.numerator}
    got = [(r["id_a"], r["id_b"]) for r in near.all_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    per = {r["id"]: r for r in near.groups(scratch(spark)).collect()}
    assert {i: r["n_links"] for i, r in per.items()} == {i: links.get(i, 0) for i, s in sets.items() if s}
    up = roots([*want, *((i, i) for i, s in sets.items() if s)])
    assert {i: r["group_id"] for i, r in per.items()} == up


def test_keys_take_turns_and_leave_nothing_on_disk(spark, monkeypatch):
    """With all turns no pair is lost, a turn has its share of the keys, and what was shuffled is gone."""
    import time

    blocks = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    rows = family(3)
    reps = spark.createDataFrame(rows, "id long, seq string")
    monkeypatch.setattr(near_duplicates, "TURN_KEYS", 100)
    before = blocks()
    near = NearDuplicates(reps, scratch(spark))
    until = time.time() + 20
    while blocks() - before and time.time() < until:
        time.sleep(0.2)
    assert not blocks() - before
    sets = {i: grams(s) for i, s in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(r["id_a"], r["id_b"]) for r in near.all_pairs().collect()} == want
    rnd = random.Random(4)
    texts = pa.RecordBatch.from_arrays([pa.array(["".join(rnd.choice(RESIDUES) for _ in range(200)) for _ in range(50)])], names=["seq"])
    known = near_duplicates.kmer_frequencies(reps, 5)
    count = lambda *turn: sum(len(r) for r, _ in near_duplicates.keys_of(texts, 5, Fraction(1, 2), known, *turn))
    assert all(count(i, 4) < 0.4 * count() for i in range(4))


def test_no_pair_is_lost_behind_a_shared_domain(spark, monkeypatch):
    """Long and short domains in many texts; near copies with and without them."""
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice(RESIDUES) for _ in range(n))
    domains = [letters(n) for n in (25, 60, 110, 200)]
    out = []
    for i in range(160):
        own, at = letters(rnd.choice([30, 60, 100])), rnd.randrange(30)
        base = own[:at] + domains[i % 4] + own[at:]
        out += [base, mutated(rnd, base, 3), own + domains[i % 3][:40]] if i % 4 == 0 else [base]
    rows = list(enumerate(out))
    sets = {i: grams(s) for i, s in rows}
    # the last: nothing is frequent; keys that more than 3 have are cut into blocks of about 5
    monkeypatch.setattr(near_duplicates, "PAIRED", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", 5)
    for times, least in ((0.5, 1), (2, 8), (8, 10**6)):
        monkeypatch.setattr(near_duplicates, "HOT_TIMES", times)
        monkeypatch.setattr(near_duplicates, "HOT_LEAST", least)
        reps = spark.createDataFrame(rows, "id long, seq string")
        known = near_duplicates.kmer_frequencies(reps, 5)
        assert (known.levels >= known.hot).any() == (least < 10**6)
        for t in (Fraction(1, 2), Fraction(4, 5)):
            want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * t.denominator >= len(sets[a] | sets[b]) * t.numerator}
            assert {(r["id_a"], r["id_b"]) for r in NearDuplicates(reps, scratch(spark), 5, t).all_pairs().collect()} == want


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, "ACD")], "id long, seq string")
    for x in (df, df.where("false")):
        near = NearDuplicates(x, scratch(spark))
        assert near.all_pairs().count() == 0 and near.groups(scratch(spark)).count() == 0


def test_a_group_of_copies_is_one_text(spark):
    rnd = random.Random(2)
    base = "".join(rnd.choice(RESIDUES) for _ in range(100))
    rows = [(i, base) for i in range(500)] + [(1000, mutated(rnd, base, 1))]
    near = NearDuplicates(spark.createDataFrame(rows, "id long, seq string"), scratch(spark))
    assert near.pairs.count() == 1
    assert {r["id"]: r["n_links"] for r in near.groups(scratch(spark)).collect()}[7] == 500


def test_frequencies_are_counts(spark):
    rnd = random.Random(6)
    seqs = ["".join(rnd.choice("ACD") for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    known = near_duplicates.kmer_frequencies(spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3), 5)
    count = {}
    for s in seqs:
        for i in range(len(s) - 4):
            count[s[i : i + 5]] = count.get(s[i : i + 5], 0) + 1
    row, code, _ = near_duplicates._sets(pa.array(list(count)), 5)
    assert [near_duplicates.Frequencies.level(n) for n in count.values()] == known.of(code[np.argsort(row)]).tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12)), max_size=30), min_size=1, max_size=3), st.integers(1, 4), st.integers(1, 5), st.booleans())
def test_keys_meet_over_any_blocks(blocks, parts, paired, sides):
    """Packed, unpacked and sorted: keys that several texts have, one at least not large."""
    cut, flat = {}, []
    for b in blocks:
        if not b:
            continue
        rows = np.array(sorted(x for x, _ in b))
        sigs = np.array([s for _, s in sorted(b)], np.uint64)
        key = sigs >> np.uint64(1)
        batch = packed_join.pack(np.arange(100, 131), rows, key % np.uint64(parts), key // np.uint64(parts), sigs & np.uint64(1))
        for p, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
            cut.setdefault(p, []).append(block)
        flat += [(int(s), 100 + int(r)) for r, s in zip(rows, sigs, strict=True)]
    got, heavy = set(), set()
    for p, found in cut.items():
        batch = pa.RecordBatch.from_arrays([pa.array([p] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["part", "block"])
        for out in packed_join.meet(paired, sides)(iter([batch])):
            for r in out.to_pylist():
                (got if r["large"] is None else heavy).add((r["a"], r["b"]) if r["large"] is None else r["a"])
    want, many = set(), set()
    for key in {s >> 1 for s, _ in flat}:
        mine = [(s & 1, i) for s, i in flat if s >> 1 == key]
        if all(large for large, _ in mine) or len(mine) < 2 or (sides and not any(large for large, _ in mine)):
            continue
        if len(mine) > paired:
            many |= {i for _, i in mine}
        else:
            if sides:
                odd = (key % parts) % 2
                want |= {(j, i) if odd else (i, j) for x, i in mine for y, j in mine if i != j and not x and y}
            else:
                want |= {(min(i, j), max(i, j)) for x, i in mine for y, j in mine if i != j and not (x and y)}
    assert got == want and heavy == many


@pytest.mark.parametrize("c", [Fraction(4, 5), Fraction(1, 2)])
def test_overlap_loses_no_pair(spark, c):
    rnd = random.Random(3)
    rows = [(i, s, rnd.choice(["train", "validation", "test", None])) for i, s in family(4)]
    found = SplitOverlap(spark.createDataFrame(rows, "id long, seq string, split string").withColumn("m", F.lit(0)), scratch(spark), 5, c)
    want = set()
    for e, s, x in rows:
        for t, u, y in rows:
            least = min(len(grams(s)), len(grams(u)))
            if x in ("validation", "test") and y == "train" and least and len(grams(s) & grams(u)) * c.denominator >= least * c.numerator:
                want.add((e, t))
    got = [(r["eval_id"], r["train_id"]) for r in found.pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    per = {r["split"]: r for r in found.counts(spark.createDataFrame([(0, "x")], "id long, source string"), ["split"]).collect()}
    for split in ("validation", "test"):
        ids = {i for i, s, x in rows if x == split and grams(s)}
        assert (per[split]["n_pairs"], per[split]["n_eval"], per[split]["n_contained"]) == (sum(e in ids for e, _ in want), len(ids), len({e for e, _ in want if e in ids}))


def test_walks_are_those_of_the_set(monkeypatch):
    """Also where a text of few letters has so many that they come in parts."""
    monkeypatch.setattr(overlap, "WALKS", 7)
    rnd = random.Random(12)
    seqs = ["".join(rnd.choice("AC") for _ in range(90)), "".join(rnd.choice(RESIDUES) for _ in range(60)), "ACD"]
    got = {1: set(), 3: set()}
    for m, row, gram in overlap.larger_side(pa.RecordBatch.from_arrays([pa.array(seqs)], names=["seq"]), 5, {1, 3}):
        got[m] |= set(zip(row.tolist(), gram.tolist(), strict=True))
    number = lambda s: sum(RESIDUES.index(c) * 20 ** (len(s) - 1 - i) for i, c in enumerate(s))
    want = {1: set(), 3: set()}
    for r, s in enumerate(seqs):
        have = grams(s)
        want[1] |= {(r, number(g)) for g in have}
        want[3] |= {(r, number(g + x + y)) for g in have for x in RESIDUES for y in RESIDUES if (g + x)[1:] in have and (g + x + y)[2:] in have}
    assert got == want


def test_overlap_with_hot_grams_and_a_full_table(spark, monkeypatch):
    """N-grams of more than 3 texts are joined in blocks of about 4. A full table lets
    every n-gram of the larger sides pass."""
    monkeypatch.setattr(overlap, "PAIRED", 3)
    monkeypatch.setattr(overlap, "BLOCK_SETS", 4)
    rnd = random.Random(13)
    base = "".join(rnd.choice(RESIDUES) for _ in range(80))
    rows = [(i, mutated(rnd, base, i % 4), "train" if i % 3 else "test") for i in range(45)]
    found = {tuple(r) for r in SplitOverlap(spark.createDataFrame(rows, "id long, seq string, split string"), scratch(spark)).pairs.select("eval_id", "train_id").collect()}
    close = lambda s, u: len(grams(s) & grams(u)) * 5 >= min(len(grams(s)), len(grams(u))) * 4
    assert found == {(e, t) for e, s, x in rows for t, u, y in rows if x == "test" and y == "train" and close(s, u)}
    full = overlap.GramTable(np.full((1 << overlap.TABLE_BITS) // 8, 255, np.uint8), {0: {4}, 1: {4}})
    assert full.has(np.arange(1000, dtype=np.uint64) << np.uint64(50)).all()


def test_overlap_of_nothing(spark):
    df = spark.createDataFrame([(1, "A" * 30, "train")], "id long, seq string, split string")
    for x in (df, df.where("false"), df.withColumn("split", F.lit(None).cast("string"))):
        assert SplitOverlap(x, scratch(spark)).pairs.count() == 0


def test_current_split(spark):
    rows = [(1, "train", 1), (1, " Valid​", 2), (2, "TEST", 1), (2, None, 2), (3, "Training\t", None), (4, "odd", 1), (None, "train", 1), (5, "val", 1), (5, None, 1), (6, "test", 1), (6, "test", 1)]
    df = spark.createDataFrame(rows, "pid long, split string, assigned_at long")
    assert {r["pid"]: r["split"] for r in current_split(df).collect()} == {1: "validation", 3: "train", 6: "test"}


# --- 5: quotas ----------------------------------------------------------------


def quotas(spark, records, targets):
    r = spark.createDataFrame(records, "id long, leaf string").withColumn("wanted", F.lit(1))
    t = spark.createDataFrame(targets, "leaf string, share_per_10000 int, min_rows int, sample_rows long")
    return QuotaSample(r, t, scratch(spark))


def test_unmet_quota_goes_to_siblings_then_cousins(spark):
    recs = [(i, leaf) for i, leaf in enumerate(["a.1.1"] * 5 + ["a.1.2"] * 12 + ["a.2.1"] * 100 + ["b.1.1"] * 100 + [None] * 50)]
    q = quotas(spark, recs, [("a.1.1", 2000, 0, 100), ("a.1.2", 1000, 0, 100), ("a.2.1", 3000, 0, 100), ("b.1.1", 1000, None, 100), (None, 3000, 0, 100)])
    got = {r["leaf"]: (r["wanted"], r["quota"], r["short"], r["unmet"]) for r in q.report.collect()}
    # 15 are missing: 2 go to the sibling, 13 to the cousin of the class, none further
    assert got["a.1.1"][:3] == (20, 5, 15) and got["a.1.2"][1] == 12 and got["a.2.1"][1] == 43
    assert got["b.1.1"][1] == 10 and got["*"][1] == 30 and all(x[3] == 0 for x in got.values())
    drawn = [r["leaf"] for r in q.sample.collect()]
    assert {x: drawn.count(x) for x in set(drawn)} == {"a.1.1": 5, "a.1.2": 12, "a.2.1": 43, "b.1.1": 10, "*": 30}


def test_quota_edges(spark):
    q = quotas(spark, [(1, "a.1.1"), (2, None)], [("a.1.1", 0, 5, 10), ("cl1", None, 3, None), ("a.1.1", 10000, 1, 10)])
    got = {r["leaf"]: (r["wanted"], r["quota"], r["short"], r["unmet"]) for r in q.report.collect()}
    assert got == {"a.1.1": (10, 1, 9, 9), "cl1": (3, 0, 3, 3)} and q.sample.count() == 1
    empty = quotas(spark, [], [("a.1.1", 10000, 1, 10)])
    assert empty.sample.count() == 0 and empty.report.first()["short"] == 10
    assert quotas(spark, [(1, "a.1.1")], []).sample.count() == 0


# --- 6 and 8: sizes, containers, pieces -----------------------------------------

TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab_1 .\n\r\t-é​́"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_sizes_against_the_pattern(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    assert tokens.sizes_of(batch).tolist() == [len(regex.findall(PATTERN, t or "")) for t in texts]


def test_sizes_of_a_slice_and_a_very_long_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["é b", None, "c-d", "x y " * 1_500_000, ""], pa.string())], names=["text"])
    parts = list(tokens.slices(batch.slice(1)))
    assert [x for p in parts for x in tokens.sizes_of(p).tolist()] == [0, 3, 3_000_000, 0]


def sizes_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, size long").withColumn("part", F.lit(9)).withColumn("block", F.lit("x"))


def test_packing_is_a_partition_within_capacity(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 100)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 1, 30, 64, 65, 100, 101, 250, rnd.randrange(1, 100)])) for i in range(900)]
    extra = [(5000, None), (None, 5), (7, 3), rows[3]]
    got = pack(sizes_frame(spark, rows + extra), 100, scratch(spark)).collect()
    want = dict(rows) | {5000: 0}
    want[7] = max(want[7], 3)
    total, fill = {}, {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["size"]
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["size"]
        assert r["first_token"] == r["part"] * 100
    assert total == want and max(fill.values()) <= 100
    assert all(sum(x["doc_id"] == d for x in got) == max(1, -(-s // 100)) for d, s in list(want.items())[:80])
    # the sum of sizes is no bound to aim at, as most items fill more than half;
    # best-fit decreasing over all items at once is what blocks have to come up to
    rest = [s % 100 if s > 100 else s for s in want.values()]
    at_once = best_fit(rest, sorted(range(len(rest)), key=lambda i: -rest[i]), 100, [])
    assert len(fill) <= (len(at_once) + sum(s // 100 for s in want.values() if s > 100)) * 1.01 + 1
    assert pack(sizes_frame(spark, []), 100, scratch(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(0, 5))
def test_evolution_keeps_every_item_and_never_loses_to_best_fit(sizes, seed):
    got = evolve(sizes, 50, [], str(seed))
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in got)
    assert len(got) <= len(best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 50, []))


def best_fit_bins(sizes, capacity):
    return len(best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity, []))


def test_evolution_uses_fewer_bins_than_best_fit():
    """Triples that fill bins, and items of which at most three go into one."""
    rnd = random.Random(4)
    triples = []
    for _ in range(40):
        a = rnd.randint(380, 490)
        b = rnd.randint(250, (1000 - a) // 2)
        triples += [a, b, 1000 - a - b]
    for sizes, saved in ((triples, 3), ([rnd.randint(260, 519) for _ in range(600)], 5)):
        bins = evolve(sizes, 1000, [], "seed")
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in bins) <= 1000
        assert packing.least_bins(sizes, 1000) <= len(bins) <= best_fit_bins(sizes, 1000) - saved


def fewest(sizes, capacity):
    """By trying every bin for every item."""
    best = len(sizes) or 1

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            rest = list(rooms)
            rest.remove(r)
            put(i + 1, [*rest, r - sizes[i]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 21), min_size=1, max_size=8), st.integers(21, 24))
def test_no_packing_has_fewer_bins_than_the_bound(sizes, capacity):
    assert packing.least_bins(sizes, capacity) <= fewest(sizes, capacity)


def test_islands_and_migration_beat_best_fit(spark):
    rnd = random.Random(8)
    sizes = [rnd.randint(260, 519) for _ in range(300)]
    got = pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long"), 1000, scratch(spark))
    assert got.select("container_id").distinct().count() <= best_fit_bins(sizes, 1000) - 2


# --- 7: leakage -----------------------------------------------------------------

ITEM = "Every isomerase precedes each paralogous inhibitor after several rounds while the proline tail masks zinc clusters but its operon merges with the orthologous label throughout that revised outlier"
WORDS = ITEM.split()
FILL = "noise goes here and more noise follows it until nothing else is left to say about this"


def leaked(spark, docs, items=((1, ITEM), (2, None), (3, "  "), (4, "***"))):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit("x"))
    i = spark.createDataFrame(list(items), "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = leakage.leaks(d, i).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {r["doc_id"] for r in got if r["item_id"] == 1}


def test_leaks_whole_partial_and_disguised(spark):
    half = len(WORDS) // 2
    swap = {"a": "а", "e": "е", "o": "о"}
    docs = [
        f"{FILL} {ITEM} {FILL}",
        f"{FILL} {' '.join(WORDS[: half + 2])} {FILL}",
        f"{FILL} {' '.join(WORDS[half - 2 :])}",
        ITEM.upper(),
        "".join(swap.get(c, c) if i % 3 == 0 else c for i, c in enumerate(ITEM)),
        "​".join(ITEM),
        "­".join(ITEM),
        "<p>" + ITEM.replace(" zinc", " <b>zi</b>nc").replace(" ", "&nbsp;") + "</p>",
        ITEM.replace("paralogous", "paralo-\ngous").replace(" ", "\r\n"),
        "  ".join(w if i % 6 else w + " extra" for i, w in enumerate(WORDS)),
        " ".join(w if i % 5 else w[0] + w[2:3] + w[1:2] + w[3:] for i, w in enumerate(WORDS)),
        "**" + ITEM.replace(" ", "** _") + "_",
    ]
    assert leaked(spark, docs) == set(range(len(docs)))


def test_leaks_with_words_added_or_left_out_throughout(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    item = " ".join(words)
    added = " ".join(w + (f" foreign{i}" if i % 2 else "") for i, w in enumerate(words[:32]))
    left_out = " ".join(words[::2])
    assert leaked(spark, [f"{FILL} {x} {FILL}" for x in (added, left_out)], [(1, item)]) == {0, 1}


def slipped(rnd, w):
    """One letter changed, left out or put in, or two neighbours swapped."""
    i, c = rnd.randrange(len(w) - 1), rnd.choice("bcdfghjk")
    return rnd.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])


@pytest.mark.parametrize("pattern", ["KKXX", "KKSS", "KSS", "KSSS", "SSSSK", "KX", "KKKXX", "XK", "S", "KXXK", "KAKAX"])
def test_retrieval_loses_no_pattern_that_is_accepted(spark, pattern):
    """K kept, S one slip, X another word in its place, A kept with a word added."""
    rnd = random.Random(pattern)
    word = lambda n=7: "".join(rnd.choice("aeiounrstlmp") for _ in range(n))
    items, docs, want = [], [], set()
    for i in range(40):
        item = [word(rnd.randint(5, 9)) for _ in range(40)]
        items.append((i, " ".join(item)))
        made = [{"K": lambda w: w, "S": lambda w: slipped(rnd, w), "X": lambda w: word(), "A": lambda w: w + " " + word()}[pattern[k % len(pattern)]](w) for k, w in enumerate(item)]
        fill = [" ".join(word() for _ in range(rnd.randint(0, 150))) for _ in range(2)]
        docs.append((i, f"{fill[0]} {' '.join(made)} {fill[1]}"))
        if leakage.holds(item, " ".join(made).split()):
            want.add((i, i))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leakage.leaks(d, t).collect()}
    assert len(want) >= 39 and want <= got and len(got - want) <= 1


def test_least_letters_are_found_by_hash():
    words = ["abcd", "hexagon", "x", "isomerase"]
    letters = np.array([ord(c) for w in words for c in w], np.uint32)
    end = np.cumsum([len(w) for w in words])
    less, word = leakage.less_one(letters, np.r_[0, end][:-1], end)
    want = {(int(leakage.words_of(x)[1][0]), k) for k, w in enumerate(words) if len(w) >= 4 for x in leakage.Slips._less(w)}
    assert set(zip(less.tolist(), word.tolist(), strict=True)) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200), st.lists(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=2, unique=True), max_size=150), min_size=1, max_size=4))
def test_common_in_windows(item, windows):
    """Against dynamic programming, with places that match any of two terms."""
    table = leakage.item_bits([np.array(item)], 10)
    of, at, mask = [], [], []
    for r, window in enumerate(windows):
        for place, terms in enumerate(window):
            for t in terms:
                of.append(r)
                at.append(place)
                mask.append(table[:, 0, t])
    masks = np.array(mask, np.uint64).T.reshape(len(table), len(of))
    got = leakage.common_in_windows(np.array(of, np.int64), np.array(at, np.int64), masks, len(windows))
    for r, window in enumerate(windows):
        line = [0] * (len(window) + 1)
        for x in item:
            before = line[:]
            for j, terms in enumerate(window):
                line[j + 1] = before[j] + 1 if x in terms else max(before[j + 1], line[j])
        assert got[r] == line[-1]


def test_an_index_of_the_greatest_size_is_bounded():
    rnd = random.Random(3)
    items = [(i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(120))) for i in range(1000)]
    index = leakage.Index(items)
    assert index.nbytes() < 60 * sum(len(t) for _, t in items)


def test_no_leaks(spark):
    rnd = random.Random(1)
    mixed = WORDS[:]
    rnd.shuffle(mixed)
    far = (" " + FILL) * 12
    docs = [None, "", FILL * 3, " ".join(mixed), " ".join(WORDS[: len(WORDS) // 3]), " ".join(WORDS[:8]) + far + " ".join(WORDS[8:13]) + far + " ".join(WORDS[14:20]), " ".join(reversed(WORDS))]
    assert leaked(spark, docs) == set()


def test_leaks_of_nothing_and_single_words(spark):
    assert leaked(spark, [ITEM], [(2, None)]) == set()
    assert leaked(spark, []) == set()
    assert leaked(spark, ["an Isomérase here", "nothing", "isomerase"], [(1, "isomerase"), (5, ITEM)]) == {0, 2}


def test_retrieval_against_brute_force(spark):
    """Every document against every item, without an index."""
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "test_items"))
    parsed = [(r["item_id"], leakage.words_of(r["text"])[0]) for r in items.collect()]
    slips = {i: leakage.Slips(w) for i, w in parsed if w}
    want = set()
    for d in docs.collect():
        words = leakage.words_of(d["text"])[0]
        for i, item in parsed:
            n = len(item)
            if n and any(leakage.holds(item, words[s : s + 2 * n + 16], slips[i]) for s in range(0, max(1, len(words) - n), max(1, n // 2))):
                want.add((d["doc_id"], i))
    assert want and {tuple(r) for r in leakage.leaks(docs, items).collect()} == want


def test_several_indexes_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 1)
    docs = [(FILL + " ") * 20_000 + ITEM, None, ITEM]
    assert leaked(spark, docs, [(9, FILL), (1, ITEM)]) == {0, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_words_against_dynamic_programming(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    bits = {}
    for k, w in enumerate(a):
        bits[w] = bits.get(w, 0) | (1 << k)
    assert leakage.common_words(bits, len(a), b) == table[-1][-1]


@pytest.mark.parametrize("a, b, near", [("abcd", "abcd", True), ("abcd", "abd", True), ("abcd", "abcde", True), ("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "dcba", False), ("abcd", "ab", False)])
def test_one_slip(a, b, near):
    assert leakage.one_slip(a, b) is near and leakage.one_slip(b, a) is near
