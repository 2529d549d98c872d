"""Near-duplicate sequences: a parity-sketch join that loses no pair.

Texts are sets of k-mers. Let ``a`` and ``b`` be two sets' sizes and ``t`` the
Jaccard threshold; similar sets share at least ``T = ceil(t (a + b) / (1 + t))``
k-mers, so their symmetric difference has at most ``D = a + b - 2T``.

*Parity sketch.* Each k-mer flips one of 512 bits. The XOR of two sketches is the
sketch of the symmetric difference, so its bit count is a lower bound of the
difference's size: a pair with more than ``D`` bits is rejected unread.

*Pigeonhole join.* With whole parts of a sketch as join keys, ``D + 1`` parts are
needed before one must agree. At t = 1/2, D is up to two thirds of a set: a part
would hold one k-mer, and every pair that shares one k-mer would be a candidate.
So parts are joined with mismatches allowed. Pairs are put into bands by ``T``
(band K: ``K <= T < 2K``); a set of size ``a`` may meet partners of the bands with
``a/4 < K <= a`` (for t = 1/2). In a band, a set keeps its first ``a - K + q`` k-mers
in one global order, which must hold at least ``q`` of the shared ones, and spreads
them over ``q - 1`` parts by hash: two shared k-mers meet in one part. The part's
parity with all but two of its k-mers taken out, the XOR of two k-mer hashes, is
the join key. With ``q = K/2 + 1`` the K - q k-mers that come last in the global order
are never needed. The global order is that of rising document frequency, counted over
all texts, so the k-mers of a domain that many texts share come last. Those far more
frequent than the rest are left out where a set has no more of them than are not needed:
whatever such a set shares with any other is found without them, and nobody's frequent
k-mers are used. Two sets that both have more meet in a second round of their own, with
a smaller ``q`` and bands of a third, that leaves out most of T. What counts as frequent
changes the work done, never the result.

The lowest bit of a key marks sets so large that two of them have more than the
band's T; they meet smaller ones only.

Two unrelated sets have the same two k-mers in one part about once in millions of
pairs, so nearly all keys occur once. They travel packed, a few bytes each, in blocks of
a task's texts, and are sorted in numpy. All keys at once would fill many times the disk
that the texts do, so the parts of large inputs take turns: each turn makes, shuffles and
joins the keys of its parts alone, and what it shuffled goes before the next. The sets of a key that many have are cut into
blocks, and each pair of blocks is compared by its sketches on its own, so no task has
more than a pair of blocks to do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import kmers as K
from kinfold.llm.packed_join import MET, hot_rows, meet, met_in_blocks, pack, sorted_order
from kinfold.session import Scratch, shuffles_dropped

SKETCH_WORDS = 8
BITS = 64 * SKETCH_WORDS
#: A k-mer is frequent from this count on, and from so many times the mean count.
#: These steer the order only.
HOT_LEAST, HOT_TIMES = 64, 8
#: Counters of k-mers; more k-mers than that share them.
SLOTS, RANGES = 1 << 22, 16
#: Join keys per partition, and keys of one block of texts.
KEYS_PER_PARTITION, BLOCK_KEYS = 1_000_000, 1_000_000
#: Turns at most, and keys for which there is one more turn.
TURNS, TURN_KEYS = 4, 12_000_000
#: Sets of one key that are paired where they meet; more are cut into blocks.
PAIRED, BLOCK_SETS = 200, 2048


def least_shared(a, b, t: Fraction):
    """Least intersection of sets with Jaccard >= t (works on arrays)."""
    num, den = t.numerator, t.numerator + t.denominator
    return -((-(a + b) * num) // den)


def bands(a: np.ndarray) -> list[int]:
    """Bands K (powers of two) that some set of the given sizes takes part in."""
    top = int(a.max()) if len(a) else 0
    return [1 << i for i in range(top.bit_length())]


def thirds(band: int) -> list[tuple[int, int]]:
    """The band ``[K, 2K)`` in three."""
    ends = [band, -(-band * 4 // 3), -(-band * 5 // 3), 2 * band]
    return [(low, high) for low, high in zip(ends, ends[1:], strict=False) if low < high]


def in_band(a: np.ndarray, least: int, most: int, t: Fraction) -> np.ndarray:
    """Sets of size a have a possible partner b (t a <= b <= a / t) with least <= T < most."""
    num, den = t.numerator, t.denominator
    low, high = -((-a * num) // den), (a * den) // num
    return (least_shared(a, high, t) >= least) & (least_shared(a, low, t) < most) & (a >= least)


def small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Bounds what is held at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _sets(column: pa.Array, k: int):
    row, code = K.distinct_sets(*[K.windows(*K.residues(column), k)[i] for i in (0, 2)], k)
    size = np.bincount(row, minlength=len(column)) if len(column) else np.zeros(0, np.int64)
    return row, code, size


def describe(k: int):
    """Per text: set size, 128-bit fingerprint of the set, parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1000):
            seq = batch.column("seq")
            row, code, size = _sets(seq, k)
            n, h = len(seq), K.mix(code)
            prints = []
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            for salt in (1, 2):
                acc = np.zeros(n, np.uint64)
                if len(row):
                    acc[row[starts]] = np.add.reduceat(K.mix(code, salt), starts)
                prints.append(acc.astype(np.int64))
            flips = np.bincount(row * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=n * BITS).reshape(n, SKETCH_WORDS, 64) & 1
            words = (flips.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).astype(np.int64)
            cols = [batch.column("id"), seq, pa.array(size.astype(np.int32))]
            cols += [pa.array(x) for x in (*prints, *words.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in cols],
                                             names=["id", "seq", "size", "fp1", "fp2", *[f"w{i}" for i in range(SKETCH_WORDS)]])

    return run


DESCRIBED = "id long, seq string, size int, fp1 long, fp2 long, " + ", ".join(f"w{i} long" for i in range(SKETCH_WORDS))


class Frequencies:
    """How often each k-mer occurs, on a scale of eighths of powers of two."""

    def __init__(self, levels: np.ndarray, hot: int, k: int):
        self.levels, self.hot, self.k = levels, hot, k

    @staticmethod
    def slot(code: np.ndarray, k: int) -> np.ndarray:
        return code if K.BASE**k <= SLOTS else (K.mix(code, 3) % np.uint64(SLOTS)).astype(np.int64)

    @staticmethod
    def level(count: float) -> int:
        return min(255, round(8 * float(np.log2(1 + count))))

    def of(self, code: np.ndarray) -> np.ndarray:
        return self.levels[self.slot(code, self.k)]


def kmer_frequencies(texts: DataFrame, k: int) -> Frequencies:
    """Counted over all of ``texts(seq)``. Each task adds its counts up and sends them in
    RANGES parts, the driver gets a byte per slot (at most SLOTS), whatever the texts."""
    slots = min(K.BASE**k, SLOTS)
    width = -(-slots // RANGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANGES * width, np.uint32)
        seen = False
        for batch in batches:
            for some in small([batch], 2000):
                code = K.windows(*K.residues(some.column("seq")), k)[2]
                seen = seen or len(code) > 0
                total += np.bincount(Frequencies.slot(code, k), minlength=len(total)).astype(np.uint32)
        if seen:
            cut = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(cut, pa.binary())], names=["part", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for blob in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
        level = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])],
            names=["part", "levels", "n", "kinds"])

    counted = texts.select("seq").mapInArrow(count, "part int, counts binary")
    rows = counted.groupBy("part").applyInArrow(add, "part int, levels binary, n long, kinds long").collect()
    levels = np.zeros(RANGES * width, np.uint8)
    for r in rows:
        levels[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    mean = sum(r["n"] for r in rows) / max(1, sum(r["kinds"] for r in rows))
    return Frequencies(levels, Frequencies.level(max(HOT_LEAST, HOT_TIMES * mean)), k)


def keys_of(batch: pa.RecordBatch, k: int, t: Fraction, frequencies: Frequencies, turn: int = 0, turns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, sig)`` of the texts of a batch (at most 2048), as in the module's
    description; of ``turns`` shares of all parts those of one."""

    def of_band(row, h, hot, place, size, fewest, q, parts, salt, dropped):
        # first a - T + q of each set in the global order, T the least it can share
        keep = place < (size - fewest + q)[row]
        if dropped:
            keep &= ~hot
        row, h = row[keep], h[keep]
        mark = K.mix(h, salt)
        if q == 1:  # T = 1: any shared k-mer
            return row, mark
        group = row * parts + (mark % np.uint64(parts)).astype(np.int64)
        order = sorted_order(group, len(size) * parts)
        row, h, group = row[order], h[order], group[order]
        # all pairs within a part: neighbours, then at distance 2, ...
        out_row, out_sig = [], []
        i, gap = np.arange(len(group)), 1
        with np.errstate(over="ignore"):
            while True:
                i = i[: np.searchsorted(i, len(group) - gap)]
                i = i[group[i + gap] == group[i]]
                if not len(i):
                    break
                out_row.append(row[i])
                out_sig.append(K.mix((h[i] ^ h[i + gap]) + np.uint64(salt)))
                gap += 1
        if not out_row:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_row), np.concatenate(out_sig)

    # a k-mer is 8 bits of frequency and 45 of a hash; with its text in front, one sort
    # gives every set in the global order
    row, code, size = _sets(batch.column("seq"), k)
    ordered = (frequencies.of(code).astype(np.uint64) << np.uint64(45)) | (K.mix(code, 7) >> np.uint64(19))
    ordered = np.sort((row.astype(np.uint64) << np.uint64(53)) | ordered)  # ``row`` is sorted and stays
    h = ordered & np.uint64((1 << 53) - 1)
    hot = h >= np.uint64(frequencies.hot << 45)
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    hot_count = np.bincount(row, weights=hot, minlength=len(size))
    alone = least_shared(size, -((-size * t.numerator) // t.denominator), t)  # with its smallest partner
    # a turn's k-mers are split into its share of the q - 1 parts
    own = ((h & np.uint64(0xFFFF)) * np.uint64(turns)) >> np.uint64(16) == turn
    shared_out = row[own], h[own], hot[own], place[own]
    for band in bands(size):
        q = max(2, band * 5 // 8 + 1) if band > 1 else 1
        least = np.maximum(band, alone)
        rounds = [(band, 2 * band, q, 2 * band, in_band(size, band, 2 * band, t), True)]
        heavy = hot_count > least - q
        if heavy.any():
            rounds += [(low, high, min(q, max(2, low // 8)), 2 * low + 1, heavy & in_band(size, low, high, t), False) for low, high in thirds(band)]
        for low, high, need, salt, sets, dropped in rounds:
            if not sets.any():
                continue
            few = need > 1 and need - 1 < turns  # too few parts for all turns: the first has them
            if few and turn > 0:
                continue
            given = (row, h, hot, place) if few else shared_out
            some = sets[given[0]]
            r, sig = of_band(*[x[some] for x in given], size, np.maximum(low, alone), need, need - 1 if few else (need - 1) // turns, salt, dropped)
            large = least_shared(size, size, t) >= high
            yield r, (sig & ~np.uint64(1)) | large[r].astype(np.uint64)


def join_keys(k: int, t: Fraction, shared, parts: int, turn: int, turns: int):
    """``(part, block)``: a turn's keys of all texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            key = sig >> np.uint64(1)
            return pack(np.concatenate(ids), np.concatenate(rows), key % np.uint64(parts), key // np.uint64(parts), sig & np.uint64(1))

        ids, rows, sigs, texts, n = [], [], [], 0, 0
        for batch in batches:
            for some in small([batch], 500):
                for r, sig in keys_of(some, k, t, shared.value, turn, turns):
                    rows.append(r + texts)
                    sigs.append(sig)
                    n += len(r)
                ids.append(np.asarray(some.column("num")))
                texts += some.num_rows
                if n >= BLOCK_KEYS:
                    yield out()
                    ids, rows, sigs, texts, n = [], [], [], 0, 0
        if n:
            yield out()

    return run


def exact_jaccard(k: int, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1000):
            a, b, both = K.common_counts(batch.column("seq_a"), batch.column("seq_b"), k)
            union = a + b - both
            ok = (both * t.denominator >= union * t.numerator) & (union > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array((both[ok] / union[ok]))],
                names=["a", "b", "similarity"])

    return run


class NearDuplicates:
    """Classes of texts with equal k-mer sets, and pairs of similar classes.

    ``texts``: ``(id, seq)``, ids non-null and unique, texts of residues only.
    Texts shorter than k have an empty set and are similar to nothing. Copies, and
    texts that differ yet have one k-mer set, form a class before anything is
    joined, so a group of copies of any size costs one text. Equality of sets is
    that of two 64-bit sums of independent hashes.

    ``members``: ``(id, cls)``; the class's id is its least member.
    ``pairs``: ``(a, b, similarity)``, classes with ``a < b``, Jaccard >= threshold.
    """

    def __init__(self, texts: DataFrame, scratch: Scratch, k: int = 5, threshold: Fraction = Fraction(1, 2)):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and at most at 1")
        t = Fraction(threshold)
        described = scratch.write(texts.select("id", "seq").mapInArrow(describe(k), DESCRIBED).where("size > 0"), "described")
        classes = described.groupBy("fp1", "fp2").agg(F.min("id").alias("cls"))
        self.members = scratch.write(described.select("id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("id", "cls"), "members")
        # numbers that follow one another in a file, so those of a block are short
        numbered = described.join(self.members.where("id = cls").select("id"), "id", "left_semi").drop("fp1", "fp2")
        reps = scratch.write(numbered.withColumn("num", F.monotonically_increasing_id()), "reps")
        scratch.drop("described")

        spark = reps.sparkSession
        cores = spark.sparkContext.defaultParallelism
        with shuffles_dropped(spark):
            n_keys = (reps.agg(F.sum("size")).first()[0] or 0) * 2
            shared = spark.sparkContext.broadcast(kmer_frequencies(reps, k))  # at most SLOTS bytes
        turns = max(1, min(TURNS, -(-n_keys // TURN_KEYS)))
        parts = max(cores, -(-n_keys // (KEYS_PER_PARTITION * turns)))
        asked = reps.select("num", "seq")
        if asked.rdd.getNumPartitions() < cores:
            asked = asked.repartitionByRange(cores, "num")
        met = None
        for turn in range(turns):
            keys = asked.mapInArrow(join_keys(k, t, shared, parts, turn, turns), "part int, block binary")
            found = scratch.write(keys.repartitionById(parts, "part").mapInArrow(meet(PAIRED), MET), f"met{turn}")
            met = found if met is None else met.unionByName(found)

        pairs = met.where("large is null").select("a", "b")
        # keys of two turns may look alike: that brings more pairs to look at and loses none
        hot = hot_rows(met)
        with shuffles_dropped(spark):
            cold = hot.isEmpty()
        slim = reps.select(F.col("num").alias("id"), "size", *[f"w{i}" for i in range(SKETCH_WORDS)])
        if not cold:
            limit = lambda a, b: a + b - 2 * least_shared(a, b, t)
            pairs = pairs.unionByName(met_in_blocks(hot, slim, limit, BLOCK_SETS, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = scratch.write(pairs.distinct(), "candidates")
        side = lambda s: slim.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in slim.columns[1:]])
        apart = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(SKETCH_WORDS)), F.lit(0))
        num, den = t.numerator, t.numerator + t.denominator
        both = F.col("size_a") + F.col("size_b")
        most = both + 2 * F.floor(-both * F.lit(num) / F.lit(den))
        near = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b"), "near")
        # sketches rule out nearly all chance pairs; only the texts of others are joined twice
        ends = near.select(F.explode(F.array("a", "b")).alias("num")).distinct()
        some = scratch.write(reps.select("num", "id", "seq").join(ends, "num", "left_semi"), "some")
        scratch.drop("reps")
        text = lambda s: some.select(F.col("num").alias(s), F.col("id").alias(f"id_{s}"), F.col("seq").alias(f"seq_{s}"))
        found = near.join(text("a"), "a").join(text("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "seq_a", "seq_b")
        self.pairs = scratch.write(found.mapInArrow(exact_jaccard(k, t), "a long, b long, similarity double"), "pairs")

    def all_pairs(self) -> DataFrame:
        """``(id_a, id_b)``, ``id_a < id_b``: every pair of similar texts, those of
        one class included. Quadratic in the size of a class, as the result is;
        :meth:`groups` is not."""
        links = self.pairs.select("a", "b").unionByName(
            self.members.groupBy(F.col("cls").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", F.col("a").alias("b")))
        left = self.members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
        right = self.members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
        return (
            links.join(left, "a").join(right, "b").where((F.col("a") < F.col("b")) | (F.col("x") < F.col("y")))
            .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        )

    def groups(self, scratch: Scratch) -> DataFrame:
        """``(id, class_id, group_id, n_links)``, one row per text: its class, the
        connected component of similar classes (its least member), and the number
        of texts similar to it."""
        from kinfold.llm.components import hash_to_min

        ends = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sizes = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
        linked = ends.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("m"))
        roots = hash_to_min(self.pairs, scratch, "nd").select(F.col("node").alias("cls"), "root")
        per_class = sizes.join(linked, "cls", "left").join(roots, "cls", "left").select(
            "cls", F.coalesce("root", "cls").alias("group_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
        return self.members.join(per_class, "cls").select("id", F.col("cls").alias("class_id"), "group_id", "n_links")
