"""Records of evaluation splits that occur, exactly or almost, in training.

The containment of two texts is the share of the smaller one's k-mer set that the
other has; a pair overlaps from ``c`` up. At most ``D = a - ceil(c a)`` of the
smaller set's k-mers are missing from the other. Of ``D + 1`` runs of consecutive
k-mers with no k-mer in common, at least one is therefore whole in the larger set.
So the smaller text gives the n-grams of ``D + 1`` such runs (of up to four k-mers:
n-grams of k + 3 letters), and the larger all n-grams that can be walked in its
k-mer set, whatever the order of its parts: a join of n-gram hashes that loses no
pair and meets almost nothing but true overlaps. The runs are those of the rarest k-mers.

Either may be the smaller text, so there are two joins, of evaluation n-grams scanned for
in training and the other way round. Both are done in one pass: the hashes of the smaller
sides make a bit table of fixed size, which is sent to all tasks; a task gives the n-grams
of the larger sides that are in it, and those of the smaller sides, packed and partitioned
by hash, so neither split has to fit anywhere. With more n-grams than the table has bits
more of the larger sides' pass, none is lost. N-grams that many texts have are joined in
blocks. Containment is then computed exactly.
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
from kinfold.llm.near_duplicates import BLOCK_KEYS, BLOCK_SETS, DESCRIBED, PAIRED, RANGES, SKETCH_WORDS, Frequencies, describe, kmer_frequencies, small
from kinfold.llm.packed_join import BLOCKS, MET, hot_rows, meet, met_in_blocks, pack
from kinfold.session import Scratch

LONGEST_RUN = 4
TOKENS_PER_PARTITION = 1_000_000
#: Bits of the table of n-gram hashes (as a power of two), and walks made at once.
TABLE_BITS, WALKS = 26, 500_000


def _runs(code: np.ndarray, m: int) -> list[int]:
    """Starts of runs of m k-mers, pairwise and within themselves without repeats."""
    seen: set[int] = set()
    starts, at = [], 0
    while at + m <= len(code):
        run = code[at : at + m].tolist()
        if len(set(run)) == m and not seen.intersection(run):
            seen.update(run)
            starts.append(at)
            at += m
        else:
            at += 1
    return starts


def smaller_side(batch: pa.RecordBatch, k: int, c: Fraction, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, m, gram)`` of each text: D + 1 disjoint runs of m k-mers, m the greatest of
    which there are enough, and of these the ones of the rarest k-mers."""
    row, pos, code = K.windows(*K.residues(batch.column("seq")), k)
    size = np.asarray(batch.column("size")).astype(np.int64)
    n = np.bincount(row, minlength=len(size))
    edge = np.cumsum(n) - n
    need = size - -((-size * c.numerator) // c.denominator) + 1
    level = np.r_[0, np.cumsum(frequencies.of(code).astype(np.int64))]
    # texts without repeats: every m-th place begins a run
    plain = size == n
    length = np.zeros(len(size), np.int64)
    for m in range(1, LONGEST_RUN + 1):
        length[plain & (n // m >= need)] = m
    step = np.maximum(length, 1)[row]
    first = np.flatnonzero((length[row] > 0) & (pos % step == 0) & (pos + step <= n[row]))
    others = [(r, _loose_runs(code[edge[r] : edge[r] + n[r]], int(need[r]))) for r in np.flatnonzero(~plain).tolist()]
    for r, (m, starts) in others:
        length[r] = m
        first = np.concatenate([first, edge[r] + starts])
    m = length[row[first]]
    order = np.lexsort((first, level[first + m] - level[first], row[first]))
    first = first[order]
    r = row[first]
    held = np.bincount(r, minlength=len(size))
    first = first[np.arange(len(r)) - (np.cumsum(held) - held)[r] < need[r]]
    r, m = row[first], length[row[first]]
    gram, last = code[first], np.r_[code % K.BASE, np.zeros(LONGEST_RUN, np.int64)]
    for i in range(1, LONGEST_RUN):
        gram = np.where(m > i, gram * K.BASE + last[first + i], gram)
    return r, m, gram


def _loose_runs(code: np.ndarray, need: int) -> tuple[int, np.ndarray]:
    """The same for a text with repeated k-mers; such texts are looked through one by one."""
    for m in range(LONGEST_RUN, 0, -1):
        starts = _runs(code, m)
        if len(starts) >= need:
            return m, np.array(starts, np.int64)
    raise AssertionError("single k-mers always suffice")


def larger_side(batch: pa.RecordBatch, k: int, lengths: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(m, row, gram)``: every walk of m k-mers, m in ``lengths``, each overlapping the
    next by k - 1 letters, within a text's set. A text of few letters has more walks than
    k-mers, so they are made and given out in parts."""
    span = K.BASE ** (k - 1)
    row, _, code = K.windows(*K.residues(batch.column("seq")), k)
    key = K.unique(row * K.BASE**k + code)
    row, code = key // K.BASE**k, key % K.BASE**k
    follow = key - code + (code % span) * K.BASE
    low = np.searchsorted(key, follow)
    ways = np.searchsorted(key, follow + K.BASE) - low
    most = max(lengths, default=0)

    def walk(end: np.ndarray, gram: np.ndarray, start: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if m in lengths:
            yield m, start, gram
        if m >= most:
            return
        n = np.cumsum(ways[end])
        cut = np.searchsorted(n, np.arange(0, n[-1] if len(n) else 0, WALKS), "right")
        for a, b in zip(cut, np.r_[cut[1:], len(n)], strict=True):
            some = ways[end[a:b]]
            nxt = np.repeat(low[end[a:b]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            yield from walk(nxt, np.repeat(gram[a:b], some) * K.BASE + code[nxt] % K.BASE, np.repeat(start[a:b], some), m + 1)

    yield from walk(np.arange(len(key)), code, row, 1)


def _hash(gram: np.ndarray, m, way: int) -> np.ndarray:
    """Of an n-gram; way 0: evaluation is the smaller side, 1: training is."""
    return K.mix(gram ^ (np.asarray(m) << 50), 5 + way)


class GramTable:
    """One bit per hash of the smaller sides' n-grams, and their lengths by way."""

    def __init__(self, bits: np.ndarray, lengths: dict[int, set[int]]):
        self.bits, self.lengths = bits, lengths

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - TABLE_BITS)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def gram_table(reps: DataFrame, k: int, c: Fraction, shared) -> GramTable:
    """Every task sends its bits in RANGES parts; the driver gets the table, whose size is
    fixed."""
    width = (1 << TABLE_BITS) // RANGES

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = [], {0: set(), 1: set()}
        for whole in batches:
            for batch in small([whole], 2000):
                r, m, gram = smaller_side(batch, k, c, shared.value)
                for way, name in enumerate(("in_eval", "in_train")):
                    mine = np.asarray(batch.column(name))[r] == 1
                    used[way].update(np.unique(m[mine]).tolist())
                    at.append(_hash(gram[mine], m[mine], way) >> np.uint64(64 - TABLE_BITS))
            if sum(map(len, at)) > 4_000_000:
                at = [K.unique(np.concatenate(at))]
        if not at:
            return
        slots = K.unique(np.concatenate(at)).astype(np.int64)
        for i in range(RANGES):
            low, high = np.searchsorted(slots, [i * width, (i + 1) * width])
            flags = np.zeros(width, bool)
            flags[slots[low:high] - i * width] = True
            marks = sum(1 << (8 * way + m) for way in used for m in used[way])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary()), pa.array([marks], pa.int64())],
                names=["part", "bits", "lengths"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, marks = np.zeros(width // 8, np.uint8), 0
        for batch in batches:
            for blob, own in zip(batch.column("bits"), batch.column("lengths").to_pylist(), strict=True):
                bits |= np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
                marks |= own
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary()), pa.array([marks], pa.int64())], names=["part", "bits", "lengths"])

    schema = "part int, bits binary, lengths long"
    rows = reps.select("seq", "size", "in_train", "in_eval").mapInArrow(collect, schema).groupBy("part").applyInArrow(merge, schema).collect()
    bits, marks = np.zeros((1 << TABLE_BITS) // 8, np.uint8), 0
    for r in rows:
        bits[r["part"] * (width // 8) : (r["part"] + 1) * (width // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        marks |= r["lengths"]
    return GramTable(bits, {way: {m for m in range(1, LONGEST_RUN + 1) if marks >> (8 * way + m) & 1} for way in (0, 1)})


def packed_grams(k: int, c: Fraction, shared, table, parts: int):
    """``(part, block)``: the smaller sides' n-grams and, marked, those of the larger
    sides that are in the table. Way 0 goes to partitions of even number, 1 to odd ones."""
    half = np.uint64(parts // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, hashes, marks, ways, texts, n = [], [], [], [], [], 0, 0

        def take(row: np.ndarray, h: np.ndarray, mark: int, way: int) -> None:
            nonlocal n
            rows.append(row + texts)
            hashes.append(h)
            marks.append(np.full(len(h), mark, np.uint64))
            ways.append(np.full(len(h), way, np.int64))
            n += len(h)

        def out() -> pa.RecordBatch:
            h, way = np.concatenate(hashes), np.concatenate(ways)
            return pack(np.concatenate(ids), np.concatenate(rows), (h % half).astype(np.int64) * 2 + way, h // half, np.concatenate(marks))

        grams: GramTable = table.value
        for whole in batches:
            for batch in small([whole], 1000):
                inside = [np.asarray(batch.column(name)) == 1 for name in ("in_eval", "in_train")]
                r, m, gram = smaller_side(batch, k, c, shared.value)
                for way in (0, 1):
                    mine = inside[way][r]
                    take(r[mine], _hash(gram[mine], m[mine], way), 0, way)
                for m, r, gram in larger_side(batch, k, grams.lengths[0] | grams.lengths[1]):
                    for way in (0, 1):
                        if m in grams.lengths[way]:
                            mine = inside[1 - way][r]
                            h = _hash(gram[mine], m, way)
                            met = grams.has(h)
                            take(r[mine][met], h[met], 1, way)
                ids.append(np.asarray(batch.column("id")))
                texts += batch.num_rows
                if n >= BLOCK_KEYS:
                    yield out()
                    ids, rows, hashes, marks, ways, texts, n = [], [], [], [], [], 0, 0
        if n:
            yield out()

    return run


def exact_containment(k: int, c: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = K.common_counts(batch.column("seq_a"), batch.column("seq_b"), k)
            least = np.minimum(a, b)
            ok = (both * c.denominator >= least * c.numerator) & (least > 0)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("e").filter(keep), batch.column("t").filter(keep), pa.array(both[ok] / least[ok])],
                                             names=["e", "t", "containment"])

    return run


class SplitOverlap:
    """``texts``: ``(id, seq, split)``, one row per id, residues only; ``split`` is
    ``train`` or the name of an evaluation split; rows with another null split
    take no part. Texts shorter than k have no k-mers and overlap nothing.

    Texts with one k-mer set form a class, so copies are joined once.
    ``members``: ``(id, cls, split)``. ``class_pairs``: ``(e, t, containment)``, classes
    with evaluation and with training members. ``pairs``: ``(eval_id, train_id,
    split, containment)``, one row per pair of texts.
    """

    def __init__(self, texts: DataFrame, scratch: Scratch, k: int = 5, containment: Fraction = Fraction(4, 5), train: str = "train"):
        c = Fraction(containment)
        if not 0 < c <= 1:
            raise ValueError("the containment lies above 0 and at most at 1")
        spark = texts.sparkSession
        texts = scratch.write(texts.where(F.col("split").isNotNull()).select("id", "seq", "split"), "texts")
        described = scratch.write(texts.select("id", "seq").mapInArrow(describe(k), DESCRIBED).where("size > 0"), "described")
        classes = described.groupBy("fp1", "fp2").agg(F.min("id").alias("cls"))
        self.members = scratch.write(
            described.select("id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).join(texts.select("id", "split"), "id").select("id", "cls", "split"), "members")
        kinds = self.members.groupBy("cls").agg(F.max(F.when(F.col("split") == train, 1).otherwise(0)).alias("in_train"),
                                                F.max(F.when(F.col("split") != train, 1).otherwise(0)).alias("in_eval"))
        reps = scratch.write(described.drop("fp1", "fp2").join(kinds.withColumnRenamed("cls", "id"), "id"), "reps")

        tokens = reps.agg(F.sum("size")).first()[0] or 0
        parts = 2 * max(spark.sparkContext.defaultParallelism, -(-tokens // (2 * TOKENS_PER_PARTITION)))
        slim = reps.select("id", "seq", "size", "in_train", "in_eval").repartition(parts)
        shared = spark.sparkContext.broadcast(kmer_frequencies(reps, k))  # at most SLOTS bytes
        table = spark.sparkContext.broadcast(gram_table(reps, k, c, shared))  # 2 ** TABLE_BITS bits
        keys = slim.mapInArrow(packed_grams(k, c, shared, table, parts), BLOCKS)
        met = scratch.write(keys.repartitionById(parts, "part").mapInArrow(meet(PAIRED, sides=True), MET), "met")
        pair = lambda df: df.select(F.col("a").alias("e"), F.col("b").alias("t"))
        near = pair(met.where("large is null")).unionByName(reps.where("in_train = 1 and in_eval = 1").select(F.col("id").alias("e"), F.col("id").alias("t")))
        hot = hot_rows(met)
        if not hot.isEmpty():
            limit = lambda a, b: a + b + 2 * ((-np.minimum(a, b) * c.numerator) // c.denominator)
            sketches = reps.select("id", "size", *[f"w{i}" for i in range(SKETCH_WORDS)])
            near = near.unionByName(pair(met_in_blocks(hot, sketches, limit, BLOCK_SETS, parts, sides=True)))
        near = scratch.write(near.distinct(), "near")
        seq = lambda key, s: reps.select(F.col("id").alias(key), F.col("seq").alias(f"seq_{s}"))
        exact = near.join(seq("e", "a"), "e").join(seq("t", "b"), "t").select("e", "t", "seq_a", "seq_b")
        self.class_pairs = scratch.write(exact.mapInArrow(exact_containment(k, c), "e long, t long, containment double"), "class_pairs")
        ev = self.members.where(F.col("split") != train).select(F.col("cls").alias("e"), F.col("id").alias("eval_id"), "split")
        tr = self.members.where(F.col("split") == train).select(F.col("cls").alias("t"), F.col("id").alias("train_id"))
        self.pairs = self.class_pairs.join(ev, "e").join(tr, "t").select("eval_id", "train_id", "split", "containment")

    def counts(self, labels: DataFrame, by: list[str], train: str = "train") -> DataFrame:
        """``(*by, n_pairs, n_eval, n_contained)`` over evaluation records, ``labels``
        being ``(id, ...)``: pairs, evaluation records that have one, and all of
        them. ``by`` may name ``split``. Training copies are counted per class, not
        expanded."""
        copies = self.members.where(F.col("split") == train).groupBy(F.col("cls").alias("t")).agg(F.count(F.lit(1)).alias("n"))
        per_class = self.class_pairs.join(copies, "t").groupBy(F.col("e").alias("cls")).agg(F.sum("n").alias("n"))
        rows = self.members.where(F.col("split") != train).join(per_class, "cls", "left").join(labels, "id", "left")
        return rows.groupBy(*by).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_eval"), F.count("n").alias("n_contained"))


def current_split(members: DataFrame) -> DataFrame:
    """``(pid, split)``: the split of each protein's row with the latest
    ``assigned_at``, as train, validation or test. Other names, and a null split in
    the latest row, leave the protein out; at equal times a null split counts as
    later, then the greater name. A null time is earlier than any other."""
    name = F.lower(F.regexp_replace("split", r"[\s\p{Z}\p{C}]", ""))
    known = (
        F.when(name.isin("train", "training"), "train")
        .when(name.isin("validation", "valid", "val"), "validation")
        .when(name.isin("test", "testing"), "test")
    )
    order = F.struct(F.col("assigned_at"), F.col("split").isNull(), F.coalesce(known, F.lit("")))
    last = members.where(F.col("pid").isNotNull()).groupBy("pid").agg(F.max_by(F.struct(known.alias("split")), order).alias("r"))
    return last.select("pid", "r.split").where(F.col("split").isNotNull())
