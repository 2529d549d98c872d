"""An equi-join of many short keys, packed for the shuffle and sorted in numpy.

Each task packs the keys of its texts into one block per partition: the texts' ids once, as
short as they lie close together, and four bytes a key. A partition unpacks its blocks, sorts the keys and pairs the texts
of equal ones. A key has a mark: of two texts with a mark no pair is formed, or, in a
join of two sides, of two with the same mark. Keys that many texts have are not paired
there: their texts are cut into blocks, and each pair of blocks is a task of its own, in
which parity sketches rule out most pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import kmers as K

#: Bits of a key beside its partition's number and its mark. Of a million keys of one
#: partition, a few hundred pairs agree by chance.
KEY_BITS = 31
#: Pairs that are held, and rows sent on, at once.
HELD, SENT = 2_000_000, 500_000
BLOCKS, MET = "part int, block binary", "a long, b long, large boolean"
_MASK, _ONE = np.uint64((1 << KEY_BITS) - 1), np.uint64(1)


def sorted_order(values: np.ndarray, bound: int) -> np.ndarray:
    """The order that sorts non-negative integers below ``bound``, of equal ones the
    first first. Sorting values with their places behind them is several times faster
    than finding places alone."""
    bits = max(1, len(values) - 1).bit_length()
    if int(bound).bit_length() + bits > 64:
        return np.argsort(values, kind="stable")
    both = (values.astype(np.uint64) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _short(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as the greatest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def pack(ids: np.ndarray, row: np.ndarray, part: np.ndarray, key: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
    """A block of keys for each partition: its texts' ids, how many keys each has, and
    32 bits of each key and mark. ``row``: a key's text as a place in ``ids``."""
    part = part.astype(np.int64)
    order = sorted_order(part * len(ids) + row, (int(part.max(initial=0)) + 1) * len(ids))
    part, row = part[order], row[order]
    word = (((key[order] & _MASK) << _ONE) | mark[order]).astype(np.uint32)
    names, blobs = [], []
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        r = row[low:high]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        some = ids[r[first]].astype(np.int64)
        # from the least id on; the difference may need all 64 bits
        far, count = _short(some.view(np.uint64) - np.uint64(int(some.min()) % 2**64)), _short(np.diff(np.r_[first, len(r)]))
        head = np.array([len(first), len(r), some.min(), far.itemsize, count.itemsize], np.int64)
        blobs.append(b"".join(x.tobytes() for x in (head, far, count, word[low:high])))
        names.append(int(part[low]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and words (key and mark) of a block."""
    texts, n, least, wide, some = np.frombuffer(blob, np.int64, 5).tolist()
    far = np.frombuffer(blob, f"u{wide}", texts, 40)
    count = np.frombuffer(blob, f"u{some}", texts, 40 + wide * texts)
    word = np.frombuffer(blob, np.uint32, n, 40 + (wide + some) * texts)
    ids = (far.astype(np.uint64) + np.uint64(least % 2**64)).view(np.int64)
    return np.repeat(ids, count), word.astype(np.uint64)


def meet(paired: int, sides: bool = False):
    """From all blocks of a partition: ``(a, b, null)``, pairs of texts with a key in
    common, not both marked, and ``(id, key, mark)`` for a key that more than ``paired``
    texts have. Pairs have ``a < b``; or, with ``sides``, exactly one is marked, and it
    is ``b`` in partitions of even and ``a`` in those of odd number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # a partition may have several numbers
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("block"), strict=True):
                blocks.setdefault(part, []).append(unpack(blob.as_py()))
        for part in sorted(blocks):
            found = blocks.pop(part)
            yield from joined(part, np.concatenate([i for i, _ in found]), np.concatenate([w for _, w in found]))

    def joined(part: int, ids: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = sorted_order(word, 1 << (KEY_BITS + 1))
        word = word[order]
        key = word >> _ONE
        same = key[1:] == key[:-1]
        kept = np.flatnonzero(np.r_[same, False] | np.r_[False, same])  # most keys occur once
        ids, key, mark = ids[order[kept]], key[kept], (word[kept] & _ONE) == 1
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        met = ~mark[first]  # some are not marked
        if sides:
            met &= mark[first + n - 1]
        for heavy in (False, True):
            runs = np.flatnonzero(met & ((n > paired) == heavy))
            m = n[runs]
            take = np.repeat(first[runs] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            some, marked, of = ids[take], mark[take], np.repeat(np.arange(len(runs)), m)
            if heavy:
                name = (part << KEY_BITS) | key[take].astype(np.int64)
                for at in range(0, len(some), SENT):
                    cut = slice(at, at + SENT)
                    yield pa.RecordBatch.from_arrays([pa.array(some[cut]), pa.array(name[cut]), pa.array(marked[cut])], names=["a", "b", "large"])
                continue
            kinds, some = np.unique(some, return_inverse=True)
            pairs, held, gap, most = [], 0, 1, m.max(initial=0)
            run_on = np.arange(len(of))
            while gap < most:
                run_on = run_on[: np.searchsorted(run_on, len(of) - gap)]
                i = run_on = run_on[of[run_on + gap] == of[run_on]]
                j = i + gap
                ok = (some[i] != some[j]) & ((marked[i] ^ marked[j]) if sides else ~(marked[i] & marked[j]))
                i, j = i[ok], j[ok]
                if sides:  # marks are sorted: of the two, j has it
                    a, b = (some[j], some[i]) if part % 2 else (some[i], some[j])
                else:
                    a, b = np.minimum(some[i], some[j]), np.maximum(some[i], some[j])
                pairs.append(a * len(kinds) + b)
                held += len(i)
                gap += 1
                if gap >= most or held > HELD:
                    both = K.unique(np.concatenate(pairs))
                    for at in range(0, len(both), SENT):
                        b = both[at : at + SENT]
                        yield pa.RecordBatch.from_arrays([pa.array(kinds[b // len(kinds)]), pa.array(kinds[b % len(kinds)]), pa.nulls(len(b), pa.bool_())], names=["a", "b", "large"])
                    pairs, held = [], 0

    return run


def hot_rows(met: DataFrame) -> DataFrame:
    """``(id, key, large)``, the texts of keys that many have."""
    return met.where("large is not null").select(F.col("a").alias("id"), F.col("b").alias("key"), "large").distinct()


def near_blocks(limit: Callable[[np.ndarray, np.ndarray], np.ndarray], words: list[str], sides: bool):
    """``(a, b)``: of two blocks of texts with a key in common, the pairs that their
    sketches don't rule out. ``limit``: of two sizes, the greatest difference of similar
    sets. Near copies have many such keys in common; only the least of them gives the
    pair, so each text brings all of its own."""

    def table(cell) -> tuple:
        get = lambda f: cell.field(f).to_numpy(zero_copy_only=False)
        keys = cell.field("keys")
        own = np.repeat(np.arange(len(cell)), np.diff(keys.offsets.to_numpy())), keys.flatten().to_numpy()
        return get("id"), get("large").astype(bool), get("size").astype(np.int64), [get(w).view(np.uint64) for w in words], own

    def earlier(own: tuple[np.ndarray, np.ndarray], n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``known`` keys each text has, without and with a mark."""
        row, key = own
        at = np.minimum(np.searchsorted(known, key >> 1), max(len(known) - 1, 0))
        hit = known[at] == key >> 1 if len(known) else np.zeros(len(key), bool)
        out = np.zeros((2, n, len(known)), np.float32)
        out[key[hit] & 1, row[hit], at[hit]] = 1
        return out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column("key")[r].as_py()
                swap = sides and (name >> KEY_BITS) % 2 == 1
                ia, la, sa, wa, ka = table(batch.column("left")[r].values)
                ib, lb, sb, wb, kb = table(batch.column("right")[r].values)
                known = np.intersect1d(ka[1][ka[1] >> 1 < name] >> 1, kb[1][kb[1] >> 1 < name] >> 1)
                (ua, ma), (ub, mb) = earlier(ka, len(ia), known), earlier(kb, len(ib), known)
                for at in range(0, len(ia), 64):
                    cut = slice(at, at + 64)
                    apart = sum(np.bitwise_count(x[cut, None] ^ y[None, :]).astype(np.int32) for x, y in zip(wa, wb, strict=True))
                    marks = (la[cut, None] ^ lb[None, :]) if sides else ~(la[cut, None] & lb[None, :])
                    ok = (apart <= limit(sa[cut, None], sb[None, :])) & marks & (ia[cut, None] != ib[None, :])
                    if len(known) and ok.any():
                        met = ua[cut] @ mb.T + ma[cut] @ ub.T
                        ok &= (met if sides else met + ua[cut] @ ub.T) < 0.5
                    i, j = np.nonzero(ok)
                    a, b = ia[cut][i], ib[j]
                    if sides:
                        turn = la[cut][i] != swap  # the marked one goes last, or first
                        a, b = np.where(turn, b, a), np.where(turn, a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def met_in_blocks(hot: DataFrame, sketches: DataFrame, limit: Callable, block_sets: int, parts: int, sides: bool = False) -> DataFrame:
    """``(a, b)`` of the texts of :func:`hot_rows`, with ``sketches(id, size, w...)``: each
    pair of a key's blocks of about ``block_sets`` is a row, spread over all tasks."""
    n_blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("n"))
    # a text has no more keys than were made for it
    own = hot.groupBy("id").agg(F.collect_list(F.col("key") * 2 + F.col("large").cast("long")).alias("keys"))
    items = F.collect_list(F.struct("id", "large", "keys", *sketches.columns[1:])).alias("items")
    rows = hot.join(n_blocks, "key").join(own.join(sketches, "id"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    blocks = rows.groupBy("key", "block").agg(items)
    left = blocks.select("key", F.col("block").alias("i"), F.col("items").alias("left"))
    right = blocks.select("key", F.col("block").alias("j"), F.col("items").alias("right"))
    tasks = left.join(right, "key").where("i <= j").select("key", "left", "right").repartition(parts)
    return tasks.mapInArrow(near_blocks(limit, sketches.columns[2:], sides), "a long, b long").distinct()
