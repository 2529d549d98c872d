"""Packing items into containers by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import Scratch

#: Items of a block, islands that work on each block, and effort per epoch.
BLOCK_ITEMS, ISLANDS, EPOCHS = 2000, 2, 2
POPULATION, GENERATIONS, CROSSINGS = 10, 60, 6
#: Generations without a better packing that end an epoch.
PATIENCE = 8
#: Containers with most room that exchange items with the displaced ones.
ROOMIEST = 24
#: Containers less full than this are emptied and their items packed once more.
WEAK = 0.98

Bins = list[list[int]]


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: Bins) -> Bins:
    """Puts each item into the fullest bin that has room, else into a new one. A
    bit per amount of room tells in one step which is the least that suffices."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, items in enumerate(bins):
        room = capacity - sum(sizes[i] for i in items)
        by_room[room].append(b)
        rooms |= 1 << room
    for i in order:
        s = sizes[i]
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more unequal filling (full bins and a spare one)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def least_bins(sizes: list[int], capacity: int) -> int:
    """Bins that no packing can do without: by the sum of sizes, and, for each size up
    to half a bin, by the items that can't share a bin with one of that size or with
    each other and what they leave to the others."""
    ordered = sorted(sizes)
    run = [0]
    for s in ordered:
        run.append(run[-1] + s)
    half, best = bisect_right(ordered, capacity // 2), -(-run[-1] // capacity)
    for small in {0, *ordered[:half]}:
        alone = bisect_right(ordered, capacity - small)  # from here on nothing of this size fits beside them
        low = bisect_left(ordered, small)
        room = (alone - half) * capacity - (run[alone] - run[half])
        rest = run[half] - run[low] - room
        best = max(best, len(ordered) - half + max(0, -(-rest // capacity)))
    return max(1, best)


def exchange(sizes: list[int], bins: Bins, free: list[int], capacity: int) -> list[int]:
    """One or two items of a bin with room change places with one or two displaced
    items, if the bin gets fuller by it; what is displaced then, by rising size."""
    free = sorted(free, key=lambda i: sizes[i])
    rooms = sorted(((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins)), reverse=True)
    for room, k in rooms[:ROOMIEST]:
        if room <= 0 or not free:
            break
        b = bins[k]
        have = [sizes[i] for i in free]
        gain, change = 0, None
        for out in (*((x,) for x in b), *combinations(b, 2)):
            gone = sum(sizes[i] for i in out)
            most = gone + room
            at = bisect_right(have, most) - 1
            if at >= 0 and have[at] - gone > gain:
                gain, change = have[at] - gone, (out, (at,))
            low, high = 0, at
            while low < high and gain < room:
                both = have[low] + have[high]
                if both > most:
                    high -= 1
                    continue
                if both - gone > gain:
                    gain, change = both - gone, (out, (low, high))
                low += 1
            if gain == room:
                break
        if change:
            out, into = change
            bins[k] = [i for i in b if i not in out] + [free[x] for x in into]
            free = sorted([f for x, f in enumerate(free) if x not in into] + list(out), key=lambda i: sizes[i])
    return free


def cross(sizes: list[int], into: Bins, donor: Bins, capacity: int, rng: random.Random) -> Bins:
    """Injects some of the donor's fullest bins whole, removes the bins that hold a
    copy of an injected item, lets the items displaced by that change places with
    others where a bin gets fuller, and best-fits the rest."""
    full = sorted(donor, key=lambda b: sum(sizes[i] for i in b) + rng.random(), reverse=True)
    taken = rng.sample(full[: max(1, len(full) * 2 // 3)], k=max(1, rng.randint(len(full) // 8, max(1, len(full) // 2))))
    inside = {i for b in taken for i in b}
    child, displaced = [list(b) for b in taken], []
    for b in into:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    # the emptiest bins are opened too: else nothing new can form around them
    child.sort(key=lambda b: sum(sizes[i] for i in b))
    for b in child[: rng.randint(0, min(3, len(child) - 1))]:
        displaced += b
        b.clear()
    child = [b for b in child if b]
    displaced = exchange(sizes, child, displaced, capacity)
    return best_fit(sizes, displaced[::-1], capacity, child)


def evolve(sizes: list[int], capacity: int, elites: list[Bins], seed: str) -> Bins:
    """The best packing found. It ends at once when a packing has as few bins as any
    can have (:func:`least_bins`), else after PATIENCE generations without a better
    one. The first packing is best-fit decreasing, so no result is worse."""
    rng = random.Random(seed)
    bound = least_bins(sizes, capacity)
    decreasing = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [*elites, best_fit(sizes, decreasing, capacity, [])]
    scored = sorted(((fitness(sizes, b, capacity), k, b) for k, b in enumerate(people)), reverse=True)
    if -scored[0][0][0] <= bound:
        return scored[0][2]
    born = len(scored)

    def add(b: Bins) -> None:
        nonlocal born
        born += 1
        scored.append((fitness(sizes, b, capacity), born, b))

    while len(scored) < POPULATION:
        add(best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2)), capacity, []))
    scored.sort(reverse=True)
    still = 0
    for _ in range(GENERATIONS):
        before = scored[0][0]
        for _ in range(CROSSINGS):
            (_, _, a), (_, _, b) = rng.sample(scored[:POPULATION], 2)
            add(cross(sizes, a, b, capacity, rng))
        # of packings of one fitness the youngest lives on
        scored = sorted({s[0]: s for s in sorted(scored)}.values(), reverse=True)[:POPULATION]
        if -scored[0][0][0] <= bound:
            break
        still = 0 if scored[0][0] > before else still + 1
        if still == PATIENCE or len(scored) < 2:
            break
    return scored[0][2]


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of one block and island: its items, with the bins of its own elite
        and of the neighbour's (``elite`` 0 and 1) after the first epoch."""
        own = pdf[pdf["elite"] == 0].sort_values(["doc_id", "part"], ignore_index=True)
        place = {k: i for i, k in enumerate(zip(own["doc_id"], own["part"], strict=True))}
        sizes = own["size"].tolist()
        elites: list[Bins] = []
        if epoch:
            for _, e in pdf.groupby("elite"):
                bins: dict[int, list[int]] = {}
                for d, p, b in zip(e["doc_id"], e["part"], e["bin"], strict=True):
                    bins.setdefault(b, []).append(place[d, p])
                elites.append(list(bins.values()))
        best = evolve(sizes, capacity, elites, f"{key[0]}:{key[1]}:{epoch}")
        bin_of = [0] * len(sizes)
        for b, items in enumerate(best):
            for i in items:
                bin_of[i] = b
        n, fill = fitness(sizes, best, capacity)
        return own[["block", "island", "doc_id", "part", "size"]].assign(bin=bin_of, n_bins=-n, fill=fill)

    return run


SOLVED = "block long, island int, doc_id long, part long, size long, bin int, n_bins int, fill double"


def _pack_blocks(items: DataFrame, capacity: int, n_blocks: int, scratch: Scratch, name: str) -> DataFrame:
    """``(block, doc_id, part, size, bin)``, each block's best packing.

    Each block goes to ISLANDS islands with populations of their own; after every
    epoch an island's elite migrates to the next island of the block. Blocks hold
    about BLOCK_ITEMS items whatever the input, so no task grows."""
    spread = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n_blocks)))
    state = spread.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "doc_id", "part", "size",
        F.lit(0).alias("bin"), F.lit(0).alias("elite"))
    for e in range(EPOCHS):
        solved = scratch.write(state.groupBy("block", "island").applyInPandas(_epoch(capacity, e), SOLVED), f"{name}_epoch{e}")
        moved = F.explode(F.array(
            F.struct(F.col("island"), F.lit(0).alias("elite")),
            F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(1).alias("elite"))))
        state = solved.withColumn("_to", moved).select("block", "_to.island", "doc_id", "part", "size", "bin", "_to.elite")
    best = solved.groupBy("block").agg(F.min_by("island", F.struct("n_bins", -F.col("fill"), "island")).alias("island"))
    return solved.join(best, ["block", "island"]).select("block", "doc_id", "part", "size", "bin")


def pack(sizes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, part, first_token, size, container_id)`` of ``sizes(doc_id, size)``.

    Every item lies in one container, unless it is larger than the capacity: then
    it is divided into full containers and a rest (``part`` 0, 1, ...), which is
    packed like any item. Items of size 0 take part. Rows with a null id are left
    out, a null size is 0; of rows with one id the largest counts. No container
    holds more than ``capacity``.

    Items are spread over blocks by hash and packed there. Only the containers of
    a block that stay less than WEAK full, one or two of hundreds, are emptied, and
    their items are packed together a second time.
    """
    if capacity < 1:
        raise ValueError("the capacity is at least 1")
    items = sizes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.greatest(F.max(F.coalesce("size", F.lit(0))), F.lit(0)).cast("long").alias("n"))
    items = scratch.write(items, "items")
    full = items.where(F.col("n") > capacity).select(
        "doc_id", F.posexplode(F.sequence(F.lit(1), F.expr(f"cast(n div {capacity} as int)"))).alias("p", "_")
    ).select("doc_id", F.col("p").cast("long").alias("part"), F.lit(capacity).cast("long").alias("size"),
             F.concat_ws("-", F.lit("full"), "doc_id", "p").alias("container_id"))
    rest = items.select(
        "doc_id",
        F.when(F.col("n") > capacity, F.expr(f"n div {capacity}")).otherwise(F.lit(0)).cast("long").alias("part"),
        F.when(F.col("n") > capacity, F.col("n") % capacity).otherwise(F.col("n")).alias("size"),
        (F.col("n") > capacity).alias("_cut"),
    ).where("not _cut or size > 0").drop("_cut")
    n_rest = rest.count()
    parts = [full]
    if n_rest:
        first = scratch.write(_pack_blocks(rest, capacity, -(-n_rest // BLOCK_ITEMS), scratch, "first"), "first")
        filled = F.sum("size").over(Window.partitionBy("block", "bin"))
        first = first.withColumn("_weak", filled < WEAK * capacity)
        label = lambda level: F.concat_ws("-", F.lit(level), "block", "bin").alias("container_id")
        parts.append(first.where("not _weak").select("doc_id", "part", "size", label("a")))
        weak = scratch.write(first.where("_weak").select("doc_id", "part", "size"), "weak")
        if n_weak := weak.count():
            again = _pack_blocks(weak, capacity, -(-n_weak // BLOCK_ITEMS), scratch, "second")
            parts.append(again.select("doc_id", "part", "size", label("b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "part", (F.col("part") * capacity).alias("first_token"), "size", "container_id")
