"""Connected components by Hash-to-Min, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.session import Scratch

#: Components with at least 1/LARGE of all records decide which seed is taken; there
#: are at most LARGE of them whatever the input.
LARGE = 2000
#: Seeds that are tried, and the deviation of a split's share that ends the search.
SEEDS, TOLERANCE = 1024, 0.01
MAX_SPLITS = 100


def hash_to_min(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; the root is the least
    node of the component.

    Every node holds a cluster, at first itself and its neighbours. In each round
    it sends the whole cluster to the least member and the least member to every
    other; what arrives is its next cluster. It ends, after a number of rounds
    logarithmic in the diameter in practice, when nothing changes. A cluster is a
    set of rows ``(v, u)``, never an array, so that no task holds a component;
    each round is written to the shared folder and the one before is removed.

    Rows with a null end are left out. An edge from a node to itself makes a
    component of one. No edges give an empty result.
    """
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).dropna()
    both = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")),
                             F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u")))
    state = scratch.write(ends.distinct().select(both.alias("e")).select("e.*").distinct(), f"{name}0")
    before = None
    for i in range(1, max_rounds + 1):
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(least, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        )
        # what tells one state from another is computed as the state is written
        seen = Observation()
        state = scratch.write(
            sent.select("e.*").distinct().observe(
                seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u") % 1000003).alias("x"), F.sum(F.xxhash64("u", "v") % 1000033).alias("y")),
            f"{name}{i}")
        mark = seen.get
        scratch.drop(f"{name}{i - 1}")
        if mark == before:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def label_edges(records: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Distinct edges between the first key of a record and each of its others
    (to itself where it has one alone). ``keys``: column to a one-letter tag that
    keeps the columns' values apart. A record without any key gives no edge."""
    tagged = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:"), F.col(c))) for c, t in keys.items()]
    first = F.coalesce(*tagged)
    return records.select(first.alias("a"), F.explode(F.array_compact(F.array(*tagged))).alias("b")).distinct()


def draw(seed: Column, component: Column, split: str) -> Column:
    """A number between 0 and 1 from the first 48 bits of an MD5 sum."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), component, F.lit(split))), 1, 12), 16, 10)
    return (bits.cast("double") + 1) / F.lit(2.0**48 + 1)


def rendezvous(seed: Column, component: Column, shares: dict[str, float]) -> Column:
    """The split of a component: the greatest ``-w / ln(u)``, ``u`` its draw for a split
    of weight ``w``; of equal scores the later name."""
    scored = [F.struct((-F.lit(float(w)) / F.log(draw(seed, component, s))).alias("score"), F.lit(s).alias("split")) for s, w in shares.items()]
    return F.greatest(*scored)["split"] if len(scored) > 1 else scored[0]["split"]


class GroupedSplits:
    """Splits in which records that share a value of any key column, directly or through
    others, are together, and whose sizes come close to ``shares``.

    ``splits``: ``(id, component, split)``, one row per distinct non-null ``id``.
    ``assigned``: ``(component, n, split)``, n its ids. ``nodes``: ``(node, component)``,
    the keys' values behind their tags. ``seed``: the one that was taken.

    Weighted rendezvous hashing: every component, of whatever size, goes to the split
    with the greatest score of a hash of seed, component and split, so an assignment
    depends on nothing but these and the weights: with a given ``seed`` a new record
    moves no component but those that it links.

    When a few components hold most records, one seed in a hundred comes close to the
    shares. Without a given seed, the first of SEEDS is taken that misses no share by
    more than ``tolerance`` (of all records), or else the one that misses least. The
    search hashes the components with at least 1/2000 of the records (at most 2000 of
    them); the rest are counted by their expectation. Store the seed with the splits
    and give it when records are added. A component larger than every share overfills
    one split: no rule can avoid it.

    Shares are scaled to add up to 1; splits without a positive share get nothing. A
    record without keys is a component of its own. If rows of an id differ in their
    keys, they link them. Rows with a null id are in no split, but their keys are linked.
    """

    def __init__(
        self, records: DataFrame, id_col: str, keys: dict[str, str], shares: dict[str, float], scratch: Scratch,
        seed: int | None = None, seeds: int = SEEDS, tolerance: float = TOLERANCE, max_rounds: int = 60,
    ):
        if len(shares) > MAX_SPLITS:
            raise ValueError(f"more than {MAX_SPLITS} splits")
        shares = {s: w for s, w in sorted(shares.items()) if s is not None and w is not None and w > 0}
        if not shares:
            raise ValueError("no split has a positive share")
        self.shares = {s: w / sum(shares.values()) for s, w in shares.items()}
        self.keys = keys

        tagged = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:"), F.col(c))) for c, t in keys.items()]
        own = F.concat(F.lit("id:"), F.col("_id").cast("string"))
        slim = records.select(F.col(id_col).alias("_id"), *[F.col(c) for c in keys]).distinct()
        slim = scratch.write(slim.withColumn("_node", F.coalesce(*tagged, own)).where("_node is not null"), "slim")
        # rows of one id that differ in their keys are linked through the id
        torn = slim.where("_id is not null").groupBy("_id").agg(F.min("_node").alias("_x"), F.max("_node").alias("_y")).where("_x <> _y").select("_id")
        several = slim.join(torn, "_id").select(own.alias("a"), F.col("_node").alias("b"))
        roots = hash_to_min(label_edges(slim, keys).unionByName(several), scratch, max_rounds=max_rounds)
        self.nodes = scratch.write(roots.select("node", F.col("root").alias("component")), "nodes")
        member = (
            slim.where("_id is not null").join(self.nodes, slim["_node"] == self.nodes["node"], "left")
            .select("_id", F.coalesce("component", "_node").alias("component")).groupBy("_id").agg(F.min("component").alias("component"))
        )
        member = scratch.write(member, "member")
        sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        # components of rows without an id hold no record, but they have a split
        sizes = scratch.write(sizes.unionByName(self.nodes.select("component", F.lit(0).cast("long").alias("n"))).groupBy("component").agg(F.sum("n").alias("n")), "sizes")
        self.seed = self._best_seed(sizes, seeds, tolerance) if seed is None else seed
        self.assigned = sizes.select("component", "n", rendezvous(F.lit(self.seed), F.col("component"), self.shares).alias("split"))
        self.splits = member.withColumnRenamed("_id", id_col).withColumn("split", rendezvous(F.lit(self.seed), F.col("component"), self.shares))

    def _best_seed(self, sizes: DataFrame, seeds: int, tolerance: float) -> int:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        if not total:
            return 0
        # few rows, but each is hashed many times: tasks by their number, not their bytes
        tasks = sizes.sparkSession.sparkContext.defaultParallelism
        large = sizes.where(F.col("n") * LARGE >= total).repartition(tasks, "component").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
        chosen = large.select("seed", "n", rendezvous(F.col("seed"), F.col("component"), self.shares).alias("split"))
        per = chosen.groupBy("seed").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"n{i}") for i, s in enumerate(self.shares)]).collect()
        missed = {}
        for r in per:  # a row per seed
            got = [r[f"n{i}"] for i in range(len(self.shares))]
            rest = total - sum(got)
            missed[r["seed"]] = max(abs((g + rest * w) / total - w) for g, w in zip(got, self.shares.values(), strict=True))
        within = [s for s, m in missed.items() if m <= tolerance]
        return min(within) if within else min(missed, key=lambda s: (missed[s], s), default=0)

    def linked(self, of: str) -> DataFrame:
        """``(<of>_a, <of>_b, split)``: all pairs of different values of the key ``of``
        that lie in one component and so in one split, the smaller first. The pairs
        are the result asked for; ``nodes`` has a row per value."""
        tag = f"{self.keys[of]}:"
        named = self.nodes.join(self.assigned.select("component", "split"), "component")
        named = named.where(F.col("node").startswith(tag)).select("component", "split", F.substring("node", len(tag) + 1, 2**31 - 1).alias("key"))
        a, b = named.withColumnRenamed("key", f"{of}_a"), named.select("component", F.col("key").alias(f"{of}_b"))
        return a.join(b, "component").where(F.col(f"{of}_a") < F.col(f"{of}_b")).select(f"{of}_a", f"{of}_b", "split")


def grouped_splits(records: DataFrame, id_col: str, keys: dict[str, str], shares: dict[str, float], scratch: Scratch, seed: int | None = None) -> DataFrame:
    """``(id, component, split)`` of :class:`GroupedSplits`."""
    return GroupedSplits(records, id_col, keys, shares, scratch, seed).splits
