"""Queries of the problems tagged llm, and the SQL that checks them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.labels import family_key, family_key_sql, superfamily_key, superfamily_key_sql
from kinfold.functions.sequences import clean_sequence_sql, usable_proteins
from kinfold.llm.chunking import split_texts
from kinfold.llm.components import LARGE, SEEDS, TOLERANCE, GroupedSplits
from kinfold.llm.leakage import leaks
from kinfold.llm.near_duplicates import NearDuplicates
from kinfold.llm.overlap import SplitOverlap, current_split
from kinfold.llm.packing import pack
from kinfold.llm.quota_sample import OTHERS, QuotaSample
from kinfold.llm.tokens import text_sizes
from kinfold.session import Scratch, table

KEYS = {"superfamily": "s", "family": "f"}
MAX_SETTINGS = 10_000


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins")
    return p.select("pid", superfamily_key(F.col("superfamily")).alias("superfamily"), family_key(F.col("family")).alias("family"))


def _settings(df: DataFrame) -> list:
    """Rows of a table of settings; one that holds data is refused."""
    rows = df.limit(MAX_SETTINGS + 1).collect()
    if len(rows) > MAX_SETTINGS:
        raise ValueError(f"more than {MAX_SETTINGS} rows of settings")
    return rows


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r["split"]: r["share"] for r in _settings(table(spark, d, "split_plan"))}


def _splits(spark: SparkSession, d: str) -> GroupedSplits:
    return GroupedSplits(_keyed(spark, d), "pid", KEYS, _shares(spark, d), Scratch(spark, "p1"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Superfamilies that the splits keep together."""
    return _splits(spark, d).linked("superfamily").drop("split")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of each protein, with its component."""
    return _splits(spark, d).splits


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Proteins and components per split, against the plan."""
    got = _splits(spark, d).assigned.where("n > 0").groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_components"))
    plan = table(spark, d, "split_plan").select("split", F.col("share").alias("wanted"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # a row per split
    share = F.coalesce("n", F.lit(0)) / total
    return plan.join(got, "split", "left").select(
        "split", "wanted", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
        F.round(share, 9).alias("share"), F.round(share - F.col("wanted"), 9).alias("error"))


def _near(spark: SparkSession, d: str) -> tuple[NearDuplicates, Scratch]:
    scratch = Scratch(spark, "p3")
    texts = usable_proteins(table(spark, d, "proteins")).select(F.col("pid").alias("id"), "seq")
    return NearDuplicates(texts, scratch, k=5, threshold=Fraction(1, 2)), scratch


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _near(spark, d)[0].all_pairs()
    return pairs.select(F.col("id_a").alias("pid_a"), F.col("id_b").alias("pid_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per usable protein: class of equal sets, group, number of links."""
    near, scratch = _near(spark, d)
    return near.groups(scratch).withColumnRenamed("id", "pid")


def _overlap(spark: SparkSession, d: str) -> SplitOverlap:
    texts = usable_proteins(table(spark, d, "proteins")).select("pid", "seq")
    split = current_split(table(spark, d, "split_members"))
    texts = texts.join(split, "pid").select(F.col("pid").alias("id"), "seq", "split")
    return SplitOverlap(texts, Scratch(spark, "p4"), k=5, containment=Fraction(4, 5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _overlap(spark, d).pairs
    return pairs.select(F.least("eval_id", "train_id").alias("pid_a"), F.greatest("eval_id", "train_id").alias("pid_b"))


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation protein."""
    labels = usable_proteins(table(spark, d, "proteins"), "source_db", with_seq=False).select(F.col("pid").alias("id"), "source_db")
    return _overlap(spark, d).counts(labels, ["split", "source_db"])


def p4_by_superfamily(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per superfamily key of the evaluation protein."""
    labels = usable_proteins(table(spark, d, "proteins"), "superfamily", with_seq=False).select(F.col("pid").alias("id"), superfamily_key(F.col("superfamily")).alias("superfamily"))
    return _overlap(spark, d).counts(labels, ["superfamily"])


def _quotas(spark: SparkSession, d: str) -> QuotaSample:
    records = usable_proteins(table(spark, d, "proteins"), "superfamily", with_seq=False).select(F.col("pid").alias("id"), superfamily_key(F.col("superfamily")).alias("leaf"))
    mix = table(spark, d, "target_mix")
    # a label that is there but names nothing is no category, nor is it the rest
    key = superfamily_key(F.col("superfamily"))
    targets = mix.where(F.col("superfamily").isNull() | key.isNotNull()).select(key.alias("leaf"), "share_per_10000", "min_rows", "sample_rows")
    return QuotaSample(records, targets, Scratch(spark, "p5"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Named categories of which fewer were drawn than wanted. A category that others take
    over from has as many as it wants, so no other is among them."""
    quotas = _quotas(spark, d)
    drawn = quotas.sample.groupBy("leaf").agg(F.count(F.lit(1)).alias("drawn"))
    short = quotas.report.join(drawn, "leaf", "left").where(F.coalesce("drawn", F.lit(0)) < F.col("wanted"))
    return short.where(F.col("leaf") != OTHERS).select(F.col("leaf").alias("superfamily"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Each category's wish, supply, quota and shortfall; ``*`` is the rest."""
    return _quotas(spark, d).report.withColumnRenamed("leaf", "superfamily")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    """The proteins drawn, with the category that they were drawn for."""
    return _quotas(spark, d).sample.select(F.col("id").alias("pid"), F.col("leaf").alias("superfamily"))


def _limit(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    r = table(spark, d, "size_limits").where(F.col("purpose") == purpose).first()
    if r is None or r["max_tokens"] is None:
        raise ValueError(f"size_limits has no limit for {purpose!r}")
    return r["max_tokens"], r["overlap_tokens"] or 0


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each part of one that is divided."""
    scratch = Scratch(spark, "p6")
    return pack(text_sizes(table(spark, d, "documents")), _limit(spark, d, "container")[0], scratch)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = p6_containers(spark, d)
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest possible for the sum of sizes, and their filling."""
    capacity = _limit(spark, d, "container")[0]
    per = p6_containers(spark, d).groupBy("container_id").agg(F.sum("size").alias("size"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("size") / capacity).alias("n_least"), F.avg(F.col("size") / capacity).alias("filling"), F.max("size").alias("fullest"))


def p6_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each document's parts and tokens as they lie in containers, and whether all of
    these hold no more than they can."""
    capacity = _limit(spark, d, "container")[0]
    parts = p6_containers(spark, d)
    filled = parts.groupBy("container_id").agg(F.sum("size").alias("filled"))
    return parts.join(filled, "container_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("n_tokens"), (F.max("filled") <= capacity).alias("fits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "test_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each test item that leaked, with the number of documents that hold it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "piece")
    pieces = split_texts(table(spark, d, "documents"), limit, overlap)
    return pieces.where("piece = 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their texts."""
    return split_texts(table(spark, d, "documents"), *_limit(spark, d, "piece"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each text that lie in pieces, overlaps counted once, and whether all
    pieces are within the limit."""
    limit, overlap = _limit(spark, d, "piece")
    pieces = split_texts(table(spark, d, "documents"), limit, overlap)
    return pieces.groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("core_char")).alias("n_chars"), (F.max("n_tokens") <= limit).alias("fits"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_shares, p3_found, p3_groups, p4_found, p4_by_source, p4_by_superfamily, p5_found,
              p5_report, p5_sample, p6_found, p6_containers, p6_parts, p6_fill, p7_found, p7_items, p8_found, p8_pieces, p8_cover)
}

USABLE_SQL = f"""
  proteins_once as (select pid, arg_max(sequence, loaded_at) sequence, arg_max(superfamily, loaded_at) superfamily, arg_max(source_db, loaded_at) source_db
                    from proteins where pid is not null group by pid),
  usable as (select pid, seq, superfamily, source_db from (select *, {clean_sequence_sql('sequence')} seq from proteins_once)
             where length(seq) between 20 and 512),
  grams as (select distinct pid, unnest([seq[i:i+4] for i in range(1, length(seq) - 3)]) g from usable),
  sizes as (select pid, count(*) n from grams group by pid),
  common as (select a.pid a, b.pid b, count(*) c from grams a join grams b on a.g = b.g and a.pid < b.pid group by all)"""

SPLIT_SQL = """
  named as (select pid, assigned_at, split, case
      when lower(regexp_replace(split, '[\\s\\p{Z}\\p{C}]', '', 'g')) in ('train', 'training') then 'train'
      when lower(regexp_replace(split, '[\\s\\p{Z}\\p{C}]', '', 'g')) in ('validation', 'valid', 'val') then 'validation'
      when lower(regexp_replace(split, '[\\s\\p{Z}\\p{C}]', '', 'g')) in ('test', 'testing') then 'test' end s
    from split_members where pid is not null),
  current as (select pid, s from (select *, row_number() over (partition by pid order by assigned_at desc nulls last,
    (split is null) desc, coalesce(s, '') desc) r from named) where r = 1 and s is not null)"""

OVERLAP_SQL = f"""with {USABLE_SQL}, {SPLIT_SQL},
  pairs as (select case when x.s = 'train' then b else a end e, case when x.s = 'train' then a else b end t,
                   case when x.s = 'train' then y.s else x.s end split
            from common join current x on x.pid = a join current y on y.pid = b
            join sizes m on m.pid = a join sizes n on n.pid = b
            where (x.s = 'train') <> (y.s = 'train') and c * 5 >= least(m.n, n.n) * 4),
  evals as (select u.pid, u.superfamily, u.source_db, c.s split, coalesce(p.n, 0) n
            from usable u join current c on c.pid = u.pid left join (select e, count(*) n from pairs group by e) p on p.e = u.pid where c.s <> 'train')"""

TOKENS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\p{C}]'))"


def _level_sql(n: int, up: str) -> str:
    cut = lambda run, whole: f"((least(us, ss)::hugeint * ({run})) // greatest({whole}, 1))::bigint"
    return f"""
  u{n} as (select leaf, wanted, available, quota, unmet, available - quota spare, {up} up from q{n - 1}),
  w{n} as (select *, (sum(unmet) over (partition by up))::bigint us, (sum(spare) over (partition by up))::bigint ss,
             (sum(unmet) over (partition by up order by leaf))::bigint ur, (sum(spare) over (partition by up order by leaf))::bigint sr from u{n}),
  q{n} as (select leaf, wanted, available, quota + {cut('sr', 'ss')} - {cut('sr - spare', 'ss')} quota,
             unmet - ({cut('ur', 'us')} - {cut('ur - unmet', 'us')}) unmet from w{n})"""


QUOTA_SQL = f"""with once as (select pid, arg_max(sequence, loaded_at) sequence, arg_max(superfamily, loaded_at) superfamily from proteins where pid is not null group by pid),
  records as (select pid, {superfamily_key_sql('superfamily')} leaf from once where length({clean_sequence_sql('sequence')}) between 20 and 512),
  wishes as (select coalesce(leaf, '*') leaf, greatest(max(coalesce(min_rows, 0)), (sum(coalesce(share_per_10000, 0))::bigint * max(coalesce(sample_rows, 0)) + 9999) // 10000)::bigint wanted
    from (select *, {superfamily_key_sql('superfamily')} leaf from target_mix) where superfamily is null or leaf is not null group by 1),
  placed as (select r.pid, coalesce(w.leaf, '*') leaf from records r left join wishes w on w.leaf = r.leaf and w.leaf <> '*'),
  supply as (select leaf, count(*) available from placed group by leaf),
  q0 as (select w.leaf, wanted, coalesce(available, 0) available, least(wanted, coalesce(available, 0)) quota,
           wanted - least(wanted, coalesce(available, 0)) unmet from wishes w left join supply s using (leaf)),
  {_level_sql(1, "case when starts_with(leaf, 'cl') then 'cl' else array_to_string(string_split(leaf, '.')[1:2], '.') end")},
  {_level_sql(2, "case when starts_with(leaf, 'cl') then 'cl' else split_part(leaf, '.', 1) end")},
  {_level_sql(3, "'root'")}"""

COMPONENT_SQL = f"""rec as (select distinct pid, 's:' || {superfamily_key_sql('superfamily')} sn, 'f:' || {family_key_sql('family')} fn from proteins),
  noded as (select *, coalesce(sn, fn, 'id:' || pid) node from rec),
  torn as (select pid from noded where pid is not null group by 1 having count(distinct node) > 1),
  e as (select distinct sn a, fn b from noded where sn is not null and fn is not null union select 'id:' || pid, node from noded where pid in (from torn)),
  n as (select a v, b u from e union select b, a from e union select node, node from noded where node is not null and not starts_with(node, 'id:')),
  r(v, root) as (select v, v from n union select n.u, r.root from r join n on n.v = r.v),
  c as (select v, min(root) root from r group by v)"""

# the same draws and the same search for a seed
SPLITS_SQL = f"""{COMPONENT_SQL},
  member as (select pid, min(coalesce(root, node)) component from noded left join c on v = node where pid is not null group by 1),
  sizes as (select component, count(*) n from member group by 1),
  plan as (select split, share / (select sum(share) from split_plan where share > 0) w from split_plan where share > 0),
  total as (select sum(n)::double t from sizes),
  tried as (select seed, component, n, arg_max(split, -w / ln((('0x' || substr(md5(seed || ':' || component || ':' || split), 1, 12))::bigint + 1) / (2.0::double ** 48 + 1))) split
    from sizes, plan, range({SEEDS}) x(seed), total where n * {LARGE} >= t group by all),
  filled as (select seed, split, sum(n) g from tried group by all),
  missed as (select seed, max(abs((coalesce(g, 0) + rest * w) / t - w)) m
    from (select seed, t - sum(n) rest, t from tried, total group by seed, t) join plan on true left join filled using (seed, split) group by seed),
  best as (select coalesce(min(seed) filter (m <= {TOLERANCE}), arg_min(seed, (m, seed))) seed from missed),
  splits as (select pid, component, split from member join (
    select component, arg_max(split, -w / ln((('0x' || substr(md5(seed || ':' || component || ':' || split), 1, 12))::bigint + 1) / (2.0::double ** 48 + 1))) split
    from sizes, plan, best group by 1) using (component))"""

ORACLE = {
    "p1_found": f"""with recursive {COMPONENT_SQL}
  select substr(x.v, 3) superfamily_a, substr(y.v, 3) superfamily_b from c x join c y on x.root = y.root
  where x.v like 's:%' and y.v like 's:%' and x.v < y.v""",
    "p1_splits": f"with recursive {SPLITS_SQL} select pid, component, split from splits",
    "p1_shares": f"""with recursive {SPLITS_SQL}, got as (select split, count(*) n, count(distinct component) k from splits group by 1)
  select p.split, p.share wanted, coalesce(n, 0) n, coalesce(k, 0) n_components, round(coalesce(n, 0) / (sum(n) over ())::double, 9) share,
    round(coalesce(n, 0) / (sum(n) over ())::double - p.share, 9) error from split_plan p left join got g on g.split = p.split""",
    "p3_found": f"""with {USABLE_SQL} select a pid_a, b pid_b from common join sizes m on m.pid = a join sizes n on n.pid = b
  where c * 2 >= m.n + n.n - c""",
    "p3_groups": f"""with recursive {USABLE_SQL},
  near as (select a, b, c = m.n and c = n.n same from common join sizes m on m.pid = a join sizes n on n.pid = b where c * 2 >= m.n + n.n - c),
  ends as (select a, b, same from near union all select b, a, same from near),
  r(v, root) as (select pid, pid from sizes union select b, root from r join ends on a = v),
  g as (select v, min(root) root from r group by v), k as (select b, min(a) a from ends where same group by b), l as (select a, count(*) n from ends group by a)
  select s.pid, least(s.pid, coalesce(k.a, s.pid)) class_id, g.root group_id, coalesce(l.n, 0) n_links
  from sizes s join g on g.v = s.pid left join k on k.b = s.pid left join l on l.a = s.pid""",
    "p4_found": f"{OVERLAP_SQL} select least(e, t) pid_a, greatest(e, t) pid_b from pairs",
    "p4_by_source": f"{OVERLAP_SQL} select split, source_db, sum(n)::bigint n_pairs, count(*) n_eval, count(*) filter (n > 0) n_contained from evals group by all",
    "p4_by_superfamily": f"{OVERLAP_SQL} select {superfamily_key_sql('superfamily')} superfamily, sum(n)::bigint n_pairs, count(*) n_eval, count(*) filter (n > 0) n_contained from evals group by 1",
    "p5_found": f"{QUOTA_SQL} select leaf superfamily from q0 where leaf <> '*' and available < wanted",
    "p5_report": f"{QUOTA_SQL} select q3.leaf superfamily, q3.wanted, q3.available, q3.quota, q0.unmet short, q3.unmet from q3 join q0 using (leaf)",
    "p5_sample": f"""{QUOTA_SQL} select pid, leaf superfamily from (select p.pid, p.leaf, q3.quota,
    row_number() over (partition by p.leaf order by md5('42:' || p.pid), p.pid) r from placed p join q3 using (leaf)) where r <= quota""",
    "p6_found": f"select doc_id from documents where {TOKENS_SQL} > (select max_tokens from size_limits where purpose = 'container')",
    "p6_parts": f"""with s as (select doc_id, {TOKENS_SQL} n, (select max_tokens from size_limits where purpose = 'container') c from documents)
  select doc_id, greatest(1, (n + c - 1) // c)::bigint n_parts, n::bigint n_tokens, true fits from s""",
    "p8_cover": "select doc_id, length(text) n_chars, true fits from documents where text is not null",
    "p8_found": f"select doc_id from documents where {TOKENS_SQL} > (select max_tokens from size_limits where purpose = 'piece')",
}
