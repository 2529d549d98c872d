"""Named queries over the tables of a folder, and the SQL that checks them.

Searches take every row whose id is divisible by 50 as a query, against all rows.
Every other query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import vectors as V
from kinfold.functions.labels import family_key, family_key_sql, superfamily_key, superfamily_key_sql
from kinfold.functions.sequences import RESIDUES, clean_sequence, clean_sequence_sql, is_strict, kmers, length_ok, usable_proteins
from kinfold.operators import align, evaluate, groups, hits, kmer_index, minhash, ordering, search
from kinfold.operators.encode import HashEncoder, encode_pooled, tokenize
from kinfold.operators.skew import eager_join_aggregate, middle_rows
from kinfold.plans.experiment import experiment
from kinfold.session import Scratch, table
from kinfold.sources.fasta import read_fasta, write_fasta
from kinfold.sources.m8 import read_hits
from kinfold.sources.stockholm import read_clans, read_stockholm

EVERY = 50
#: Queries that are timed by each method.
TIMED = 100
KS_SQL = "(values (1), (5), (10), (100)) k(k)"


def _queries(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("id") % EVERY == 0)


# --- a few keys hold most rows ------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The middle protein by length of each superfamily. Labels are written in many ways:
    lengths are counted by spelling, and only spellings are cleaned."""
    scratch = Scratch(spark, "p2")
    usable = usable_proteins(table(spark, d, "proteins"), "superfamily", with_seq=False)
    rows = scratch.write(usable.select(F.col("superfamily").alias("spelling"), "pid", "n"), "rows")
    names = rows.select("spelling").distinct().withColumn("superfamily", superfamily_key(F.col("spelling")))
    return middle_rows(rows, scratch.write(names, "names"), "spelling", "superfamily", "n", "pid", scratch)


def p2_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits and summed e-values by superfamily of the target: hits per target and
    proteins per id are aggregated before they are joined."""
    p = usable_proteins(table(spark, d, "proteins"), "superfamily", with_seq=False).select(F.col("pid").alias("target"), superfamily_key(F.col("superfamily")).alias("superfamily"))
    h = table(spark, d, "hits").select("target", "evalue")
    out = eager_join_aggregate(h, p, "target", ["superfamily"], left_sums={"e": F.col("evalue")})
    return out.select("superfamily", F.col("n_pairs").alias("n_hits"), F.round(F.col("e"), 3).alias("sum_evalue"))


def p2_family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of proteins with one family key, per superfamily of the second: counts
    are multiplied, no pair is formed."""
    p = usable_proteins(table(spark, d, "proteins"), "superfamily", "family", with_seq=False).select(
        "n", superfamily_key(F.col("superfamily")).alias("superfamily"), family_key(F.col("family")).alias("family"))
    out = eager_join_aggregate(p, p, "family", ["superfamily"], left_sums={"l": F.col("n")}, right_sums={"r": F.col("n")})
    return out.select("superfamily", "n_pairs", F.col("l").alias("sum_left"), F.col("r").alias("sum_right"))


# --- vector search ------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("label"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """1 to 4 tokens of 16 dimensions per vector, each of unit length."""
    part = lambda t: V.l2_normalize(F.slice("vec", t * 16 + 1, 16))
    toks = F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), part).cast("array<array<float>>")
    return _vectors(spark, d).select("id", toks.alias("vec"), "label")


def _top(corpus: DataFrame, block: search.Block, k: int = 100) -> DataFrame:
    return search.top_k(_queries(corpus), corpus, block, k)


def topk_dot(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_top(_vectors(spark, d), search.dot_block))


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_top(_vectors(spark, d), search.cosine_block))


def topk_maxsim(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_top(_tokens(spark, d), search.maxsim_block))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "did", "score", "rk")


def maxsim_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every score of the queries."""
    t = _tokens(spark, d)
    return search.all_scores(_queries(t), t, search.maxsim_block).withColumn("score", F.round("score", 6))


def topk_single_query(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return search.top_k_of_one(v.where("id = 1"), v, V.dot, 100).select("did", "score")


def _recall(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    return evaluate.recall_at_k(evaluate.recall_per_query(ranked, corpus.select("id", "label"), _queries(corpus).select("id")))


def recall_dot(spark: SparkSession, d: str) -> DataFrame:
    c = _vectors(spark, d)
    return _recall(_top(c, search.dot_block), c)


def recall_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = _vectors(spark, d)
    return _recall(_top(c, search.cosine_block), c)


def recall_maxsim(spark: SparkSession, d: str) -> DataFrame:
    c = _tokens(spark, d)
    return _recall(_top(c, search.maxsim_block), c)


def meanpool(spark: SparkSession, d: str) -> DataFrame:
    pooled = _tokens(spark, d).select("id", V.mean_pool(F.col("vec"), 16).alias("v"))
    return pooled.select("id", F.round(V.total(F.col("v")), 6).alias("total"), F.round(V.l2_norm(F.col("v")), 6).alias("norm"))


def meanpool_no_special(spark: SparkSession, d: str) -> DataFrame:
    pooled = _tokens(spark, d).select("id", V.mean_pool_inner(F.col("vec"), 16).alias("v"))
    return pooled.select("id", F.round(V.total(F.col("v")), 6).alias("total"), F.round(V.l2_norm(F.col("v")), 6).alias("norm"))


#: Stands for trained weights of a projection from 16 to 8 dimensions.
WEIGHTS = [[((7 * i + 3 * j) % 13 - 6) / 13 for j in range(16)] for i in range(8)]


def meanpool_projected(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the tokens, projected to 8 dimensions."""
    pooled = _tokens(spark, d).select("id", V.project(V.mean_pool(F.col("vec"), 16), WEIGHTS).alias("v"))
    return pooled.select("id", F.round(V.total(F.col("v")), 6).alias("total"), F.round(V.l2_norm(F.col("v")), 6).alias("norm"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("id", F.transform("vec", lambda x: x * F.lit(3.0)).alias("v"))
    unit = V.l2_normalize(F.col("v"))
    return v.select("id", F.round(V.l2_norm(F.col("v")), 6).alias("norm"), F.round(V.total(unit), 6).alias("total"))


# --- sequences, labels --------------------------------------------------------


def clean_sequences(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins").select("pid", clean_sequence(F.col("sequence")).alias("seq"), is_strict(F.upper(F.regexp_replace("sequence", r"\s", ""))).alias("strict"))
    return p.select("pid", F.md5("seq").alias("seq_md5"), F.length("seq").alias("n"), length_ok(F.col("seq")).alias("usable"), "strict")


def label_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "proteins")
    return p.select("pid", superfamily_key(F.col("superfamily")).alias("superfamily"), family_key(F.col("family")).alias("family"),
                    F.substring_index("family", ".", 3).alias("prefix"), F.substring_index("family", ".", 1).alias("accession"))


def _usable(spark: SparkSession, d: str, *extra: str, with_seq: bool = True) -> DataFrame:
    return usable_proteins(table(spark, d, "proteins"), *extra, with_seq=with_seq)


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = kmers(F.col("seq"), 5)
    return _usable(spark, d).select("pid", F.size(grams).alias("n"), F.array_min(grams).alias("first"), F.array_max(grams).alias("last"))


def kmer_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Proteins that hold each 5-mer."""
    return _usable(spark, d).select(F.explode(kmers(F.col("seq"), 5)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with both special ones, cut to 256, and what is cut."""
    t = tokenize(F.col("seq"))
    return _usable(spark, d).select("pid", F.size(t).alias("n_tokens"), F.greatest(F.length("seq") + 2 - F.size(t), F.lit(0)).alias("n_cut"))


# --- MinHash ------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _usable(spark, d, "superfamily").select(F.col("pid").alias("id"), "seq", superfamily_key(F.col("superfamily")).alias("label"))


def minhash_sig(spark: SparkSession, d: str) -> DataFrame:
    sig = minhash.signatures(_texts(spark, d))
    return sig.select("id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("sig_md5"))


def _agreeing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "minhash")
    texts = scratch.write(_texts(spark, d), "texts")
    return minhash.agreement_top_k(_queries(texts), texts, scratch), texts


def minhash_topk(spark: SparkSession, d: str) -> DataFrame:
    """Signature agreement; pairs that agree nowhere are ranked too, by id."""
    return _shown(_agreeing(spark, d)[0])


def recall_minhash(spark: SparkSession, d: str) -> DataFrame:
    ranked, texts = _agreeing(spark, d)
    return _recall(ranked, texts)


def exact_jaccard(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return minhash.exact_jaccard(_queries(texts), texts).select("qid", "did", F.round("jaccard", 6).alias("jaccard"))


def kmer_index_hits(spark: SparkSession, d: str) -> DataFrame:
    """Proteins that share at least two 5-mers with a query, by way of the index."""
    scratch = Scratch(spark, "index")
    texts = _usable(spark, d).select(F.col("pid").alias("id"), "seq")
    kmer_index.build(texts, f"{scratch.root}/index")
    return kmer_index.shared_kmers(spark, f"{scratch.root}/index", _queries(texts), least=2)


def align_topk(spark: SparkSession, d: str) -> DataFrame:
    """Best local alignments of each query with all rows; no SQL, it is tested against
    the full tables of all pairs."""
    texts = Scratch(spark, "align").write(_usable(spark, d).select(F.col("pid").alias("id"), "seq"), "texts")
    return align.align_top_k(_queries(texts), texts)


# --- groups, splits, samples --------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _usable(spark, d, "superfamily", with_seq=False).select("pid", "n", superfamily_key(F.col("superfamily")).alias("label")).where("label is not null")


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_sizes(_labelled(spark, d), "label")


def group_profile(spark: SparkSession, d: str) -> DataFrame:
    return groups.profile(_labelled(spark, d), "label", "n")


def min_group_filter(spark: SparkSession, d: str) -> DataFrame:
    return groups.members_of_large_groups(_labelled(spark, d), "label", 3).select("pid", "label")


def group_split(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_groups(_labelled(spark, d), "label")


def stratified_subsample(spark: SparkSession, d: str) -> DataFrame:
    return groups.subsample(_labelled(spark, d).select("pid", "label"), "label", "pid", 300)


def stratified_subsample_3000(spark: SparkSession, d: str) -> DataFrame:
    """With the production budget, so that the fill after two of each group has room."""
    return groups.subsample(_labelled(spark, d).select("pid", "label"), "label", "pid", 3000)


def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    return groups.training_pairs(_labelled(spark, d), "label", "pid")


def sample_queries(spark: SparkSession, d: str) -> DataFrame:
    return ordering.hashed_sample(_vectors(spark, d), "id", 100, 42).select("id")


def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 rows of each family in load order, then those of usable length."""
    p = table(spark, d, "proteins").select("pid", "loaded_at", family_key(F.col("family")).alias("family"), F.length(clean_sequence(F.col("sequence"))).alias("n"))
    return ordering.first_rows(p.where("family is not null"), ["family"], [F.col("loaded_at"), F.col("pid")], 50).where("n between 20 and 512").select("pid", "family", "n")


def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Greatest token count per batch of 32 proteins in order of id."""
    numbered = ordering.number_rows(_usable(spark, d, with_seq=False).select("pid", "n"), [], F.shiftright("pid", 10), [F.col("pid")])
    return numbered.groupBy(F.expr("(rn - 1) div 32").alias("batch")).agg(F.max(F.least(F.col("n") + 2, F.lit(256))).alias("max_tokens"), F.count(F.lit(1)).alias("n_rows"))


def fk_join(spark: SparkSession, d: str) -> DataFrame:
    """Proteins with the clan of their family: the last line with one counts."""
    lines = table(spark, d, "clan_map").select("line_no", family_key(F.col("family")).alias("family"), "clan")
    p = _usable(spark, d, "family", with_seq=False).select("pid", family_key(F.col("family")).alias("family"))
    return p.join(hits.last_mapping(lines, "family", "clan", "line_no"), "family").select("pid", "family", "clan")


# --- losses, timings ----------------------------------------------------------


def infonce_loss(spark: SparkSession, d: str) -> DataFrame:
    """Even vectors against the odd ones after them, in batches of 16."""
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 32").alias("batch"), F.expr("(vec_id % 32) div 2").alias("i"), (F.col("vec_id") % 2).alias("odd"), "embedding")
    a = v.where("odd = 0").select("batch", "i", F.col("embedding").alias("anchor"))
    b = v.where("odd = 1").select("batch", "i", F.col("embedding").alias("positive"))
    return evaluate.info_nce(a.join(b, ["batch", "i"]), V.dot(F.col("anchor"), F.col("positive"))).select("batch", "n", F.round("loss", 6).alias("loss"))


def loss_ema(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return evaluate.loss_ema(e).select("epoch", "n", F.round("ema", 6).alias("ema"))


def _latency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), "event_id", F.col("value").alias("ms"))
    timed = ordering.number_rows(e, ["method"], F.shiftright("event_id", 10), [F.col("event_id")])
    return evaluate.median_after_warm_up(timed.select("method", (F.col("rn") - 1).alias("qi"), "ms"))


def latency_median(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d).select("method", "n", F.round("median_ms", 6).alias("median_ms"))


# --- outside hits -------------------------------------------------------------


def hits_rank(spark: SparkSession, d: str) -> DataFrame:
    return hits.rank_hits(table(spark, d, "hits"))


def hits_rank_all(spark: SparkSession, d: str) -> DataFrame:
    return hits.rank_hits(table(spark, d, "hits"), dedupe=False)


def _recall_hits(spark: SparkSession, d: str, dedupe: bool) -> DataFrame:
    labels = _texts(spark, d).select("id", "label")
    ranked = hits.rank_hits(table(spark, d, "hits"), dedupe=dedupe)
    return evaluate.recall_at_k(evaluate.recall_per_query(ranked, labels, labels.select("id")))


def recall_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every protein is a query, also one without hits; repeated hits count again."""
    return _recall_hits(spark, d, False)


def recall_hits_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _recall_hits(spark, d, True)


# --- reports ------------------------------------------------------------------


def _all_recalls(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, f in (("dot", recall_dot), ("cosine", recall_cosine), ("maxsim", recall_maxsim)):
        r = f(spark, d).select(F.lit(name).alias("method"), "k", "recall")
        out = r if out is None else out.unionByName(r)
    return out


def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(_all_recalls(spark, d))


def combined_summary(spark: SparkSession, d: str) -> DataFrame:
    """With the timings of one method; the others have none."""
    timed = latency_median(spark, d).where("method = 'view'").select(F.lit("dot").alias("method"), "median_ms")
    return evaluate.summary(_all_recalls(spark, d), timed)


def recall_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of a stand-in encoder, by cosine; no SQL, as the encoder has none."""
    texts = Scratch(spark, "encoded").write(_texts(spark, d), "texts")
    vecs = encode_pooled(texts, HashEncoder(), inner=True)
    return _recall(_top(Scratch(spark, "encoded").write(vecs, "vecs"), search.cosine_block), texts)


def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation with the stand-in encoder, on its full budget of test proteins,
    with the median time of a query by each method."""
    p = _texts(spark, d).select(F.col("id").alias("pid"), "seq", "label")
    return experiment(p, HashEncoder(16), Scratch(spark, "experiment"), outside_hits=table(spark, d, "hits"), timed=TIMED)


# --- files --------------------------------------------------------------------


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Usable proteins written as FASTA and read again."""
    scratch = Scratch(spark, "fasta")
    write_fasta(_usable(spark, d), f"{scratch.root}/fasta")
    return read_fasta(spark, f"{scratch.root}/fasta").select(F.col("sid").cast("long").alias("pid"), F.col("sequence").alias("seq"))


def stockholm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Usable proteins with a family, written as gapped one-line alignment blocks with a
    versioned accession and read again."""
    scratch = Scratch(spark, "stockholm")
    p = _usable(spark, d, "family").select("pid", F.regexp_replace("family", "[^!-~]", "").alias("family"), F.regexp_replace("seq", "(.{7})", "$1.-").alias("gapped"))
    block = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID   "), F.col("pid").cast("string"), F.lit(" name\n#=GF AC   "), "family", F.lit(".3\n"),
                     F.col("pid").cast("string"), F.lit("/1-9    "), F.lower("gapped"), F.lit("\n//"))
    p.where("family <> ''").select(block.alias("value")).write.text(f"{scratch.root}/blocks", compression="gzip")
    rows = read_stockholm(spark, f"{scratch.root}/blocks").where("sid is not null")
    return rows.select("family", "family_name", "sid", clean_sequence(F.col("gapped")).alias("seq"))


def clan_lines(spark: SparkSession, d: str) -> DataFrame:
    """The family-to-clan table written as a compressed file and read again; lines without
    a clan are no mapping."""
    scratch = Scratch(spark, "clans")
    cells = [F.coalesce(c, F.lit("")) for c in (F.col("family"), F.col("clan"), F.lit("x"), F.lit("y"), F.col("family_name"))]
    table(spark, d, "clan_map").select(F.concat_ws("\t", *cells).alias("value")).write.text(f"{scratch.root}/lines", compression="gzip")
    return read_clans(spark, f"{scratch.root}/lines").select("family", "clan", "family_name")


def m8_parse(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as tab-separated lines, short ones where a field is null, and read
    again; short lines are skipped."""
    scratch = Scratch(spark, "m8")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query", "target", "evalue")])
    table(spark, d, "hits").select(line.alias("value")).write.text(f"{scratch.root}/hits")
    return read_hits(spark, f"{scratch.root}/hits").select("query", "target", "evalue")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_hit_counts, p2_family_pairs, topk_dot, topk_cosine, topk_maxsim, maxsim_scores, topk_single_query, recall_dot,
        recall_cosine, recall_maxsim, meanpool, meanpool_no_special, meanpool_projected, l2_normalize, clean_sequences, label_keys, kmer_counts,
        kmer_frequencies, token_counts, minhash_sig, minhash_topk, recall_minhash, exact_jaccard, kmer_index_hits, align_topk, group_sizes, group_profile,
        min_group_filter, group_split, stratified_subsample, stratified_subsample_3000, pair_sample, sample_queries, first_n_per_group, batch_stats, fk_join,
        infonce_loss, loss_ema, latency_median, hits_rank, hits_rank_all, recall_hits, recall_hits_dedup, summary_pivot,
        combined_summary, recall_encoded, experiment_summary, fasta_roundtrip,
        stockholm_parse, clan_lines, m8_parse,
    )
}

_SF, _FAM, _CLEAN = superfamily_key_sql("superfamily"), family_key_sql("family"), clean_sequence_sql("sequence")
USABLE = f"""once as (select pid, arg_max(sequence, loaded_at) sequence, arg_max(superfamily, loaded_at) superfamily, arg_max(family, loaded_at) family from proteins where pid is not null group by pid),
  usable as (select pid, seq, length(seq) n, {_SF} superfamily, {_FAM} family from (select *, {_CLEAN} seq from once) where length(seq) between 20 and 512)"""
LABELLED = f"{USABLE}, labelled as (select pid, n, superfamily as label from usable where superfamily is not null)"
GRAMS = f"{USABLE}, grams as (select distinct pid, unnest([seq[i:i+4] for i in range(1, length(seq) - 3)]) g from usable)"


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::double[], {b}::double[])"


_UNIT = "[x / sqrt(list_inner_product(embedding::double[], embedding::double[])) for x in embedding::double[]]"
_PART = "embedding[t*16+1:t*16+16]::double[]"
TOKENS = f"""parts as (select vec_id, label, t, {_PART} v from (select vec_id, label, embedding, unnest(range(0, 1 + vec_id % 4)) t from embeddings)),
  tokens as (select vec_id, label, t, [x / greatest(sqrt(list_inner_product(v, v)), 1e-12) for x in v]::float[]::double[] v from parts)"""
_EMB = "select vec_id id, label::varchar as label from embeddings"
SCORED = {
    "dot": f"s as (select q.vec_id qid, d.vec_id did, {_dot('q.embedding', 'd.embedding')} score from embeddings q join embeddings d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)",
    "cosine": f"u as (select vec_id, {_UNIT} v from embeddings), s as (select q.vec_id qid, d.vec_id did, list_inner_product(q.v, d.v) score from u q join u d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)",
    "maxsim": f"""{TOKENS}, m as (select q.vec_id qid, d.vec_id did, q.t, max(list_inner_product(q.v, d.v)) m from tokens q join tokens d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0 group by all),
  s as (select qid, did, sum(m) score from m group by all)""",
    "minhash": f"""{USABLE}, perms(i, a, b) as (values {', '.join(f'({i}, {a}::bigint, {b}::bigint)' for i, (a, b) in enumerate(minhash.permutations()))}),
  codes as (select distinct pid, list_sum([(strpos('{RESIDUES}', seq[i + j]) - 1) * (20 ** (4 - j))::bigint for j in range(0, 5)])::bigint h from (select pid, seq, unnest(range(1, length(seq) - 3)) i from usable)),
  mins as (select pid, i, min((a * h + b) % {minhash.PRIME}) m from codes, perms group by all),
  sigs as (select pid, list(m order by i) sig from mins group by pid),
  s as (select q.pid qid, d.pid did, list_sum([(q.sig[i] = d.sig[i])::int for i in range(1, {minhash.NUM_PERM} + 1)]) / {minhash.NUM_PERM}.0::double score from sigs q join sigs d on q.pid <> d.pid where q.pid % 50 = 0)""",
}
_RANKED = "r as (select qid, did, score, rk from (select qid, did, score, row_number() over (partition by qid order by round(score, 9) desc, did) rk from s) where rk <= 100)"


def _top_sql(kind: str) -> str:
    return f"with {SCORED[kind]}, {_RANKED} select qid, did, round(score, 9) score, rk from r"


def _recall_tail(labels: str, queries: str) -> str:
    return f"""lab as (select id, label from ({labels}) where label is not null), c as (select label, count(*) - 1 rel from lab group by label),
  asked as (select l.id qid, l.label, c.rel from lab l join c using (label) where c.rel > 0 and {queries}),
  h as (select a.qid, k.k, a.rel, count(*) filter (l.label = a.label and r.rk <= k.k) hits from asked a cross join {KS_SQL} left join r on r.qid = a.qid left join lab l on l.id = r.did group by all),
  out as (select k.k::int k, round(coalesce(avg(h.hits / least(h.k, h.rel)::double), 0), 6) recall, count(h.qid) n from {KS_SQL} left join h on h.k = k.k group by k.k)"""


def _recall_sql(kind: str, labels: str = _EMB) -> str:
    return f"with {SCORED[kind]}, {_RANKED}, {_recall_tail(labels, 'l.id % 50 = 0')} select * from out"


def _hits_sql(dedupe: bool) -> str:
    once = "row_number() over (partition by query, target order by evalue nulls last, line_no)" if dedupe else "1"
    return f"""r as (select query qid, target did, evalue, row_number() over (partition by query order by evalue nulls last, line_no) rk
    from (select *, {once} o from hits where query <> target) where o = 1 qualify rk <= 100)"""


_HEX = "('0x' || substr(md5('42{salt}:' || draw), 1, 12))::bigint"
_WIDE = ", ".join(f"printf('%.4f', max(recall) filter (k = {k})) r_at_{k}" for k in (1, 5, 10, 100))


def _methods() -> str:
    return " union all ".join(f"select '{m}' as method, k, recall from ({_recall_sql(m)})" for m in ("dot", "cosine", "maxsim"))


_TIMED = """select event_type as method, count(*) n, round(median(value), 6) median_ms
  from (select event_type, value, row_number() over (partition by event_type order by event_id) - 1 qi from events) where qi >= 5 group by 1"""

ORACLE = {
    "p2_found": f"""with {LABELLED}, r as (select *, row_number() over (partition by label order by n, pid) rk, count(*) over (partition by label) c from labelled)
  select label superfamily, pid from r where rk = (c + 1) // 2""",
    "p2_hit_counts": f"with {USABLE} select superfamily, count(*) n_hits, round(sum(evalue), 3) sum_evalue from hits h join usable u on u.pid = h.target group by 1",
    "p2_family_pairs": f"with {USABLE} select b.superfamily, count(*) n_pairs, sum(a.n)::bigint sum_left, sum(b.n)::bigint sum_right from usable a join usable b on a.family = b.family group by 1",
    "topk_dot": _top_sql("dot"),
    "topk_cosine": _top_sql("cosine"),
    "topk_maxsim": _top_sql("maxsim"),
    "maxsim_scores": f"with {SCORED['maxsim']} select qid, did, round(score, 6) score from s",
    "topk_single_query": f"select d.vec_id did, round({_dot('q.embedding', 'd.embedding')}, 9) score from embeddings d, (select embedding from embeddings where vec_id = 1) q order by round({_dot('q.embedding', 'd.embedding')}, 9) desc, did limit 100",
    "recall_dot": _recall_sql("dot"),
    "recall_cosine": _recall_sql("cosine"),
    "recall_maxsim": _recall_sql("maxsim"),
    "meanpool": f"""with {TOKENS}, e as (select vec_id id, unnest(v) x, unnest(range(1, 17)) i from tokens), p as (select id, i, avg(x) x from e group by all)
  select id, round(sum(x), 6) total, round(sqrt(sum(x * x)), 6) norm from p group by id""",
    "meanpool_no_special": f"""with {TOKENS}, n as (select vec_id, max(t) last from tokens group by 1), i as (select t.* from tokens t join n using (vec_id) where t.t > 0 and t.t < n.last),
  e as (select vec_id id, unnest(v) x, unnest(range(1, 17)) i from i), p as (select id, i, avg(x) x from e group by all), u as (select id, sum(x) s, sqrt(sum(x * x)) l from p group by id)
  select n.vec_id id, round(coalesce(s / l, 0), 6) total, case when s is null then 0.0::double else 1.0::double end norm from n left join u on u.id = n.vec_id""",
    "meanpool_projected": f"""with {TOKENS}, e as (select vec_id id, unnest(v) x, unnest(range(0, 16)) i from tokens), p as (select id, i, avg(x) x from e group by all),
  y as (select id, o, sum(x * ((7 * o + 3 * i) % 13 - 6) / 13.0::double) y from p, range(8) t(o) group by all)
  select id, round(sum(y), 6) total, round(sqrt(sum(y * y)), 6) norm from y group by id""",
    "l2_normalize": "select vec_id id, round(sqrt(list_inner_product(v, v)), 6) norm, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) total from (select vec_id, [x * 3 for x in embedding::double[]] v from embeddings)",
    "clean_sequences": f"""select pid, md5(seq) seq_md5, length(seq)::int n, length(seq) between 20 and 512 usable, regexp_full_match(upper(regexp_replace(sequence, '\\s', '', 'g')), '[{RESIDUES}]+') strict
  from (select *, {_CLEAN} seq from proteins)""",
    "label_keys": f"select pid, {_SF} superfamily, {_FAM} family, array_to_string(string_split(family, '.')[1:3], '.') prefix, split_part(family, '.', 1) accession from proteins",
    "kmer_counts": f"with {GRAMS} select pid, count(*)::int n, min(g) as first, max(g) as last from grams group by pid",
    "kmer_frequencies": f"with {GRAMS} select g kmer, count(*) n from grams group by g",
    "token_counts": f"with {USABLE} select pid, least(n + 2, 256)::int n_tokens, greatest(n + 2 - 256, 0)::int n_cut from usable",
    "minhash_sig": f"with {SCORED['minhash']} select pid id, md5(array_to_string(sig, ',')) sig_md5 from sigs",
    "minhash_topk": _top_sql("minhash"),
    "recall_minhash": _recall_sql("minhash", "select pid id, superfamily as label from usable"),
    "exact_jaccard": f"""with {GRAMS}, z as (select pid, count(*) n from grams group by pid), b as (select q.pid qid, d.pid did, count(*) c from grams q join grams d on q.g = d.g and q.pid <> d.pid where q.pid % 50 = 0 group by all)
  select qid, did, round(c / (x.n + y.n - c)::double, 6) jaccard from b join z x on x.pid = qid join z y on y.pid = did""",
    "kmer_index_hits": f"with {GRAMS} select q.pid qid, d.pid did, count(*) n from grams q join grams d on q.g = d.g and q.pid <> d.pid where q.pid % 50 = 0 group by all having count(*) >= 2",
    "group_sizes": f"with {LABELLED} select label, count(*) n from labelled group by 1",
    "group_profile": f"""with {LABELLED}, g as (select count(*) n from labelled group by label)
  select (select floor(median(n))::int from labelled) median_length, (select max(n)::bigint from labelled) max_length, (select floor(median(n))::int from g) median_group, (select max(n) from g) max_group, (select count(*) from g) n_group""",
    "min_group_filter": f"with {LABELLED} select pid, label from labelled qualify count(*) over (partition by label) >= 3",
    "group_split": f"""with {LABELLED}, g as (select label from labelled group by 1 having count(*) >= 3), o as (select label, row_number() over (order by md5('42:' || label), label) rn, count(*) over () c from g)
  select label, case when rn <= greatest(1, floor(c * 0.15::double)) then 'test' else 'train' end part from o""",
    "stratified_subsample": f"""with {LABELLED}, m as (select pid, label, row_number() over (partition by label order by md5('42:' || pid), pid) r from labelled),
  b as (select greatest(0, 300 - count(*)) room from m where r <= 2), l as (select pid, label, row_number() over (order by md5('43:' || pid), pid) r2 from m where r > 2)
  select pid, label from m where r <= 2 union all select pid, label from l, b where r2 <= room""",
    "stratified_subsample_3000": f"""with {LABELLED}, m as (select pid, label, row_number() over (partition by label order by md5('42:' || pid), pid) r from labelled),
  b as (select greatest(0, 3000 - count(*)) room from m where r <= 2), l as (select pid, label, row_number() over (order by md5('43:' || pid), pid) r2 from m where r > 2)
  select pid, label from m where r <= 2 union all select pid, label from l, b where r2 <= room""",
    "pair_sample": f"""with {LABELLED}, s as (select label, count(*) n from labelled group by 1 having count(*) >= 2), g as (select *, row_number() over (order by md5('42:' || label), label) g, count(*) over () c from s),
  m as (select label, pid, row_number() over (partition by label order by md5('42:' || pid), pid) - 1 m from labelled),
  d as (select unnest(range(1, (select sum(n)::bigint from s) + 1)) draw),
  p as (select draw, label, n, {_HEX.format(salt='i')} % n i, {_HEX.format(salt='j')} % (n - 1) j from d join g on g.g = {_HEX.format(salt='g')} % c + 1)
  select draw, p.label, a.pid anchor, b.pid positive from p join m a on a.label = p.label and a.m = i join m b on b.label = p.label and b.m = (i + 1 + j) % n""",
    "sample_queries": "select vec_id id from embeddings order by md5('42:' || vec_id), vec_id limit 100",
    "first_n_per_group": f"""select pid, family, n::int n from (select pid, loaded_at, {_FAM} family, length({_CLEAN}) n from proteins) where family is not null
  qualify row_number() over (partition by family order by loaded_at, pid) <= 50 and n between 20 and 512""",
    "batch_stats": f"with {USABLE} select (rn - 1) // 32 batch, max(least(n + 2, 256))::int max_tokens, count(*) n_rows from (select n, row_number() over (order by pid) rn from usable) group by 1",
    "fk_join": f"with {USABLE}, c as (select {_FAM} family, arg_max(clan, line_no) clan from clan_map where clan <> '' group by 1) select pid, family, clan from usable join c using (family)",
    "infonce_loss": f"""with v as (select vec_id // 32 batch, (vec_id % 32) // 2 i, vec_id % 2 odd, embedding from embeddings), a as (select * from v where odd = 0), b as (select * from v where odd = 1),
  k as (select a.batch, a.i from a join b using (batch, i)),
  m as (select a.batch, a.i, b.i j, {_dot('a.embedding', 'b.embedding')} s from a join b using (batch) where (a.batch, a.i) in (select batch, i from k) and (b.batch, b.i) in (select batch, i from k)),
  r as (select batch, i, ln(sum(exp(s))) - sum(s) filter (i = j) ce from m group by all), c as (select batch, j, ln(sum(exp(s))) - sum(s) filter (i = j) ce from m group by all),
  x as (select batch, avg(ce) ce, count(*) n from r group by 1), y as (select batch, avg(ce) ce from c group by 1)
  select batch, n, round((x.ce + y.ce) / 2, 6) loss from x join y using (batch)""",
    "loss_ema": "select event_type epoch, count(*) n, round(list_reduce(list(value order by event_id), lambda r, x: 0.98::double * r + 0.02::double * x), 6) ema from events where value is not null group by 1",
    "latency_median": _TIMED,
    "hits_rank": f"with {_hits_sql(True)} select * from r",
    "hits_rank_all": f"with {_hits_sql(False)} select * from r",
    "recall_hits": f"with {USABLE}, {_hits_sql(False)}, {_recall_tail('select pid id, superfamily as label from usable', 'true')} select * from out",
    "recall_hits_dedup": f"with {USABLE}, {_hits_sql(True)}, {_recall_tail('select pid id, superfamily as label from usable', 'true')} select * from out",
    "summary_pivot": f"select method, {_WIDE} from ({_methods()}) group by method",
    "combined_summary": f"""select w.*, coalesce(printf('%.2f', t.median_ms), 'n/a') median_ms from (select method, {_WIDE} from ({_methods()}) group by method) w
  left join (select 'dot' as method, median_ms from ({_TIMED}) where method = 'view') t using (method)""",
    "stockholm_parse": f"""with {USABLE}, raw as (select pid, regexp_replace(arg_max(family, loaded_at), '[^!-~]', '', 'g') fam from proteins where pid is not null group by pid)
  select split_part(fam, '.', 1) family, pid || ' name' family_name, pid || '/1-9' sid, seq from usable join raw using (pid) where fam <> ''""",
    "clan_lines": "select family, clan, nullif(family_name, '') family_name from clan_map where family <> '' and clan <> ''",
    "m8_parse": "select query, target, evalue from hits where query is not null and target is not null and evalue is not null",
    "fasta_roundtrip": f"with {USABLE} select pid, seq from usable",
}
