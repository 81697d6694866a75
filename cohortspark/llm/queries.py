"""The queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25 import bm25_top_k
from .common import fold, held_out, table
from .divergence import audit_sources
from .embed_dedup import near_duplicates
from .langid import identify_language
from .mixing import mix_sources
from .ngram_join import similar_groups
from .private_data import BASE_KINDS, private_spans
from .sentencepiece_sample import sample_encode
from .suffix_dedup import remove_repeats
from .token_count import count_tokens
from .toxicity import score_toxicity
from .variants import spelling_variants
from .warc import warc_round_trip

# MIX_MOST is the greatest rate that the SQL can follow; the query has no bound
MIX_SEED, MIX_TEMPERATURE, MIX_MOST = 7, 2.0, 50.0


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, each as often as a Poisson draw of its source's rate says, with its copy number and key of order."""
    return mix_sources(table(spark, sf_dir, "documents"), seed=MIX_SEED, temperature=MIX_TEMPERATURE)


OP4_SQL = f"""
with counts as (select source, count(*) n from documents group by source),
shares as (select source, n, pow(n::double, 1.0 / {MIX_TEMPERATURE}) s from counts),
sums as (select sum(s) all_s, sum(n) all_n from shares),
rates as (select source, least({MIX_MOST}::double, s / all_s * all_n::double / n) rate from shares, sums),
tables as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) over (partition by source order by k) p
           from rates, (select range::double k from range(165))),
counted as (select d.*, (select count(*) from tables t where t.source is not distinct from d.source
                 and t.p <= ('0x' || substr(md5('{MIX_SEED}:' || doc_id::varchar), 1, 13))::bigint / 4503599627370496.0::double) times
            from documents d),
copies as (select counted.* exclude (times), unnest(range(1, times + 1))::integer as copy from counted where times > 0)
select *, ('0x' || substr(md5('{MIX_SEED + 1}:' || doc_id::varchar || ':' || copy::varchar), 1, 13))::bigint / 4503599627370496.0::double as mix_key
from copies
"""

def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and fetched back by key; null html is an empty payload."""
    return warc_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b)::bigint payload_bytes, sha1(b) x from p),
f as (select *, min(page_id) over (partition by x, payload_bytes) first_id from h)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::integer, 1)), '') payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from f
"""

def op1_sentencepiece_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every whole text; null texts have null ids."""
    return sample_encode(table(spark, sf_dir, "documents"))


def op9_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters of every whole text; null and empty ones have none."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op10_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a network that learned from the training folds; empty texts score 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: fold(i) != 2)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by models of the training folds; und without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, lambda i: fold(i) != 2)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by 4-word shingles at a similarity of 0.85; those without words stay alone."""
    return similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep when the bytes of repeated 200-byte strings go."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id 50 divides."""
    docs = table(spark, sf_dir, "documents")
    return bm25_top_k(docs, docs.where("doc_id % 50 = 0"), k=10)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and groups of all embeddings at a cosine of 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op11_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in the terms that ten of its documents hold, over all documents."""
    return audit_sources(table(spark, sf_dir, "documents"), least=10, top=10)


OP11_SQL = r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') body from documents),
t as (select r, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
kept as (select lang, term, count(*)::hugeint m from t group by lang, term having count(distinct r) >= 10),
langs as (select lang, count(*)::hugeint v, sum(m)::hugeint n from kept group by lang),
cells as (select t.lang, t.source, t.term, count(*)::hugeint c from t join kept using (lang, term) group by all),
sums as (select lang, source, sum(c)::hugeint n from cells group by all),
groups as (select distinct lang, source from d),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) p, 1 + (1000000000 * (k.m + 2)) // (l.n + 2 * l.v) q
      from groups g join kept k using (lang) join langs l using (lang) left join sums s using (lang, source) left join cells c using (lang, source, term)),
sides as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source item, coalesce(f, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join sides s on s.lang = a.lang and s.source = a.source and s.item = b.source),
over_q as (select lang, source, term item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where c > 0 and p > q),
both_parts as (select lang, source, 'pair' part, item, value from pairs union all select lang, source, 'term', item, value from over_q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::integer as rank from both_parts)
select * from ranked where part = 'pair' or rank <= 10
"""


def op12_find_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: how many base spans of each kind, a digest of them, and all spans."""
    found = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = lambda wanted: F.filter("private_spans", wanted)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: own(lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(own(lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), listed(F.col("private_spans")).alias("spans"))


def op13_group_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_group_spelling_variants": op13_group_spelling_variants, "op12_find_private_data": op12_find_private_data, "op11_audit_sources": op11_audit_sources, "op6_bm25_top_k": op6_bm25_top_k, "op7_embedding_near_dedup": op7_embedding_near_dedup, "op3_suffix_array_dedup": op3_suffix_array_dedup, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op8_identify_language": op8_identify_language, "op10_score_toxicity": op10_score_toxicity, "op1_sentencepiece_sample": op1_sentencepiece_sample, "op9_count_tokens": op9_count_tokens, "op5_warc_round_trip": op5_warc_round_trip, "op4_mix_sources": op4_mix_sources}
ORACLES = {"op11_audit_sources": OP11_SQL, "op5_warc_round_trip": OP5_SQL, "op4_mix_sources": OP4_SQL}
