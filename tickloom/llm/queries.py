"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.compression_rules import fit_bands, score_quality
from tickloom.llm.differencing import shard_groups
from tickloom.llm.fuzzy_lines import dedup_lines
from tickloom.llm.html_blocks import extract_pages
from tickloom.llm.language_id import fit, identify
from tickloom.llm.latent_decontam import find_leaks
from tickloom.llm.ngram_join import link_near
from tickloom.llm.packing import pack_documents
from tickloom.llm.preference_format import format_preferences, swapped_replies
from tickloom.llm.secret_grammar import scan_secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "extracted.text", "extracted.n_blocks", "extracted.n_kept")


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their figures; labels fit the limits only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, bands=fit_bands(docs, table(spark, sf_dir, "labels")))
    return scored.filter("quality.reason is null").select("doc_id", "quality.n_bytes", "quality.ratio", "quality.n_chunks", "quality.bad_chunks")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language; the column ``lang`` labels the rows of the fit only."""
    docs = table(spark, sf_dir, "documents")
    scored = identify(docs.select("doc_id", "text"), fit(docs))
    return scored.select("doc_id", "language.lang", "language.score", "language.margin")


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return format_preferences(conversations, swapped_replies(conversations))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near documents and the number of documents it is near."""
    return link_near(table(spark, sf_dir, "documents"))


def op9_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text are indivisible, so that none is met in two shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    return shard_groups(docs, ["t1", "t2"], "n_bytes").select("doc_id", "n_bytes", "shard")


def op10_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = """
with last as (
  select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'assistant' group by conv_id
), sides as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as c,
    case when role = 'assistant' and turn = (select l.turn from last l where l.conv_id = v.conv_id)
      then coalesce((select o.text from last o where o.conv_id = xor(v.conv_id, 1)), '') else coalesce(text, '') end as r
  from conversations v
), placed as (
  select *, row_number() over (partition by conv_id order by turn, role, c) - 1 as i from sides
), split as (
  select conv_id, coalesce(min(i) filter (c <> r), count(*)) as k from placed group by conv_id
), parts as (
  select p.*, k, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) as cs, '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) as rs
  from placed p join split using (conv_id)
), offsets as (
  select *, sum(case when i >= k then length(cs) else 0 end) over w - length(cs) as c_at,
    sum(case when i >= k then length(rs) else 0 end) over w - length(rs) as r_at
  from parts window w as (partition by conv_id order by i)
)
select conv_id as pair_id, cast(any_value(k) as integer) as prompt_turns,
  coalesce(string_agg(cs, '' order by i) filter (i < k), '') as prompt,
  coalesce(string_agg(cs, '' order by i) filter (i >= k), '') as chosen,
  coalesce(string_agg(rs, '' order by i) filter (i >= k), '') as rejected,
  coalesce(string_agg((c_at + length(role) + 5)::bigint || ':' || (c_at + length(cs))::bigint, ';' order by i) filter (i >= k and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg((r_at + length(role) + 5)::bigint || ':' || (r_at + length(rs))::bigint, ';' order by i) filter (i >= k and role = 'assistant'), '') as rejected_mask
from offsets group by conv_id
"""

OP8_SQL = r"""
with recursive docs as (
  select row_number() over () as i, doc_id, text from (select distinct doc_id, text from documents where doc_id is not null)
), words as (
  select i, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') as w from docs where text is not null
), grams as (
  select distinct i, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g
  from words
), sizes as (
  select i, count(*) as n from grams group by i
), shared as (
  select a.i as a, b.i as b, count(*) as overlap from grams a join grams b on a.g = b.g and a.i < b.i group by 1, 2
), near as (
  select a, b from shared join sizes x on x.i = a join sizes y on y.i = b where overlap >= 0.5 * (x.n + y.n - overlap)
), edges as (
  select a, b from near union all select b, a from near
), reached as (
  select i, i as other from docs union select r.i, e.b from reached r join edges e on e.a = r.other
), classes as (
  select r.i, min(d.doc_id) as class_id from reached r join docs d on d.i = r.other group by r.i
), counts as (
  select a as i, count(*) as links from edges group by a
)
select doc_id, class_id, coalesce(links, 0) as links from docs join classes using (i) left join counts using (i)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_secret_grammar,
        op3_html_blocks,
        op4_compression_bands,
        op5_fuzzy_lines,
        op6_language_id,
        op7_preference_formatting,
        op8_ngram_join,
        op9_differencing_shards,
        op10_latent_decontam,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_preference_formatting": OP7_SQL, "op8_ngram_join": OP8_SQL}
