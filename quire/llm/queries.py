"""Queries of the subpackage and their SQL: one opN_<name> for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, fingerprint, html, packing, quality, simhash, substring, toxicity, warc
from quire.llm.shared import documents, table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir)).drop("next_fingerprint")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (toxicity.remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_substring": op8_substring,
    "op9_html": op9_html,
    "op10_warc": op10_warc,
}

_OP4_SQL = """
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
    select *, length(regexp_replace(text, '([\\[<])(\\\\*)(/?INST\\]|/?s>)', '\\1\\\\\\2\\3', 'g')) as escaped from turns
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(case when role = 'assistant' then 9 else 15 end + length(role) + escaped)::bigint as formatted_chars
from sized group by conv_id
"""

_OP8_SQL = """
with texts as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
), windows as (
    select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from texts where len(ws) >= 20)
), later as (
    select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1
), gone as (
    select distinct doc_id, unnest(range(i, i + 20)) as p from later
), words as (
    select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from texts
), kept as (
    select w.doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(word, ' ' order by w.p) filter (g.p is null) as text
    from words w left join gone g on g.doc_id = w.doc_id and g.p = w.p group by 1
)
select t.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
"""

_OP10_SQL = """
with sized as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
    select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by 1
)
select page_id, payload_bytes, s.payload_digest,
    case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end as record_type,
    case when first_id <> page_id then first_id end as refers_to
from sized s left join firsts f on s.payload_digest = f.payload_digest
"""

ORACLE_SQL: dict[str, str] = {"op4_chat": _OP4_SQL, "op8_substring": _OP8_SQL, "op10_warc": _OP10_SQL}
