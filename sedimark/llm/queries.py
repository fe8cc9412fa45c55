"""The queries op1 to op10, each over its whole table, and DuckDB statements where SQL can say
the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import chat, fingerprint, html_main, language, lm, media, mixing, packing, quality, simhash
from sedimark.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.sql(
        f"select bigint(-7) conv_id, bigint(c1) turn, c2 role, '{probe}' text "
        "from values (0, 'user'), (1, 'assistant') as t(c1, c2)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chat(rows.unionByName(added)))


def op2_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_versions(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weigh_and_sample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables have no pictures; they are rendered from the vectors of embeddings."""
    return media.find_edited(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).drop("text")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_document_fingerprint": op2_document_fingerprint,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_lm_score": op6_lm_score,
    "op7_media_copies": op7_media_copies,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_html_main_text": op10_html_main_text,
}
#: The windows once more in SQL: prefix sums of tokens, slots, history and system turns.
_CONTROL = (
    r"[<\[]\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>>|(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>"
    r"|/?(?:INST|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS|SYSTEM_PROMPT)\])"
)
_OP1 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), t0 as (
  select *, ceil(strlen(text) / 4.0)::bigint + 4 as n, row_number() over w as idx,
    length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) + 23 as chars
  from c window w as (partition by conv_id order by turn, role, text)
), t1 as (
  select *, sum(n) over w as upto, first(case when idx = 1 and role = 'system' then n else 0 end) over w as sys
  from t0 window w as (partition by conv_id order by idx rows unbounded preceding)
), t2 as (select *, upto - n as before, greatest(floor(greatest(768 - sys, 256) / 2), 1) as width from t1
), t as (select *, floor(before / width) as slot, (n > width)::int as alone from t2
), h as (select conv_id, slot, alone, min(before) as start, min(idx) as first_turn from t group by all
), shown as (
  select conv_id, slot, alone, chars from t
  union all
  select h.conv_id, h.slot, h.alone, t.chars from h join t on t.conv_id = h.conv_id and t.upto <= h.start
    and h.start - t.before <= 256 and t.n <= 256 and not (t.idx = 1 and t.role = 'system')
  union all
  select h.conv_id, h.slot, h.alone, t.chars from h join t on t.conv_id = h.conv_id and t.idx = 1
    and t.role = 'system' and h.first_turn > 1
), f as (select conv_id, sum(chars)::bigint as formatted_chars from shown group by 1
), w as (select conv_id, count(*) as n_windows from h group by 1
), a as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by idx)) as turns_sha256,
    coalesce(string_agg(text, '' order by idx) filter (where role = 'assistant'), '') as loss
  from t group by 1
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_windows
from a join f using (conv_id) join w using (conv_id)
"""
ORACLE_SQL: dict[str, str] = {"op1_chat_format": _OP1}
