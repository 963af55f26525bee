"""The queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hilbert_search, jaccard_join, language_id, pii, token_counts, trie_bpe, url_filters, warc
from .vocabulary import default_vocabulary

URL_RULES = (
    url_filters.Rule("com", "/", url_filters.ALLOW),
    url_filters.Rule("example.com", "/en/", url_filters.BLOCK),
    url_filters.Rule("www.example.com", "/en/", url_filters.ALLOW),
    url_filters.Rule("net", "/es/", url_filters.BLOCK),
    url_filters.Rule("net", "/fr/", url_filters.BLOCK),
)
#: A conversation whose texts hold the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, ~language_id.held_out())
    out = language_id.identify(docs.select("doc_id", "text", language_id.held_out().alias("held_out")).select("doc_id", "held_out", "text"), model)
    return out.drop("text")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col("counts")[k].alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)], F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat_format.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_neighbours, op3_language_id, op4_jaccard, op5_warc, op6_decontaminate, op7_pii, op8_chat_format, op9_token_counts, op10_bpe)}

_HOST = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2)"
_FITS = "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '{1}')"
ORACLE = {
    "op1_url_filters": f"""
        with p as (select page_id, {_HOST} as host, {_PATH} as path from pages),
        r as (select page_id, host, path, case
          when {_FITS.format("www.example.com", "/en/")} then 'www.example.com/en/'
          when {_FITS.format("example.com", "/en/")} then 'example.com/en/'
          when {_FITS.format("net", "/es/")} then 'net/es/'
          when {_FITS.format("net", "/fr/")} then 'net/fr/'
          when {_FITS.format("com", "/")} then 'com/' end as rule from p)
        select page_id, host, path, rule,
          case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from r""",
    "op2_neighbours": """
        with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
        s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op5_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        w as (select payload_digest, max(page_id) as winner from p where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, p.payload_digest,
          case when winner is null or winner = page_id then 'response' else 'revisit' end as record_type,
          case when winner = page_id then null else winner end as refers_to
        from p left join w using (payload_digest)""",
    "op8_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, k, case k when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) t(k))
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
          cast(sum(4 + length(role) + 2 + length(text) + 8
            + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))) as bigint) as formatted_chars
        from c group by conv_id""",
}
