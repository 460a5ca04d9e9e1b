"""Queries of the operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import bpe, chat, decontaminate, hard_negatives, langid, line_dedup, mixing, ngram_join, pii, runs, sharding, topk_search, warc
from lithoframe.llm.storage import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), narrow=True)


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = langid.page_evidence(_table(spark, sf_dir, "pages"))
    return langid.identify(pages, declared="declared", host="host", suffix="suffix", key="page_id", narrow=True, labelled=_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP3_SQL = """
with l as (select doc_id, str_split(text, chr(10)) as lines from documents where text is not null),
w as (select doc_id, unnest(range(0, greatest(len(lines) - 2, 0))) as pos, lines from l),
x as (select doc_id, pos, trim(lines[pos + 1]) as a, trim(lines[pos + 2]) as b, trim(lines[pos + 3]) as c from w),
y as (select *, row_number() over (partition by a, b, c order by doc_id, pos) as nth from x where a <> '' or b <> '' or c <> ''),
gone as (select doc_id, list(distinct pos + k) as at from y, range(0, 3) t(k) where nth > 1 group by doc_id)
select d.doc_id,
       case when g.at is null then d.text
            else coalesce(list_aggregate([l.lines[i + 1] for i in range(0, len(l.lines)) if not list_contains(g.at, i)], 'string_agg', chr(10)), '') end as text,
       coalesce(len(l.lines), 0)::bigint as n_lines, coalesce(len(g.at), 0)::bigint as n_removed
from documents d left join l on d.doc_id = l.doc_id left join gone g on d.doc_id = g.doc_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents")).select("doc_id", "shard", "bytes", "shard_bytes")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digests(settled(chat.examples(_table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "lane", "block", "slot", "place")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.expr("vec_id % 100 = 0"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summaries(_table(spark, sf_dir, "documents"), rewrite=runs.planted(F.col("doc_id")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, restore=True)
    return bpe.digests(coded)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_language_id": op2_language_id,
        "language_id_pages": language_id_pages,
        "op3_line_dedup": op3_line_dedup,
        "op4_sharding": op4_sharding,
        "op5_warc": op5_warc,
        "op6_pii": op6_pii,
        "op7_chat": op7_chat,
        "op8_mixing": op8_mixing,
        "op9_exact_topk": op9_exact_topk,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_sharding": sharding.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op7_chat": chat.ORACLE_SQL, "op9_exact_topk": topk_search.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL}
