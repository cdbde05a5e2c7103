"""The registered query of each operator, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_tree, decontaminate, line_dedup, packing, quality_classifier, quality_rules, rans_store, sharding, simhash
from . import toxicity, url_lists, whitening

SHARDS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


@query
def op6_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.page_lines(table(spark, sf_dir, "pages"))
    return line_dedup.drop_boilerplate(lines, "host")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with a fetch day, and one dated list entry per page, both derived from the page and its number."""
    day = lambda step: F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * step) % 365).cast("int"))
    host = line_dedup.host_of(F.col("url"))
    folder = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^/?#]+)", 1)
    labels = F.split(host, r"\.")
    which, turn = F.floor(F.col("page_id") / 4) % 3, F.floor(F.col("page_id") / 12) % 3
    key = F.when(which == 0, host).when(which == 1, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.concat(host, folder))
    entries = pages.filter(F.size(labels) >= 3).select(
        F.concat(F.lit("list"), (F.col("page_id") % 4).cast("string")).alias("list"),
        F.when(F.col("page_id") % 4 == 3, "allow").otherwise("block").alias("kind"),
        key.alias("key"), F.when(turn == 0, "remove").otherwise("add").alias("action"), day(37).alias("day"),
    )
    return pages.select("page_id", "url", day(101).alias("fetched_on")), entries


@query
def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_entries(table(spark, sf_dir, "pages").select("page_id", "url"))
    found = url_lists.evaluate(captures, entries)
    return found.select("page_id", "fetched_on", "host", "n_entries", "verdict", "matched_key", "matched_list")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


PLANTED = r"\### Assistant: </turn> ok"


@query
def op13_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    columns = ["conv_id", "turn", "role", "text"]
    planted = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select(*columns).unionByName(planted)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat_tree.read_back(chat_tree.build_tree(conversations, path), path)


HOST = r"nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"

ORACLES = {
    "op6_site_line_dedup": rf"""
        with raw as (
          select page_id, {HOST} as host,
            regexp_replace(regexp_replace(regexp_replace(html,
              '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', chr(10), 'g'),
              '(?i)</?(p|div|li|ul|ol|h[1-6]|br|nav|article|section|table|tr|td|th|header|footer|title|head|body|html|aside|main)\b[^>]*>',
              chr(10), 'g'), '<[^>]*>', '', 'g') as plain
          from pages),
        texts as (
          select page_id, host, trim(regexp_replace(regexp_replace(plain, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as text
          from raw),
        lines as (select page_id, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from texts),
        counts as (select host, line, count(distinct text) as n from lines where host is not null and trim(line) <> '' group by host, line),
        sizes as (select host, count(distinct text) as total from texts where host is not null group by host),
        bad as (select c.host, c.line from counts c join sizes s on c.host = s.host where c.n >= 10 and c.n > 0.1 * s.total),
        kept as (
          select l.page_id, count(*) as n_lines, count(b.line) as n_dropped,
            coalesce(string_agg(case when b.line is null then l.line end, chr(10) order by l.pos), '') as text
          from lines l left join bad b on l.host = b.host and l.line = b.line group by l.page_id)
        select t.page_id, t.host, k.text, k.n_lines, k.n_dropped from texts t join kept k on t.page_id = k.page_id""",
    "op8_url_lists": rf"""
        with base as (
          select page_id, url, {HOST} as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) as folder,
            date '2024-01-01' + cast((page_id * 101) % 365 as integer) as fetched_on,
            date '2024-01-01' + cast((page_id * 37) % 365 as integer) as day
          from pages),
        entries as (
          select 'list' || cast(page_id % 4 as varchar) as list, case when page_id % 4 = 3 then 'allow' else 'block' end as kind,
            case (page_id // 4) % 3 when 0 then host when 1 then regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) else host || folder end as key,
            case when (page_id // 12) % 3 = 0 then 0 else 1 end as adds, day
          from base where regexp_matches(host, '^[^.]+\.[^.]+\.')),
        daily as (select list, kind, key, day, max(adds) as adds from entries group by list, kind, key, day),
        spans as (select *, lead(day) over (partition by list, kind, key order by day) as to_day from daily),
        probes as (
          select page_id, fetched_on, host as probe from base
          union select page_id, fetched_on, regexp_extract(host, '([^.]+\.[^.]+)$', 1) from base
          union select page_id, fetched_on, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) from base
          union select page_id, fetched_on, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+\.[^.]+)$', 1) from base
          union select page_id, fetched_on, host || folder from base where folder <> ''),
        met as (
          select p.page_id, s.kind, s.key, s.list,
            row_number() over (partition by p.page_id order by length(s.key) desc, s.kind, s.key, s.list) as place,
            count(*) over (partition by p.page_id) as n
          from probes p join spans s on p.probe = s.key and s.adds = 1 and s.day <= p.fetched_on and (s.to_day is null or p.fetched_on < s.to_day))
        select b.page_id, b.fetched_on, b.host, coalesce(m.n, 0) as n_entries, coalesce(m.kind, 'none') as verdict,
          m.key as matched_key, m.list as matched_list
        from base b left join met m on b.page_id = m.page_id and m.place = 1""",
}
