"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, mixing, outliers, packing, quality, simhash, telephony, tokencount, toxicity, warc
from .common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.sound_features(telephony.stored_texts(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *outliers.STATS, "base_failed", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_token_counts, op3_telephony, op4_simhash, op5_quality_rules, op6_toxicity, op7_quality_classifier, op8_warc, op9_licences, op10_packing]
    return {f.__name__: f for f in own}


MIXING = r"""
with one as (
  select doc_id, text, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as rank from one group by source
), weighed as (
  select *, case rank % 3 when 0 then 3 when 1 then 1 else 2 end as weight from sources
), levelled as (
  select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by source_size::double / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by source_size::double / weight, rank rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed
), capped as (select *, level * weight > 2.0::double * source_size as above from levelled),
final as (
  select (1.5::double * sum(source_size) - 2.0::double * coalesce(sum(source_size) filter (above), 0)) / (sum(weight) filter (not above)) as level from capped
), targets as (
  select source, source_size, case when above then 2.0::double * source_size else weight * final.level end as target from capped, final
), rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
    ('0x' || substr(md5('20:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))), 1, 13))::ubigint / 4503599627370496.0::double as u
  from one join targets on one.source is not distinct from targets.source
)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from rated
"""

WARC = r"""
with keyed as (
  select page_id, url, sha1(coalesce(html, '')) as hex, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages
), numbered as (
  select *, count(*) over (partition by hex) as n, row_number() over (partition by hex order by page_id desc nulls last, url desc nulls last) as k,
    first_value(page_id) over (partition by hex order by page_id desc nulls last, url desc nulls last) as last_id from keyed
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (('0x' || substr(hex || '00', 1 + cast((i * 5) // 4 as integer), 3))::bigint >> (12 - 5 - cast((i * 5) % 4 as integer))) & 31 as integer), 1)), '') as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type, case when k = 1 then null else last_id end as refers_to
from numbered
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING, "op8_warc": WARC, "op9_licences": licences.oracle()}
