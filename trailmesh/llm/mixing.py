"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, saved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank): ranks from 0 by code point, null last.

    Sources may be many, so no window spans them all: they are range-partitioned, numbered within each range,
    and ranges get their start from a running count over one row for each range.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranges = saved(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-sources")
    starts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    starts = starts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    local = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("at", local).join(starts, "range").select("source", "source_size", (F.col("at") + F.col("start")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    share * all sizes is dealt by weight; a target stops at cap * source_size and the excess is dealt again by weight
    until none is above. Each round is one aggregate of three numbers over the sources.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = saved(ranked_sources(sizes).select("source", "source_size", w.alias("weight")), "mix-weights")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
        n, sizes_capped, open_weight = t.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped:
            break
        capped = n
        if not open_weight:
            break
        level = (share * total - cap * sizes_capped) / open_weight
    above = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("source_size")
    return t.select("source", "source_size", F.when(above, cap * F.col("source_size")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed and id; a row without id is drawn by its text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """(row, size, source_size, target, copies): how often the mix takes each document.

    A source's rate is target / source_size; a document is taken floor(rate) times, and once more if its draw is
    below the fraction. row holds all of the document's columns.

    Null text: size 0. Null source: a source of its own, ranked last. Null id: drawn by the text. Repeated rows have
    equal ids and so equal draws. A source without words has target 0 and is not taken. Empty table: no rows.
    """
    one = docs.select(packed(docs).alias("row"), word_count(F.col("text")).alias("size"))
    sizes = one.groupBy(F.col("row.source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Spark broadcasts the sources where their table is below its threshold; else a hot source's side is split by AQE.
    both = one.join(targets, one["row.source"].eqNullSafe(targets["source"])).select("row", "size", "source_size", "target", rate.alias("rate"))
    extra = (draw(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return both.select("row", "size", "source_size", "target", (F.floor("rate").cast("long") + extra).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: docs' columns, each document as often as mix_plan() takes it."""
    plan = mix_plan(docs, **how).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
