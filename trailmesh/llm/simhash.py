"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, packed, saved
from .components import components

#: Rows of the bits of 0 to 255, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a whole text as a signed 64-bit number, 0 for a text without words."""
    import xxhash

    w = (text or "").encode().lower().split()  # lowers A-Z only, cuts at ASCII white space only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    bits = np.concatenate([np.bincount(column, minlength=256) @ BYTE_BITS for column in h.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], words: int = 3) -> DataFrame:
    """keep's columns of docs with fp, the fingerprint of text as a signed long."""
    arrow_bounds(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), fp], names=[*keep, "fp"])

    one = docs.select(*keep, F.col("text").alias("_text"))
    kinds = dict(one.dtypes)
    return one.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bit(name: str) -> Column:
    """A long with the bit set that column name tells, none for a negative number."""
    return F.expr(f"case when {name} < 0 then 0L else shiftleft(1L, {name}) end")


def with_neighbours(fps: DataFrame) -> DataFrame:
    """Of the distinct fingerprints fps (fp), those that may have another one within 3 bits; none that has one is left out.

    Cut into three blocks, two fingerprints within 3 bits agree to within 2 bits on the two blocks without their most
    different one. Each fingerprint sends, for each choice of two blocks, all variants within half of that, 1 bit;
    both of a pair meet on some variant. What meets nobody has no neighbour.
    """
    # block k is bits 21 k + 1 (0 for the first) to 21 k + 21; keys of different choices that happen to be equal only make company that proves nothing
    block = lambda i: F.greatest(F.floor((i - 1) / 21), F.lit(0))
    bits = F.array(*[F.lit(_signed(sum(1 << i for i in range(64) if not lo <= i < hi))) for lo, hi in ((0, 22), (22, 43), (43, 64))])
    one = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("fp", "k", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    one = one.filter((F.col("i") < 0) | (block(F.col("i")) != F.col("k")))
    sent = one.select("fp", F.col("fp").bitwiseAND(F.get(bits, F.col("k"))).bitwiseXOR(_bit("i")).alias("v"))
    w = Window.partitionBy("v")
    met = sent.select("fp", (F.min("fp").over(w) != F.max("fp").over(w)).alias("met"))
    return met.filter("met").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of at most 3 differing bits that connect exactly what all such pairs would.

    Every fingerprint that may have a neighbour sends all its variants within half the radius, 2 bits (half of 3,
    rounded up), and they meet on equal variants. Where one of a variant's senders is within 1 bit of it, all its
    senders, being within 2, are within 3 of that one: each gets an edge to the smallest such one, and no pairs are
    made. Where none is within 1 bit the senders prove nothing. A pair at 3 bits or fewer meets at a variant that is
    within 1 bit of one and 2 of the other, so it is connected there. The edges are verified all the same.
    """
    # bits i > j, where -1 stands for none: 1 + 64 + 2016 variants
    one = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")).select("fp", "i", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("i") - 1, F.lit(-1)))).alias("j"))
    sent = one.select("fp", F.col("fp").bitwiseXOR(_bit("i")).bitwiseXOR(_bit("j")).alias("v"), (F.col("j") < 0).alias("near"))
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("v"))
    edges = sent.select(F.col("fp").alias("a"), hub.alias("b")).filter("b is not null and a <> b").distinct()
    return edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)


def classes(prints: DataFrame) -> DataFrame:
    """(fp, doc_id, root) rows of the distinct fingerprints of prints (doc_id, fp) that aren't alone in their component: doc_id the smallest of the component."""
    own = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    near = saved(with_neighbours(own.select("fp")), "near")
    root = saved(components(links(near)), "roots")
    of = own.join(root, own["fp"] == root["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return of.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, root, component_id): each row's fingerprint and the smallest doc_id that links of at most 3 bits reach.

    Equal fingerprints are one node, whatever their number. Null or wordless text: fingerprint 0, linked like any
    other. Null ids: such rows belong to their component but never name it; component_id is null where all of its ids
    are. Repeated rows share a component. Empty table: no rows. root: the component's smallest fingerprint.

    Balls of 2,081 variants are sent only by fingerprints that with_neighbours() leaves, which itself sends the
    variants within half the radius on two of three blocks: it drops none that has another one within the radius.
    """
    prints = saved(fingerprints(docs, ["doc_id"], words), "prints")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs' columns, one row of each component: that with the smallest doc_id, of rows of that id one with the smallest hash of its text, of equal rows one.

    A component whose ids are all null keeps one of its rows likewise. Null texts: as near_duplicates(). Rows that share
    id and text but not other columns: the first by all columns in their order (by their JSON if one holds a map) stays.
    Fingerprints are computed once; texts are shuffled once, on id and text hash, to meet the rows that stay.
    """
    key = [F.when(F.col("doc_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string"))).alias("_id"), F.xxhash64("text").alias("_hash")]
    prints = saved(fingerprints(docs.select(*key, "doc_id", "text"), ["_id", "_hash", "doc_id"], words), "prints")
    of = prints.join(classes(prints), "fp")
    stays = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_id")).alias("s")).select("s._id", "s._hash")
    rows = docs.select(*key, packed(docs).alias("row")).join(saved(stays, "stays"), ["_id", "_hash"])
    order = F.to_json("row") if "map<" in docs.schema.simpleString() else F.col("row")  # rows with maps can't be ordered
    turn = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(order))
    return rows.withColumn("turn", turn).filter("turn = 1").select("row.*")
