"""Shared pieces: scratch tables in the shared folder, Arrow batch bounds, row packing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space; bytes.split() without arguments cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\r\x0b\x0c"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where that is unset and Spark runs in one process (tests) a temporary one. A cluster without the setting raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailmesh-")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return base if re.match(r"[a-z][a-z0-9+.-]*:", base) else "file://" + base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so that sweep() can remove them."""
    return f"{shared_folder(spark)}/trailmesh-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors, gives the optimizer true sizes."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name), compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes this application's scratch tables; call it when every result that was derived from them has been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/trailmesh-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_bounds(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, by rows and by bytes: texts may be very long.

    Spark reads these settings when a plan runs, which is after the operator has returned, so they stay set in the
    session; they are the same for every operator, and a session with tighter ones keeps them.
    """
    for name, most, read in (("maxRecordsPerBatch", 2000, int), ("maxBytesPerBatch", 16 << 20, _bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        own = read(spark.conf.get(key))
        if own <= 0 or own > most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def by_bytes(texts: list[str | bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds (start, end) of runs of texts of about limit characters in total; a longer text is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row stay unseen by training: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
