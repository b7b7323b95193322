"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, saved

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"
BLOCK = "name string, task int, nth int, begin long, bytes long, records long"
WRITTEN = "shard string, temporary string, records long, bytes long, sha256 string, blocks array<long>"
MANIFEST = "shard string, records long, bytes long, sha256 string, blocks array<long>"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _urn(*parts: object) -> str:
    """A record id that depends on what it names alone."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(json.dumps(parts).encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers: tuple[int | None, str | None] | None) -> bytes:
    """A WARC record, headers and digests made anew. refers: page_id and url of the response that a revisit refers to; a revisit leaves out the payload but not its length."""
    http = LINE.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + 2 * LINE
    block = http if refers else http + payload
    clean = lambda u: "".join(c for c in u or "" if c not in "\r\n")
    head = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", _urn(page_id, url, sha1_hex, bool(refers))),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", "sha1:" + _b32(sha1_hex)),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(*refers, sha1_hex, False)), ("WARC-Refers-To-Target-URI", clean(refers[1])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", "" if refers[0] is None else str(refers[0]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + LINE + block + 2 * LINE


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """rows as a batch of a schema that Spark reads too."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_pylist([dict(zip((n for n, _ in fields), r)) for r in rows], schema=pa.schema(fields))


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _placed(lows: list[int], values: list[int]):
    """A column function of page_id: the value of the last of lows that is at most it, null below all and for null. One binary search; its table is as long as lows."""

    @F.arrow_udf("long")
    def find(ids: pa.Array) -> pa.Array:
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(np.array(lows), x, "right") - 1
        return pa.array(np.array(values)[at], pa.int64(), mask=(at < 0) | ids.is_null().to_numpy(zero_copy_only=False))

    return find(F.col("page_id"))


def id_ranges(sizes: DataFrame, target: int, most: int = 100_000) -> tuple[int, list[tuple[int, int, int]]]:
    """(null parts, [(lo, hi, parts)]): ranges lo to hi, both included, of page_id of about target bytes each, in order, that depend on the table alone; and in how many parts the rows without an id are to be dealt.

    sizes: (page_id, size). target is raised where it would make over most ranges. Bytes are summed over equal slices
    of the ids; a slice above target is sliced again, until it is one id, which is then dealt to parts by digest. The
    driver holds a few slices for each range, so at most some hundred thousand numbers.
    """
    lo, hi, total, null = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("size"), F.sum(F.when(F.col("page_id").isNull(), F.col("size")))).first()
    target = max(target, -(-(total or 0) // most))
    null_parts = max(1, -(-(null or 0) // target))
    if lo is None:
        return null_parts, []
    leaves, todo = [], [(lo, hi, total or 0)]
    while todo:
        slices = []
        for a, b, n in sorted(todo):
            step = max(1, -(-(b - a + 1) // (8 * -(-n // target) + 8)))
            slices += [(x, min(b, x + step - 1)) for x in range(a, b + 1, step)]
        ends = dict(slices)
        # what lies between the ranges still to be sliced falls to the slice before it, and is filtered by its end
        place = sizes.select(_placed([a for a, _ in slices], [a for a, _ in slices]).alias("a"), _placed([a for a, _ in slices], [b for _, b in slices]).alias("b"), "page_id", "size")
        found = place.filter("page_id <= b").groupBy("a").agg(F.sum("size").alias("n")).collect()
        todo = []
        for r in found:
            if r.n > target and ends[r.a] > r.a:
                todo.append((r.a, ends[r.a], r.n))
            else:
                leaves.append((r.a, ends[r.a], r.n))
    out: list[tuple[int, int, int]] = []
    held = 0
    for a, b, n in sorted(leaves):
        if out and out[-1][2] == 1 and held + n <= target:
            out[-1], held = (out[-1][0], b, 1), held + n
        else:
            out.append((a, b, max(1, -(-n // target) if b == a else 1)))
            held = n
    return null_parts, out


def dealt_pages(pages: DataFrame, task_bytes: int) -> DataFrame:
    """(page_id, url, sha1, html, last, task), range-sorted: in partition task, ordered by page_id, url and sha1. last: the (page_id, url) of the response, where a payload occurs more than once."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(html.cast("binary")).alias("sha1"), html.alias("html"))
    last = F.max(F.struct(F.col("page_id"), F.col("url")))
    twice = keyed.groupBy("sha1").agg(F.count("*").alias("n"), last.alias("last")).filter("n > 1")
    twice = saved(twice.select(F.col("sha1").alias("_sha1"), "last"), "warc-repeats")
    null_parts, ranges = id_ranges(keyed.select("page_id", F.octet_length("html").cast("long").alias("size")), task_bytes)
    joined = keyed.join(twice, keyed["sha1"] == twice["_sha1"], "left").drop("_sha1")
    part = F.xxhash64("sha1", "url")
    first, at = [], null_parts
    for _, _, parts in ranges:
        first.append(at)
        at += parts
    task: Column = F.pmod(part, F.lit(null_parts))
    if ranges:
        lows, parts = [lo for lo, _, _ in ranges], [p for _, _, p in ranges]
        task = F.when(F.col("page_id").isNull(), task).otherwise(_placed(lows, first) + F.pmod(part, _placed(lows, parts)))
    dealt = joined.withColumn("task", task.cast("int")).repartitionById(at, F.col("task"))
    return dealt.sortWithinPartitions("task", "page_id", "url", "sha1").select("page_id", "url", "sha1", "html", "last", "task")


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, task_bytes: int = 32 << 20, block_bytes: int = 1 << 20, level: int = 1) -> DataFrame:
    """Writes pages (page_id, url, html) as gzipped WARC shards to folder, a URI that all executors reach, and returns the manifest (shard, records, bytes, sha256, blocks).

    Records are sorted by page_id, url and digest; null ids come first, dealt to tasks by digest. Tasks get ranges of
    ids of about task_bytes of html, which depend on the table alone, and write their compressed records to one file
    each, cut into blocks of whole records of about block_bytes. Blocks in their order, over all tasks, are then rolled
    into shards by compressed size: a shard ends with the block that brings it to shard_bytes, so only the last one is
    smaller, however the ranges fell. blocks: where each block of a shard begins, so a reader can share a shard out.

    Each file is written under a name of its attempt's own, and only those of the tasks that succeeded are used or
    renamed; the manifest is written last, so a folder with one is whole, and what lies in _temporary is removed
    after it. Equal tables make equal files.

    Of equal payloads that with the largest (page_id, url) is the response, others are revisits of it; of rows equal in
    all three the first. Null html: an empty payload. Null url: an empty header. Empty table: no shards.
    """
    spark = pages.sparkSession
    arrow_bounds(spark)
    base = folder.rstrip("/")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = _opened(base)
        files.create_dir(f"{path}/_temporary", recursive=True)
        name, out, before = f"_temporary/part-{TaskContext.get().partitionId():06d}.{uuid.uuid4().hex}", None, None
        rows: list[tuple] = []
        size = begun = records = 0
        for b in batches:
            for page_id, url, sha1, text, last_row, task in zip(*[b.column(i).to_pylist() for i in range(6)]):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                key, refers = (page_id, url, sha1), None
                if last_row is not None:
                    target = (last_row["page_id"], last_row["url"])
                    refers = target if target != (page_id, url) or key == before else None
                before = key
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, text.encode(), sha1, refers)) + packer.flush()
                out.write(data)
                size, records = size + len(data), records + 1
                if size - begun >= block_bytes:
                    rows.append((name, task, len(rows), begun, size - begun, records))
                    begun, records = size, 0
        if records:
            rows.append((name, task, len(rows), begun, size - begun, records))
        if out is not None:
            out.close()
        yield _rows(rows, BLOCK)

    parts = saved(dealt_pages(pages, task_bytes).mapInArrow(compress, BLOCK), "warc-parts")
    # running sizes: the tasks' sums, of which there are at most as many as ranges, and within each task its blocks
    of_task = parts.groupBy("task").agg(F.sum("bytes").alias("sum"))
    of_task = of_task.select("task", (F.sum("sum").over(Window.orderBy("task")) - F.col("sum")).alias("base"))
    start = F.col("base") + F.sum("bytes").over(Window.partitionBy("task").orderBy("nth")) - F.col("bytes")
    rolled = saved(parts.join(of_task, "task").withColumn("start", start).withColumn("shard", F.floor(F.col("start") / F.lit(shard_bytes))), "warc-rolled")
    shards = rolled.agg(F.countDistinct("shard")).first()[0]
    order = rolled.select("shard", "task", "nth", "name", "begin", "bytes", "records")
    order = order.repartition(max(1, min(shards, 20_000)), F.col("shard")).sortWithinPartitions("shard", "task", "nth")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(base)
        attempt, state, rows = uuid.uuid4().hex, None, []

        def close() -> None:
            state["out"].close()
            rows.append((state["name"], state["temporary"], state["records"], state["bytes"], state["hash"].hexdigest(), state["blocks"]))

        for b in batches:
            for r in b.to_pylist():
                if state is None or r["shard"] != state["shard"]:
                    if state is not None:
                        close()
                    name = f"shard-{r['shard']:08d}.warc.gz"
                    temporary = f"_temporary/{name}.{attempt}"
                    state = {"shard": r["shard"], "name": name, "temporary": temporary, "records": 0, "bytes": 0, "hash": hashlib.sha256(), "blocks": [], "out": files.open_output_stream(f"{path}/{temporary}", compression=None)}
                with files.open_input_file(f"{path}/{r['name']}") as part:
                    data = part.read_at(r["bytes"], r["begin"])  # a block: block_bytes and at most one record more
                if len(data) != r["bytes"]:
                    raise OSError(f"{r['name']} isn't whole")
                state["out"].write(data)
                state["hash"].update(data)
                state["blocks"].append(state["bytes"])
                state["bytes"] += len(data)
                state["records"] += r["records"]
        if state is not None:
            close()
        yield _rows(rows, WRITTEN)

    written = saved(order.mapInArrow(join, WRITTEN), "warc-written")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(base)
        for b in batches:
            for r in b.to_pylist():
                old, new = f"{path}/{r['temporary']}", f"{path}/{r['shard']}"
                if files.get_file_info(old).is_file:  # else an earlier attempt has renamed it
                    files.move(old, new)
                if files.get_file_info(new).size != r["bytes"]:
                    raise OSError(f"{new} isn't whole")
            yield b.select(["shard", "records", "bytes", "sha256", "blocks"])

    written.mapInArrow(publish, MANIFEST).write.parquet(f"{base}/_manifest")
    left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")


def parse(stream) -> Iterator[dict]:
    """The records of a gzipped WARC file, one at a time, digests checked."""
    with gzip.GzipFile(fileobj=stream, mode="rb") as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while (line := f.readline()) not in (LINE, b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            f.read(4)
            if head["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                raise ValueError(f"block of {head['WARC-Record-ID']} is damaged")
            http, _, payload = block.partition(2 * LINE)
            length = next(int(x.split(b":")[1]) for x in http.split(LINE) if x.lower().startswith(b"content-length:"))
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
            number = lambda k, head=head: int(head[k]) if head.get(k) else None
            yield {"page_id": number("X-Page-Id"), "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None}


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True, most_tasks: int = 20_000) -> DataFrame:
    """The records of a folder that write_warc() made: READ's columns, payload null in revisits, and left out if not payloads. Tasks share out the shards' blocks. A file that isn't whole raises. Empty manifest: no rows."""
    names = [x.split()[0] for x in READ.split(", ")][: None if payloads else -1]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in READ.split(", ")) if n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder.rstrip("/"))
        for b in batches:
            for span in b.to_pylist():
                rows, size = [], 0
                with files.open_input_file(f"{path}/{span['shard']}") as f:
                    data = f.read_at(span["end"] - span["begin"], span["begin"])
                if len(data) != span["end"] - span["begin"]:
                    raise OSError(f"{span['shard']} isn't whole")
                for r in parse(io.BytesIO(data)):
                    size += r["payload_bytes"]
                    rows.append({n: r[n] for n in names})
                    if len(rows) >= 2000 or payloads and size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ends = F.transform("blocks", lambda b, i: F.struct(b.alias("begin"), F.coalesce(F.get("blocks", i + 1), F.col("bytes")).alias("end")))
    spans = manifest.select("shard", F.explode(ends).alias("span")).select("shard", "span.begin", "span.end")
    # a number of partitions that is given isn't coalesced by adaptive execution, which would read these few bytes of names in one task
    tasks = max(1, min(-(-(manifest.agg(F.sum(F.size("blocks"))).first()[0] or 0) // 8), most_tasks))
    spread = spans.repartition(tasks, "shard", "begin")
    return spread.mapInArrow(read, ", ".join(x for x in READ.split(", ") if x.split()[0] in names))
