"""Best-fit packing of token pieces into sequences under several capacities."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bounds, saved

#: Where the vocabulary splits a text, for characters that re and the library take for the same kind.
SPLITS = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+").findall


def byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe(dict):
    """The ids that tokenizers gives for a byte-level vocabulary (a .json of it), special strings in a text taken as special.

    Merges never cross the vocabulary's splits of a text, so the library's model is asked once for each split and its
    ids are kept, as little-endian unsigned 32-bit numbers: about the `most` last met, and as many before them. Splits are found by SPLITS; a
    text with a character that the library's own splitter takes for another kind is encoded whole by the library.
    """

    def __init__(self, file: str, most: int = 200_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(file)
        self.model, self.letters, self.most, self.longest = self.library.model, byte_letters(), most, longest
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {k: i.to_bytes(4, "little") for k, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda text: [text]
        self.same: dict[str, bool] = {}
        self.numbers = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values(), default=-1) + 1)]
        self.before: dict[str, bytes] = {}

    def __missing__(self, split: str) -> bytes:
        ids = self.before.get(split)
        if ids is None:
            plain = split.isascii() and split.isprintable()  # of these characters only the space is written as another
            written = split.replace(" ", self.letters[32]) if plain else split.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.numbers[t.id] for t in self.model.tokenize(written)])
        if len(split) <= self.longest:
            self[split] = ids
        return ids

    def splits_alike(self, char: str) -> bool:
        text = f"a{char}b 1{char}2 .{char}. "
        return SPLITS(text) == [text[lo:hi] for _, (lo, hi) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of text."""
        chars = set(text)
        for c in chars:
            if c not in self.same:
                self.same[c] = self.splits_alike(c)
        if not all(map(self.same.__getitem__, chars)):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        return b"".join(self.special[part] if part in self.special else b"".join(map(self.__getitem__, SPLITS(part))) for part in self.cut(text))


@cache
def shared_bpe(file: str) -> ByteBpe:
    """One for each Python worker, whose tasks come one after another."""
    return ByteBpe(file)


def cut(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, a shorter one first."""
    first = n if n <= most else n % most or most
    yield 0, first
    for start in range(first, n, most):
        yield start, most


def token_pieces(docs: DataFrame, max_tokens: int = 1024, end_id: int = 2, keep_ids: bool = False, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): documents as pieces of at most max_tokens ids.

    Each document is its text's ids and end_id; only longer ones are cut. task and nth number the pieces of a length:
    nth counts within the task that made them. ids: little-endian unsigned 32-bit. tokenizer: a byte-level vocabulary's .json, at the same place on every machine; byte_bpe_50k.json if None.
    """
    arrow_bounds(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        bpe = shared_bpe(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        task, seen, end = TaskContext.get().partitionId(), [0] * (max_tokens + 1), end_id.to_bytes(4, "little")
        for b in batches:
            index, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = bpe.ids(text or "") + end
                for k, (start, length) in enumerate(cut(len(data) // 4, max_tokens)):
                    own = data[4 * start : 4 * (start + length)]
                    index.append(i)
                    rows.append((k, start, length, zlib.crc32(own), task, seen[length], own))
                    seen[length] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [b.column(0).take(pa.array(index, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    one = docs.select("doc_id", "text")
    return one.mapInArrow(run, f"doc_id {dict(one.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids)


@dataclass
class Slot:
    """Pieces of one length, of ranks lo to hi, lie in sequences from base on, per of them in each, from offset on."""

    length: int
    lo: int
    hi: int
    base: int
    per: int
    offset: int


def best_fit(counts: dict[int, int], max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[list[Slot], int]:
    """Best-fit decreasing of counts[length] pieces: where each goes, and how many sequences.

    Every sequence has three residual capacities: tokens, documents and attention cost (the sum of squared lengths).
    A piece goes to the sequence that has room in all three and whose residual vector, as shares of the capacities, is
    best: rule "norm" takes the smallest weighted norm of what remains, "dot" the largest weighted product of the piece
    and what is left. Sequences in the same state are handled together, so the work depends on the number of lengths
    and states, not on that of the pieces.
    """
    caps = (max_tokens, max_docs, max_attention)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    slots: list[Slot] = []
    total = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if length > max_tokens or length * length > max_attention or max_docs < 1:
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")

        def room(used: tuple[int, int, int], length: int = length) -> int:
            return min((caps[0] - used[0]) // length, caps[1] - used[1], (caps[2] - used[2]) // (length * length))

        def score(used: tuple[int, int, int], length: int = length) -> tuple[float, tuple[int, int, int]]:
            item = (length, 1, length * length)
            rest = [(c - u - (x if rule == "norm" else 0)) / c for c, u, x in zip(caps, used, item)]
            value = sum(w * r * r for w, r in zip(weights, rest)) if rule == "norm" else -sum(w * r * x / c for w, r, x, c in zip(weights, rest, item, caps))
            return value, used

        fits = sorted((s for s in states if room(s) > 0), key=score)
        while left:
            if fits:
                used = fits[0]
                base, n = states[used].pop()
                if not states[used]:
                    del states[used]
                    fits.pop(0)
            else:
                used, base, n = (0, 0, 0), total, -(-left // room((0, 0, 0)))
                total += n
            per = room(used)
            for m, k in ((min(n, left // per), per), (1, left % per if left < n * per else 0)):
                if m and k:
                    slots.append(Slot(length, rank, rank + m * k, base, k, used[0]))
                    states.setdefault((used[0] + k * length, used[1] + k, used[2] + k * length * length), []).append((base, m))
                    rank, left, base, n = rank + m * k, left - m * k, base + m, n - m
            if n:
                states.setdefault(used, []).append((base, n))
    return slots, total


def pack(pieces: DataFrame, max_tokens: int = 1024, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """pieces with sequence_id and offset, without task and nth.

    Pieces of a length are ranked: the driver's plan (bounded by max_tokens, whatever the number of pieces) says for
    ranges of ranks which sequences take them. Ranks are nth plus a running count over tasks for each length.
    """
    spark = pieces.sparkSession
    pieces = saved(pieces, "pack-pieces")
    held = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    held = saved(held.withColumn("start_rank", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "pack-ranks")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    slots, _ = best_fit(counts, max_tokens, max_tokens if max_docs is None else max_docs, max_tokens**2 if max_attention is None else max_attention, weights, rule)
    plan = spark.createDataFrame([(s.length, s.lo, s.hi, s.base, s.per, s.offset) for s in slots], "length long, lo long, hi long, base long, per long, at long")
    ranked = pieces.join(held.select("task", "length", "start_rank"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("start_rank"))
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(plan["length"])
    turn = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor(turn / F.col("per")).cast("long")).withColumn("offset", F.col("at") + turn % F.col("per") * F.col("length"))
    return placed.select(*[c for c in pieces.columns if c not in ("task", "nth")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, max_tokens: int = 1024, keep_ids: bool = False, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): documents packed into sequences.

    how: max_docs, max_attention, weights and rule of pack(). The default capacities of documents (max_tokens) and attention
    (its square) are what max_tokens tokens can need at most, so tokens alone bind; the other two residuals still weigh in the choice of a sequence.

    Null text: empty, so one piece with end_id alone. Null ids and repeated rows are packed like others, each row for
    itself. Empty table: no rows. Other columns are not carried.
    """
    return pack(token_pieces(docs, max_tokens, keep_ids=keep_ids), max_tokens, **how)
