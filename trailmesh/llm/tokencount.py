"""Token counts of whole texts with overlap resynchronisation for huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, by_bytes

SPACE = "▁"


class ResyncEncoder:
    """Encodes text with a sentencepiece model, huge texts by overlapping chunks.

    Two neighbouring chunks share an overlap. They are spliced at a position in it where both encodings have a token
    boundary and that is proven stable: a space after a character that isn't one. The proof is a property of the
    vocabulary, checked when the model is loaded: no piece holds a space behind another character, so no merge can
    cross such a position and what stands left of it never depends on what stands right of it. Where an overlap has
    no such position, or the encodings don't meet there, the left chunk is widened, doubling, if need be to the end.
    """

    def __init__(self, model_file: str, chunk_chars: int = 16384, overlap_chars: int = 256) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.width = np.array([1 if self.sp.is_byte(i) else 0 if self.sp.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], dtype=np.int64)
        self.widened = 0

    @staticmethod
    def wide(text: str) -> int:
        """UTF-8 length of text as the model sees it, spaces written as U+2581."""
        return len(text.encode()) + 2 * text.count(" ")

    def splice(self, text: str, lo: int, hi: int) -> int | None:
        """The stable position in text[lo:hi] nearest to the middle."""
        best, mid = None, (lo + hi) // 2
        for step, stop in ((1, hi), (-1, lo)):
            for p in range(mid, stop, step):
                if p > lo and text[p] in (" ", SPACE) and text[p - 1] not in (" ", SPACE):
                    if best is None or abs(p - mid) < abs(best - mid):
                        best = p
                    break
        return best

    def cut(self, ends: np.ndarray, text: str, start: int, p: int) -> int | None:
        """How many of a chunk's tokens stand left of position p; None if p is inside of a token. The chunk begins with the model's own space."""
        at = self.wide(text[start:p]) + 3
        n = int(np.searchsorted(ends, at))
        return n + 1 if n < len(ends) and ends[n] == at else None

    def ids(self, text: str) -> list[int]:
        if len(text) <= self.chunk or not self.stable:
            return self.sp.encode(text)
        bounds = [(s, min(len(text), s + self.chunk)) for s in range(0, len(text) - self.overlap, self.chunk - self.overlap)]
        coded = self.sp.encode([text[s:e] for s, e in bounds], num_threads=1)
        out: list[int] = []
        k, skip = 0, 0
        while k < len(bounds):
            (start, end), ids = bounds[k], coded[k]
            extra = 0
            while end < len(text):
                # the next chunk that this one, perhaps widened, overlaps
                j = k + 1
                while j + 1 < len(bounds) and bounds[j][1] <= end:
                    j += 1
                after = bounds[j][0]
                p = self.splice(text, max(after, start), end)
                if p is not None:
                    left = self.cut(np.cumsum(self.width[ids]), text, start, p)
                    right = self.cut(np.cumsum(self.width[coded[j]]), text, after, p)
                    if left is not None and right is not None:
                        break
                self.widened += 1
                extra = max(self.overlap, 2 * extra)
                end = min(len(text), end + extra)
                ids = self.sp.encode(text[start:end])
            else:
                return out + ids[skip:]
            out += ids[skip:left]
            k, skip = j, right
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in by_bytes(texts):
            short = [t for t in texts[a:b] if len(t) <= self.chunk]
            done = iter(self.sp.encode(short, num_threads=1) if short else [])
            out += [len(next(done)) if len(t) <= self.chunk else len(self.ids(t)) for t in texts[a:b]]
        return out


def count_tokens(docs: DataFrame, model_file: str | None = None, limit: int = 4096, chunk_chars: int = 16384, overlap_chars: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; no begin, end or added tokens. No shuffle.

    model_file: a sentencepiece model; None takes the public 32k model as each worker finds it.
    Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are counted like others. Empty table: no rows.
    """
    arrow_bounds(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = ResyncEncoder(model_file or public_tokenizers.path("piece_bpe_32k.model"), chunk_chars, overlap_chars)
        for b in batches:
            n = encoder.counts([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    one = docs.select("doc_id", size.alias("n_bytes"), "text")
    kind = dict(one.dtypes)["doc_id"]
    return one.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
