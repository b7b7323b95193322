"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds, held_out

#: Words hold a letter or mark; numbers alone say nothing of tone.
WORDS = re.compile(r"\w*[^\W\d]\w*").findall
SIZES = (3, 4, 5)


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the character n-grams of all words, each written <word>, and of the words themselves.

    One pass of array operations for each size over the code points of all words: polynomial hashes, mixed.
    """
    text = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words), dtype=np.int32), length)
    end = np.cumsum(length)[word]
    base, mask = np.uint64(0x9E3779B97F4A7C15), np.uint64(buckets - 1)
    out_b, out_w = [], []
    rolled = np.zeros(len(points), np.uint64)
    at = np.arange(len(points))
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            step = np.zeros(len(points), np.uint64)
            step[: len(points) - n + 1] = points[n - 1 :]
            rolled = rolled * base + step + np.uint64(1)
            if n in SIZES:
                ok = at + n <= end
                h = rolled[ok]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out_b.append(((h ^ (h >> np.uint64(32))) & mask).astype(np.int32))
                out_w.append(word[ok])
        # whole words: a sum over their code points, weighted by place
        place = at - (end - length[word]) + 1
        h = np.add.reduceat((points + np.uint64(7)) * (place.astype(np.uint64) * base ^ (place.astype(np.uint64) << np.uint64(40))), end[np.cumsum(length) - 1] - length) if len(words) else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(31))) * base
        out_b.append(((h ^ (h >> np.uint64(32))) & mask).astype(np.int32))
        out_w.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(out_b), np.concatenate(out_w)


class Model:
    """s: for each bucket, what the softmax's weights make of its embedding (toxic less clean); bias likewise; focus: see train().

    A word's vector is the average of its n-grams' embeddings, so unseen spellings share those of the words that they
    resemble, and a text's vector the weighted average of its distinct words' vectors. Averages and the softmax are
    linear, so a word's part in the logit is the average of s over its n-grams, a text's logit the weighted average of
    its words' parts, and the embeddings needn't be kept for scoring. An empty text's is bias.
    """

    def __init__(self, s: np.ndarray, bias: float, focus: float, most: int = 300_000) -> None:
        self.s, self.bias, self.focus, self.most, self.known = s, bias, focus, most, {}

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            bucket, word = grams(part, len(self.s))
            own = np.bincount(word, self.s[bucket], len(part)) / np.bincount(word, minlength=len(part))
            self.known.update(zip(part, own.tolist()))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        bags = [set(WORDS((t or "").lower())) for t in texts]
        fresh = {w for b in bags for w in b if w not in self.known}
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = set().union(*bags)
        self.learn(sorted(fresh))
        get = self.known.__getitem__
        out = np.full(len(bags), self.bias)
        for i, b in enumerate(bags):
            if b:
                own = np.sort(np.fromiter(map(get, b), float, len(b)))  # sorted, so that sums don't depend on the set's order
                weight = np.exp(self.focus * (own - own[-1]))
                out[i] += weight @ own / weight.sum()
        return out


def loss(e: np.ndarray, u: np.ndarray, b: np.ndarray, bags: Bags, y: np.ndarray, weight: np.ndarray, focus: float, decay: float) -> tuple[float, list[np.ndarray]]:
    """Weighted cross-entropy of labels y, with decay times half the mean square of e's rows, and its gradients by e, u and b."""
    n = len(y)
    own = np.bincount(bags.word, (e @ u)[bags.gram], len(bags.share)) * bags.share
    s = own[bags.item]
    top = np.zeros(n)
    top[bags.full] = np.maximum.reduceat(s, bags.start[bags.full])
    pull = np.exp(focus * (s - top[bags.doc]))
    pull /= np.bincount(bags.doc, pull, n)[bags.doc]
    mean = np.bincount(bags.doc, pull * s, n)
    z = mean + b[0]
    value = float(weight @ (np.logaddexp(0, z) - y * z)) + decay * float((e * e).sum()) / (2 * len(e))
    g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
    g_own = np.bincount(bags.item, g[bags.doc] * pull * (1 + focus * (s - mean[bags.doc])), len(bags.share))
    g_gram = np.bincount(bags.gram, (g_own * bags.share)[bags.word], len(e))
    return value, [g_gram[:, None] * u + decay * e / len(e), e.T @ g_gram, np.array([g.sum()])]


@dataclass
class Bags:
    """Texts as sets of words, words as bags of n-grams. (gram, word): an n-gram of a word; share: one over a word's number of n-grams; (item, doc): a word of a text; start: each text's first item, full: texts with any."""

    gram: np.ndarray
    word: np.ndarray
    share: np.ndarray
    item: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    full: np.ndarray


def bagged(texts: list[str | None], buckets: int, min_docs: int) -> tuple[Bags, np.ndarray]:
    """Bags of texts, and the buckets that their n-grams' numbers stand for. Texts become word numbers one by one, so the driver never holds all their words as strings."""
    met: dict[str, int] = {}
    own = [np.fromiter({met.setdefault(w, len(met)) for w in WORDS((t or "").lower())}, np.int32) for t in texts]
    size = np.array([len(b) for b in own])
    vocabulary = sorted(met)
    place = np.empty(len(met), np.int32)
    place[[met[w] for w in vocabulary]] = np.arange(len(met), dtype=np.int32)
    del met
    item = np.concatenate([np.sort(place[b]) for b in own])
    del own
    start = np.concatenate([[0], np.cumsum(size)])
    bucket, word = grams(vocabulary, buckets)
    share = 1 / np.bincount(word, minlength=len(vocabulary))
    spread = np.bincount(bucket, np.bincount(item, minlength=len(vocabulary))[word], buckets)
    bucket, word = bucket[spread[bucket] >= min_docs], word[spread[bucket] >= min_docs]
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    gram = np.empty(len(bucket), np.int32)
    gram[order] = np.repeat(np.arange(len(used), dtype=np.int32), np.diff(np.append(at, len(bucket))))
    return Bags(gram, word, share, item, np.repeat(np.arange(len(size), dtype=np.int32), size), start, np.flatnonzero(np.diff(start))), used


def train(texts: list[str | None], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 120, rate: float = 0.05, decay: float = 0.3, min_docs: int = 3, focus: float = 0.5, seed: int = 6) -> Model:
    """Learns embeddings and softmax together, from labelled whole texts, by Adam on all of them at once.

    A text's vector averages its distinct words' vectors with weights exp(focus times a word's part in the logit), so
    that a few toxic words of a long text aren't lost among its others; focus 0 is the plain average.
    Buckets met fewer than min_docs times, by distinct words of each text, keep an embedding of zero: by them a text would be learnt by heart.
    Both labels count equally. Without both the model is constant, at the labels' share.
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return Model(np.zeros(2, np.float32), float(np.log(share / (1 - share))), focus)
    bags, used = bagged(texts, buckets, min_docs)
    rng = np.random.default_rng(seed)
    params = e, u, b = rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.5, dim), np.array([-3.0])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    for step in range(1, epochs + 1):
        _, grads = loss(e, u, b, bags, y, weight, focus, decay)
        for x, grad, m in zip(params, grads, moments):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.001 * (grad * grad - m[1])
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-12)
    out = np.zeros(buckets, np.float32)
    out[used] = e @ u
    return Model(out, float(b[0]), focus)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_chars: int) -> list:
    """Labelled rows (text, y) outside of held_out(): of classes 0 and 1 the per_class[0] and [1] first by hash of id, among texts of at most max_chars characters. The bound of what the driver gets."""
    spark = docs.sparkSession
    own = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    short = F.coalesce(F.length("text"), F.lit(0)) <= max_chars
    # ids alone are joined with labels and chosen; only the chosen rows' texts move, so their number bounds what is sent
    ids = docs.filter(~held_out(F.col("doc_id")) & short).select("doc_id").join(own, F.col("doc_id") == F.col("_label_id")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "y").distinct()
    chosen = [(r.doc_id, r.y) for k in (0, 1) for r in ids.filter(F.col("y") == k).orderBy("h", "doc_id").limit(per_class[k]).collect()]
    if not chosen:
        return []
    picked = spark.createDataFrame(chosen, f"_label_id {dict(docs.dtypes)['doc_id']}, y int")
    texts = docs.filter(short).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_label_id"))
    rows = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # a repeated id gives its smallest text
    return sorted(rows, key=lambda r: (r.y, r.doc_id))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: tuple[int, int] = (3000, 1500), max_chars: int = 30_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row's whole text.

    Trained on the driver on training_rows(), at most per_class rows of labels 0 and 1; nothing but texts enters a score.
    Scoring: no shuffle; the model is 0.5 MB, whatever the input. Null or empty text, or one without words: the score of the model's bias.
    Null id: held out. Repeated rows: equal scores; a label that is given twice counts once, of contradictory ones the larger. No labels or only one:
    a constant score. Empty table: no rows.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    rows = training_rows(docs, labels, "toxic", per_class, max_chars)
    model = train([r.text for r in rows], [r.y for r in rows])
    shared = spark.sparkContext.broadcast((model.s, model.bias, model.focus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            score = 1 / (1 + np.exp(-np.clip(own.logits(b.column(2).to_pylist()), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    one = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return one.mapInArrow(run, f"doc_id {dict(one.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: tuple[int, int] = (3000, 1500), max_chars: int = 30_000) -> DataFrame:
    """docs' columns, without the rows that toxicity() predicts as toxic. Cases as there. The verdict is made beside the row, so no join follows."""
    from .common import packed

    spark = docs.sparkSession
    arrow_bounds(spark)
    rows = training_rows(docs, labels, "toxic", per_class, max_chars)
    model = train([r.text for r in rows], [r.y for r in rows])
    shared = spark.sparkContext.broadcast((model.s, model.bias, model.focus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            score = 1 / (1 + np.exp(-np.clip(own.logits(b.column(1).to_pylist()), -30, 30)))
            keep = pa.array(score < threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep)], names=["row"])

    one = docs.select(packed(docs).alias("row"), "text")
    return one.mapInArrow(run, f"row {one.schema['row'].dataType.simpleString()}").select("row.*")
