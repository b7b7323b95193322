"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_bounds, held_out, packed, saved
from .toxicity import training_rows

FEATURES = ["one", "length", "word_size", "symbols", "bars", "shouts", "upper", "digits", "stops", "repeats", "dup_lines"]


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text: shares of characters by kind, from one histogram of its bytes, and of repeated words and lines."""
    data = (text or "").encode()
    words = data.split()
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = max(1, len(data)), max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1, int(h[65:91].sum() + h[97:123].sum()))
    pick = lambda s: float(sum(h[c] for c in s))
    return [
        1.0, np.log1p(len(words)) / 5, min(len(data) / w / 10, 5.0),
        min(pick(b"#*$%&<>@^~_=+\\{}[]") / w, 3.0), min(pick(b"|") / w, 3.0), min(pick(b"!?") / w, 3.0),
        float(h[65:91].sum()) / letters, float(h[48:58].sum()) / n, min(pick(b".,") / w, 3.0),
        1 - len(set(words)) / w if words else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]


def train(texts: list[str | None], labels: list[int], ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on FEATURES by Newton steps, with a ridge; the classes count by the share that the sample has of them, at least 5 % each. One label only: a constant at the labels' share."""
    y = np.array(labels, dtype=float)
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.9) / (len(y) + 1)
        return np.array([np.log(share / (1 - share))] + [0.0] * (k - 1))
    x = np.array([features(t) for t in texts])
    w = np.zeros(k)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(k)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], max_chars: int) -> np.ndarray:
    """Trained on at most per_class labelled rows of classes 0 and 1 (see training_rows()); the weights are then moved to the classes' true shares among the labels that aren't held out."""
    rows = training_rows(docs, labels, "quality", per_class, max_chars)
    w = train([r.text for r in rows], [r.y for r in rows])
    bad, good = labels.filter(~held_out(F.col("doc_id"))).agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    n = [max(1, sum(r.y == k for r in rows)) for k in (0, 1)]
    if bad and good:
        w[0] += np.log(good / bad) - np.log(n[1] / n[0])
    return w


def scored(docs: DataFrame, w: np.ndarray, rest: list[Column]) -> DataFrame:
    """rest's columns and p, the classifier's probability that the text is good. No shuffle."""
    arrow_bounds(docs.sparkSession)
    one = docs.select(*rest, F.col("text").alias("_text"))
    names = one.columns[:-1]
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(len(names))]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(p, pa.float64())], names=[*names, "p"])

    return one.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", p double")


def _strength(spark: SparkSession, cells: DataFrame) -> float:
    """How many documents the prior of cells (s, q, n, prior) is worth: the within-cell variance over that between cells, by moments, from 1 to 1e6.

    s, q: sums of p and p squared. One aggregate of a few sums over all cells.
    """
    a = cells.filter("n > 0").agg(
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("free"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("prior"), 2)).alias("between"), F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    ).first()
    if not a.n or not a.free or a.cells < 2:
        return 1e6
    within = max(a.within / a.free, 1e-9)
    spread = (a.between - a.cells * within) / max(a.n - a.n2 / a.n, 1e-9)
    return float(min(1e6, max(1.0, within / spread))) if spread > 0 else 1e6


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_s, host_n, s, n, host_k, path_k, host_post, path_post) for each path of evidence (host, path, p), and the mean of all p. s, n: sums of p and counts; host_k, path_k: how many documents the priors are worth, the same in all rows.

    A host's posterior is its mean drawn towards the global one, a path's its mean drawn towards its host's, each by a
    prior worth as many documents as the cells' spread says; so sparse sites stay near their prior. Sums are combined
    before the shuffle, so a host of a third of all rows is one small row for each task. Null host or path: a value of
    its own. No evidence: no rows, mean 0.5.
    """
    spark = evidence.sparkSession
    paths = saved(evidence.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n")), "paths")
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = total[0] / total[1] if total[1] else 0.5
    hosts = saved(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).withColumn("prior", F.lit(mean)), "hosts")
    of_host = _strength(spark, hosts)
    hosts = hosts.select(F.col("host").alias("of"), F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + of_host * mean) / (F.col("n") + of_host)).alias("host_post"))
    both = saved(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of").withColumn("prior", F.col("host_post")), "sites")
    of_path = _strength(spark, both)
    path_post = ((F.col("s") + of_path * F.col("host_post")) / (F.col("n") + of_path)).alias("path_post")
    return both.select("host", "path", "host_s", "host_n", "s", "n", F.lit(of_host).alias("host_k"), F.lit(of_path).alias("path_k"), "host_post", path_post), mean


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(p / (1 - p))


def combined(rows: DataFrame, sites: DataFrame, mean: float, threshold: float, site_weight: float) -> DataFrame:
    """rows (host, path, p, ...) with host_post, path_post, score and accepted, from posteriors() of them.

    A row's own p is taken out of its site's sums, so its evidence counts once: the posteriors are those of the site's
    other documents.
    """
    own = ["host_s", "host_n", "s", "n", "host_k", "path_k"]
    sites = saved(sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), *[F.col(c).alias(f"_{c}") for c in own]), "posteriors")
    both = rows.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))).drop("_h", "_p")
    both = both.withColumn("host_post", (F.col("_host_s") - F.col("p") + F.col("_host_k") * mean) / (F.col("_host_n") - 1 + F.col("_host_k")))
    both = both.withColumn("path_post", (F.col("_s") - F.col("p") + F.col("_path_k") * F.col("host_post")) / (F.col("_n") - 1 + F.col("_path_k")))
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + site_weight * (_logit(F.col("path_post")) - _logit(F.lit(mean))))))
    return both.drop(*[f"_{c}" for c in own]).withColumn("score", score).withColumn("accepted", score >= threshold)


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, site_weight: float = 0.5, per_class: tuple[int, int] = (4000, 4000), max_chars: int = 30_000) -> DataFrame:
    """(doc_id, p, host_post, path_post, score, accepted) of each row.

    p comes from the whole text alone, by a logistic regression learnt from at most per_class labelled rows of
    classes 0 and 1. Sites' posteriors come from all other rows' p. score: p's log odds moved by site_weight times those of the path's
    posterior over the global mean. host is the source by default, path the source's language.

    Null text: that of an empty one. Null host or path: a site of its own. Repeated rows count as often as they occur.
    No labels: p is 0.9. Empty table: no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    w = fitted(docs, labels, per_class, max_chars)
    evidence = saved(scored(docs, w, [F.col("doc_id"), host.alias("host"), path.alias("path")]), "evidence")
    return combined(evidence, *posteriors(evidence.select("host", "path", "p")), threshold, site_weight).select("doc_id", "p", "host_post", "path_post", "score", "accepted")


def drop_poor(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, site_weight: float = 0.5, per_class: tuple[int, int] = (4000, 4000), max_chars: int = 30_000) -> DataFrame:
    """docs' columns, without the rows that classify() doesn't accept. Cases as there. Texts pass the classifier twice, once for the sites and once for the verdict, rather than being stored or shuffled."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    w = fitted(docs, labels, per_class, max_chars)
    sites = [host.alias("host"), path.alias("path")]
    rows = scored(docs, w, [packed(docs).alias("row"), *sites])
    return combined(rows, *posteriors(scored(docs, w, sites)), threshold, site_weight).filter("accepted").select("row.*")
