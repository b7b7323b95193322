"""Quality rules: text statistics and robust multivariate outliers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, arrow_bounds, saved

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The transformed statistics, and the smallest standard deviation that is taken for each.
VECTOR = ["length", "word_size", "symbols", "dup_lines", "repeats"]
FLOOR = [0.3, 0.12, 0.04, 0.04, 0.04]


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: all 0)."""
    text = text or ""
    words = text.encode().split()  # cuts at ASCII white space only
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        count, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, dup, repeat


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_lines and STATS) of each row."""
    arrow_bounds(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(3)]
            stats = list(zip(*map(text_stats, texts))) or [()] * 5
            lines = pa.array([t.count("\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lines, *(pa.array(s, pa.int64()) for s in stats)], names=["doc_id", "lang", "source", "n_lines", *STATS])

    one = docs.select("doc_id", "lang", "source", "text")
    return one.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in one.dtypes[:3]) + ", n_lines long, " + ", ".join(f"{s} long" for s in STATS))


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 1000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, k) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def vector() -> list[Column]:
    """VECTOR from STATS: a log length, and rates that are drawn towards usual values in short texts, whose rates vary more."""
    n = F.col("n_words")
    return [
        F.log1p(n).alias("length"),
        ((F.col("word_chars") + 5.0 * 100) / (n + 100)).alias("word_size"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 100.0)).alias("symbols"),
        (F.col("n_dup_lines") / (F.col("n_lines") + 10.0)).alias("dup_lines"),
        (F.col("n_repeat_words") / (n + 20.0)).alias("repeats"),
    ]


def distance() -> Column:
    """Squared Mahalanobis distance of VECTOR from mean under inverse (row-major)."""
    p = len(VECTOR)
    diff = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    return reduce(lambda a, b: a + b, [diff[i] * diff[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p)])


def consistency(share: float, k: int) -> float:
    """Factor for the covariance of the share of normal data that is nearest to the mean."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2) if share < 1 else 1.0


def mcd(points: DataFrame, keep: float = 0.5, bins: int = 64, tolerance: float = 1e-4, reweight: float = 0.999) -> DataFrame:
    """(cell, n, mean, cov, inverse): minimum-covariance-determinant estimates of points (cell, *VECTOR) for each cell, matrices row-major, n the rows that they are from.

    Deterministic concentration steps from each statistic's shortest half: each takes the share keep of a cell's points
    that are nearest under the current estimate ((n + p + 1) / 2 points at least: with these, nearly half of a cell may be
    outliers), and estimates anew from them. A cell keeps the estimate of the smallest determinant that it has met, and
    takes part in steps until one doesn't lower the log of it by tolerance; so steps end for every cell, without a bound
    on them, at a minimum that no step betters (with one start, not always the least of all). At the end all points within the
    chi-squared quantile reweight give the estimate, as half of the points alone say little of the spread. All
    points of a cell take part in each of its steps. The cut is found on a histogram of log distances, bins to a factor of
    two, of which a cell has some hundred rows, and takes the last level whole; sums are combined before the shuffle. So
    a cell may be of any size, one row included. Covariances are made consistent for normal data and get the squares of
    FLOOR added. Empty points: no rows.
    """
    p = len(VECTOR)
    kind = dict(points.dtypes)["cell"]
    # percentile() keeps a count for each distinct value; rounded values have a bounded number of them
    fiftieths = [i / 50 for i in range(51)]
    levels = points.groupBy("cell").agg(*[F.percentile(F.round(v, 2), F.array(*map(F.lit, fiftieths))).alias(v) for v in VECTOR])
    half = lambda v: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.struct((F.get(v, i + 25) - F.get(v, i)).alias("width"), i.alias("at"))))
    levels = levels.select("cell", *VECTOR, *[half(F.col(v)).alias(f"{v}_half") for v in VECTOR])
    middle = [(F.get(v, F.col(f"{v}_half.at") + 12) + F.get(v, F.col(f"{v}_half.at") + 13)) / 2 for v in VECTOR]
    spread = [F.greatest(F.col(f"{v}_half.width") / 1.349, F.lit(f)) for v, f in zip(VECTOR, FLOOR)]
    inverse = F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    none = F.lit(None).cast("double")
    fit = saved(levels.select("cell", F.lit(0).cast("long").alias("n"), F.array(*middle).alias("mean"), F.array().cast("array<double>").alias("cov"), inverse.alias("inverse"), none.alias("log_det"), F.lit(True).alias("open")), "mcd")

    def solve(frames: Iterator) -> Iterator:
        factor = cache(lambda share: consistency(share, p))
        for f in frames:
            if len(f):
                n = f["n"].to_numpy()[:, None]
                s1, s2 = np.stack(f["s1"]) / n, np.stack(f["s2"]) / n
                cov = s2.reshape(-1, p, p) - s1[:, :, None] * s1[:, None, :]
                cov = cov * np.array([factor(x) for x in f["share"]])[:, None, None] + np.diag(np.square(FLOOR))
                yield f[["cell", "n"]].assign(mean=list(s1), cov=list(cov.reshape(-1, p * p)), inverse=list(np.linalg.inv(cov).reshape(-1, p * p)), log_det=np.linalg.slogdet(cov)[1])

    def estimate(near: DataFrame) -> DataFrame:
        """From points (cell, share, *VECTOR), which are the nearest share of their cells."""
        sums = near.groupBy("cell").agg(F.first("share").alias("share"), F.count("*").alias("n"), F.array(*[F.sum(v) for v in VECTOR]).alias("s1"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in VECTOR for b in VECTOR]).alias("s2"))
        return saved(sums.mapInPandas(solve, f"cell {kind}, n long, mean array<double>, cov array<double>, inverse array<double>, log_det double"), "mcd")

    while not fit.filter("open").isEmpty():
        level = F.floor(F.log2(F.col("d2") + 1e-9) * bins).cast("int")
        at = points.join(fit.filter("open").select("cell", "mean", "inverse"), "cell").withColumn("d2", distance()).select("cell", *VECTOR, level.alias("level"))
        hist = at.groupBy("cell", "level").agg(F.count("*").alias("n"))
        w = Window.partitionBy("cell")
        below = hist.withColumn("below", F.sum("n").over(w.orderBy("level")) - F.col("n")).withColumn("all", F.sum("n").over(w)).withColumn("upto", F.col("below") + F.col("n"))
        wanted = F.least(F.greatest(F.ceil(F.col("all") * keep), F.floor((F.col("all") + p + 1) / 2)), F.col("all"))
        last = F.max_by(F.struct("level", (F.col("upto") / F.col("all")).alias("share")), "level").alias("last")
        cut = below.filter(F.col("below") < wanted).groupBy("cell").agg(last).select("cell", F.col("last.level").alias("cut"), F.col("last.share").alias("share"))
        new = estimate(at.join(saved(cut, "mcd-cut"), "cell").filter("level <= cut"))
        better = F.col("new.log_det").isNotNull() & (F.col("old.log_det").isNull() | (F.col("new.log_det") < F.col("old.log_det")))
        far = F.col("old.log_det").isNull() | (F.col("new.log_det") < F.col("old.log_det") - tolerance)
        take = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ("n", "mean", "cov", "inverse", "log_det")]
        fit = saved(fit.alias("old").join(new.alias("new"), "cell", "left").select("cell", *take, (better & far).alias("open")), "mcd")
    near = points.join(fit.select("cell", "mean", "inverse"), "cell").filter(distance() <= chi2_quantile(reweight, p)).withColumn("share", F.lit(reweight))
    return estimate(near).select("cell", "n", "mean", "cov", "inverse")


def shrunk(own: DataFrame, above: DataFrame, strength: float) -> DataFrame:
    """own (cell, up, n, mean, cov) drawn towards above (cell, mean, cov), each to that of its up, by strength rows: n / (n + strength) is its own, the rest that of above."""
    share = F.col("o.n") / (F.col("o.n") + F.lit(float(strength)))
    both = own.alias("o").join(above.alias("a"), F.col("o.up") == F.col("a.cell")).select(F.col("o.cell").alias("cell"), "o.n", *[F.arrays_zip(F.col(f"o.{c}").alias("x"), F.col(f"a.{c}").alias("y")).alias(c) for c in ("mean", "cov")], share.alias("w"))
    mixed = [F.transform(c, lambda z: F.col("w") * z.x + (1 - F.col("w")) * z.y).alias(c) for c in ("mean", "cov")]
    return both.select("cell", "n", *mixed)


def quality_rules(docs: DataFrame, keep: float = 0.5, strength: float = 1000, cutoff: float = 1 - 1e-9) -> DataFrame:
    """(doc_id, STATS, base_failed, distance, kept).

    Base rules: under 50 words, or over half of the words repeated, fail. The others' transformed statistics are held
    against a minimum-covariance-determinant estimate of their language and source; beyond the chi-squared quantile
    cutoff they are rejected. Such estimates are made for each language and source, each language, and the table, and
    each is drawn towards the one above it by strength rows (fifty for each of the twenty numbers of an estimate); so a sparse source is mostly held against its language,
    a large one against itself, by one formula at every size, and every row past the base rules has a distance.

    Null text: no words, so base_failed. Null lang or source: values of their own. Repeated rows count as often as they occur. Empty table: no rows.
    """
    s = saved(with_stats(docs), "stats")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tag = lambda *c: F.to_json(F.array(*[F.coalesce(F.col(x), F.lit("\0null")) for x in c]))
    own, lang, everything = tag("lang", "source"), tag("lang"), F.lit("[]")
    points = saved(s.select("doc_id", *STATS, failed.alias("base_failed"), F.when(~failed, own).alias("cell"), F.when(~failed, lang).alias("lang_cell"), *vector()), "points")
    good = points.filter(~F.col("base_failed"))
    fit = mcd(good.select(F.explode(F.array("cell", "lang_cell", everything)).alias("cell"), *VECTOR), keep)
    # a cell's own weight is its number of rows, not of those that the estimate is from
    cells = good.groupBy("cell", "lang_cell").agg(F.count("*").alias("n"))
    langs = cells.groupBy("lang_cell").agg(F.sum("n").alias("n"))
    top = fit.filter("cell = '[]'")
    of = lambda counts, name, up: counts.select(F.col(name).alias("_c"), "n", up.alias("up")).join(fit.select("cell", "mean", "cov"), F.col("_c") == F.col("cell")).drop("_c")
    of_lang = shrunk(of(langs, "lang_cell", everything), top, strength)
    of_cell = saved(shrunk(of(cells, "cell", F.col("lang_cell")), of_lang, strength), "mcd-shrunk")
    p, kind = len(VECTOR), dict(of_cell.dtypes)["cell"]

    def invert(frames: Iterator) -> Iterator:
        for f in frames:
            if len(f):
                yield f[["cell", "mean"]].assign(inverse=list(np.linalg.inv(np.stack(f["cov"]).reshape(-1, p, p)).reshape(-1, p * p)))

    fit = saved(of_cell.select("cell", "mean", "cov").mapInPandas(invert, f"cell {kind}, mean array<double>, inverse array<double>"), "mcd-inverse")
    held = points.join(fit, "cell", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(cutoff, p))
    return held.select("doc_id", *STATS, "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))
