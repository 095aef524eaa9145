"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, shrunk towards the pooled one and towards a multiple of the
identity; a text's score comes from the difference of the classes' log densities, with Mahalanobis distances through
Cholesky factors that are computed once and sent to the executors.  The moments are sums over all labelled rows, made
where the rows are; the driver gets one row of sums from each group of tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import lean, staged, table, text_slices

STATISTICS = ("log_words", "upper", "digit", "stops", "symbol", "word_length", "variety", "pair_variety", "doubled", "top_word", "line_copies", "short", "bar", "spread")
PRIOR = 20  # words of ordinary prose that each text is taken to have besides its own, so that short texts aren't extreme
_SYMBOL = re.compile(r"[!#$%&*|<>{}\[\]\\^~=@+]+")


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text; all are finite for any text, the empty one included."""
    words = text.split()
    low = text.lower()
    n = len(words)
    m = n + PRIOR
    letters = sum(map(len, words))
    count = Counter(low.split())
    pairs = len(set(zip(words, words[1:], strict=False)))
    doubled = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.float64, n)
    root = math.sqrt
    return [
        math.log(n + 2 * PRIOR),
        root(sum(map(str.isupper, words)) / m),
        root(sum(map(low.count, "0123456789")) / (letters + 6 * PRIOR)),
        root((low.count(".") + low.count(",") + 0.1 * PRIOR) / m),
        math.log(1e-3 + sum(map(len, _SYMBOL.findall(low))) / (letters + 6 * PRIOR)),
        math.log((letters + 5 * PRIOR) / m),
        math.log((len(count) + PRIOR) / m),
        math.log((pairs + PRIOR) / m),
        math.log(1e-2 + doubled / m),
        math.log(0.05 + (max(count.values()) if count else 0) / m),
        math.log(1e-2 + (len(lines) - len(set(lines))) / (len(lines) + 2)),
        root((float((sizes <= 3).sum()) + 0.35 * PRIOR) / m),
        math.log(1e-3 + low.count("|") / m),
        math.log(((float(((sizes - 5) ** 2).sum()) + 9 * PRIOR) / m)),
    ]


class Discriminant:
    """Two Gaussian classes with shrunk covariances, from class sums (n, sum of x, sum of x xT)."""

    def __init__(self, sums: list[tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.05, ridge: float = 0.02):
        dims = len(sums[0][1])
        prior_var = np.ones(dims)
        means, covs, n = [], [], []
        for size, s, ss in sums:
            mean = s / size if size else np.zeros(dims)
            means.append(mean)
            covs.append(ss / size - np.outer(mean, mean) if size else np.diag(prior_var))
            n.append(size)
        total = sum(n) or 1.0
        both = sum((k * c for k, c in zip(n, covs, strict=True)), np.zeros((dims, dims))) / total if sum(n) else np.diag(prior_var)
        scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
        self.scale = scale
        self.means = [m / scale for m in means]
        self.factors, self.logs = [], []
        for k, c in zip(n, covs, strict=True):
            own = (1 - pooled) * c + pooled * both
            own = own / np.outer(scale, scale)
            own = (1 - ridge) * own + ridge * max(1e-3, np.trace(own) / dims) * np.eye(dims)
            factor = np.linalg.cholesky(own)
            self.factors.append(factor)
            self.logs.append(-np.log(np.diag(factor)).sum() + math.log((k + 1.0) / (total + 2.0)))
        # Statistics aren't quite Gaussian: densities far out count for less.
        self.temper = dims / 4

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score of class 1, between 0 and 1, for each row of statistics."""
        z = x / self.scale
        log = []
        for mean, factor, base in zip(self.means, self.factors, self.logs, strict=True):
            away = np.linalg.solve(factor, (z - mean).T)
            log.append(base - 0.5 * (away**2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temper, -30, 30)))


def _measure(at: int, kept: int, names: list[str]):
    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, at, 4 << 20):
                x = [statistics(t or "") for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(x, pa.list_(pa.float64()))], names=names)

    return lean(run)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "x") -> DataFrame:
    """``doc_id``, or the columns ``keep``, and ``name``: the statistics of each row's text; null texts are empty ones."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col) if keep is None else docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    kept = 1 if keep is None else len(keep)
    at = d.columns.index(text_col) if keep else 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:kept])
    return d.mapInArrow(_measure(at, kept, [*d.columns[:kept], name]), f"{fields}, `{name}` array<double>")


def _rows_of(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def _moments(batches):
    dims = len(STATISTICS)
    sums = {0: [0.0, np.zeros(dims), np.zeros((dims, dims))], 1: [0.0, np.zeros(dims), np.zeros((dims, dims))]}
    for batch in batches:
        x, y = _rows_of(batch.column(0)), batch.column(1).to_numpy()
        for k, s in sums.items():
            own = x[y == k]
            s[0] += len(own)
            s[1] += own.sum(axis=0)
            s[2] += own.T @ own
    flat = [[float(s[0]), *s[1].tolist(), *s[2].ravel().tolist()] for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array(flat, pa.list_(pa.float64()))], names=["label", "sums"])


def fit(measured: DataFrame, label_col: str = "label") -> Discriminant:
    """Fit on all rows of statistics ``x`` whose label is 0 or 1.  Without any such row every score is one half."""
    rows = measured.select("x", F.col(label_col).cast("long").alias("label")).filter("label in (0, 1)")
    parts = rows.mapInArrow(_moments, "label long, sums array<double>")
    width = 1 + len(STATISTICS) + len(STATISTICS) ** 2
    summed = parts.groupBy("label").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()  # two rows
    d = len(STATISTICS)
    got = {r.label: np.array(r.sums) for r in summed}
    zero = np.zeros(width)
    return Discriminant([(float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for v in (got.get(0, zero), got.get(1, zero))])


def _score_measured(held):
    def run(batches):
        model = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_rows_of(batch.column(1))))], names=["doc_id", "score"])

    return run


def score_measured(measured: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` from statistics."""
    return measured.select("doc_id", "x").mapInArrow(_score_measured(measured.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def score_column(model: Discriminant):
    """A function of a column of statistics that gives the score; other columns of its rows don't pass through Python."""

    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros(0))

    return F.pandas_udf(scores, "double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label: str, in_training: Column) -> DataFrame:
    """``(doc_id, label)`` in the training folds: one row for each id, with the larger label; null ids and labels train nothing."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("long").alias("label")).filter("label in (0, 1)").filter(in_training)
    return y.groupBy("doc_id").agg(F.max("label").alias("label"))


def fit_quality(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of ``labels.quality``, from all folds but that with crc32(doc_id) mod 3 = 1; statistics alone are moved, not texts."""
    return fit(measured.join(training_labels(labels, "quality", fold(F.col("doc_id"), 3) != 1), "doc_id"))


def op4_quality_qda(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; repeated rows are scored alike, null texts as empty ones, null ids are not held out."""
    measured = staged(measure(table(spark, sf_dir, "documents")), "statistics")
    out = score_measured(measured, fit_quality(measured, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
