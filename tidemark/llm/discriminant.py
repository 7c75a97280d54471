"""Quality classifier: regularised quadratic discriminant over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.compression import base_counts
from tidemark.llm.labels import held_out, training_labels
from tidemark.llm.texts import arrow, per_text, saved

NAMES = (
    "words word_chars symbols upper digits marks letters wide lines dup_lines repeats distinct "
    "short_lines entropy ratio"
).split()
CLIP = 6.0


@dataclass(frozen=True)
class Shrinkage:
    """Shares of the pooled covariance and of a multiple of the identity in each class covariance.

    A class of few rows leans on the pooled covariance by d / (rows + d) at least, d being the statistics.
    """

    pooled: float = 0.05
    identity: float = 0.02


@dataclass(frozen=True)
class Classes:
    """Scaling of the statistics, and per class the mean, inverse Cholesky factor and constant of its log density."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, by Mahalanobis distances, with the prior odds."""
        if not self.means:
            return np.full(len(x), self.constants[1] - self.constants[0])
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        g = [
            c - 0.5 * np.square((z - m) @ f.T).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return g[1] - g[0]


def log_share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole + 1.0))


def statistics(texts: Sequence[bytes | None]) -> np.ndarray:
    """One row of transformed statistics per text; null counts as empty."""
    texts = [t or b"" for t in texts]
    n_words, word_chars, symbols, dup_lines, repeats = (c.astype(np.float64) for c in base_counts(texts))
    press = zstandard.ZstdCompressor(level=1).compress
    counts = np.array([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts], dtype=np.float64)
    size = counts.sum(axis=1)
    upper, lower = counts[:, 65:91].sum(axis=1), counts[:, 97:123].sum(axis=1)
    digits, wide = counts[:, 48:58].sum(axis=1), counts[:, 128:].sum(axis=1)
    white = counts[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    marks = size - upper - lower - digits - wide - white
    lines = counts[:, 10] + 1
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    distinct = np.array([len(set(t.split())) for t in texts], dtype=np.float64)
    ratio = np.array([np.log(len(t) + 1) - np.log(len(press(t))) for t in texts])
    return np.stack(
        [
            np.log1p(n_words),
            np.log((word_chars + 1) / (n_words + 1)),
            log_share(symbols, size),
            log_share(upper, size),
            log_share(digits, size),
            log_share(marks, size),
            log_share(lower, size),
            log_share(wide, size),
            np.log(lines),
            log_share(dup_lines, lines),
            log_share(repeats, n_words),
            np.log((distinct + 1) / (n_words + 1)),
            np.log((n_words + 1) / lines),
            entropy,
            ratio,
        ],
        axis=1,
    )


def measure() -> Callable:
    def make(texts: Sequence[bytes | None]) -> list[pa.Array]:
        rows = statistics(texts)
        ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return [pa.ListArray.from_arrays(ends, rows.ravel())]

    return make


def moments(rows: DataFrame) -> list:
    """Per label of (label, x): the count, sums and sums of products. Two rows of fixed size reach the driver."""
    d = len(NAMES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).collect()


def fit(found: list, shrinkage: Shrinkage = Shrinkage()) -> Classes:
    """Classes from moments. Where a label has fewer than two rows, scores are the share of label 1."""
    d = len(NAMES)
    by = {r["label"]: (r["n"], np.array(r["sums"])) for r in found}
    n = [by.get(k, (0, None))[0] for k in (0, 1)]
    prior = [float(np.log((k + 0.5) / (sum(n) + 1))) for k in n]
    if min(n) < 2:
        return Classes(np.zeros(d), np.ones(d), (), (), tuple(prior))
    means, covs = [], []
    for k in (0, 1):
        count, sums = by[k]
        second = np.zeros((d, d))
        second[np.triu_indices(d)] = sums[d:] / count
        second = second + np.triu(second, 1).T
        means.append(sums[:d] / count)
        covs.append(second - np.outer(means[k], means[k]))
    share = np.array(n) / sum(n)
    center = share[0] * means[0] + share[1] * means[1]
    within = share[0] * covs[0] + share[1] * covs[1]
    between = sum(s * np.outer(m - center, m - center) for s, m in zip(share, means, strict=True))
    scale = np.sqrt(np.maximum(np.diag(within + between), 1e-6))
    means = [(m - center) / scale for m in means]
    covs = [c / np.outer(scale, scale) for c in covs]
    pooled = share[0] * covs[0] + share[1] * covs[1]
    factors, constants = [], []
    for k in (0, 1):
        lean = max(shrinkage.pooled, d / (n[k] + d))
        cov = (1 - shrinkage.identity) * ((1 - lean) * covs[k] + lean * pooled)
        cov = cov + (shrinkage.identity * np.trace(pooled) / d + 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(prior[k] - float(np.log(np.diag(lower)).sum()))
    return Classes(center, scale, tuple(means), tuple(factors), tuple(constants))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    shrinkage: Shrinkage = Shrinkage(),
    threshold: float = 0.3,
) -> DataFrame:
    """Score of every whole text: how likely its label is 1.

    The statistics are taken once and written to the shared folder; class means and covariances are
    sums over all labelled rows that are not held out, joined by id. Null and empty texts have the
    statistics of an empty text. A null id stays null, is not held out and has no label; repeated
    rows each give a row and each count; an empty table gives none; other columns are not read.
    """
    fields = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = saved(per_text(docs, text, [id_column], fields, measure), "statistics")
    known = training_labels(labels, id_column, label)
    classes = fit(moments(rows.join(known, id_column).select("label", "x")), shrinkage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(classes.log_odds(x), -700, 700)))
            columns = [batch.columns[0], pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "score", "predicted"])

    out = T.StructType([rows.schema.fields[0]])
    out = out.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    scored = arrow(rows, score, out)
    return scored.select(f"`{id_column}`", held_out(id_column).alias("held_out"), "score", "predicted")
