"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances are sums over all labelled training documents, made by Spark.  The
covariances are shrunk towards the pooled one and towards a multiple of the identity; the weights
are those with the least log loss on a fold that the moments didn't see.  A document's score is
the difference of the two log densities, by Mahalanobis distances with the Cholesky factors of the
classes, mapped to a probability that is calibrated on the same fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeflow.llm.stats import RATIOS, ratios, with_counts
from themeflow.operators.staging import stage

FEATURES = RATIOS
#: Share of the folds: fold 0 is held out, fold 4 chooses shrinkage and calibration.
FOLDS = 5
POOLED = (0.0, 0.2, 0.5, 0.8)
RIDGE = (0.001, 0.01, 0.1)
#: Log-density differences are clipped here before they are calibrated.
CLIP = 60.0
_STEP = 0.25


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))), F.lit(FOLDS)).cast("int")


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the transformed statistics: logs of sizes, and of ratios above a floor."""
    raw = ratios()
    transformed = {
        name: raw[name]
        if name == "log_words"
        else F.log(raw[name] + F.lit(1.0 if name in ("mean_word_chars", "words_per_line") else 0.01))
        for name in FEATURES
    }
    return with_counts(docs, text_col, id_col).select(
        id_col, *[v.alias(k) for k, v in transformed.items()]
    )


@dataclass(frozen=True)
class Qda:
    """Means, inverse Cholesky factors and log density constants of classes 0 and 1."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, priors included."""
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse_factors[k].T
            logs.append(self.constants[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return np.clip(logs[1] - logs[0], -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -CLIP, CLIP)))


@dataclass(frozen=True)
class Constant:
    """The share of label 1, where the labels aren't of both kinds."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _moments(train: DataFrame) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """(fold, label) -> number, sum, and sum of products, from one aggregation of all rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        train.groupBy("__fold", "__label")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()  # folds times labels
    )
    out = {}
    for row in rows:
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        out[row["__fold"], row["__label"]] = (
            float(row["n"]),
            np.array([row[f"s{i}"] for i in range(d)]),
            products,
        )
    return out


def _fit(moments: list[dict[int, tuple]], pooled: float, ridge: float) -> Qda | None:
    """From the moments of some folds; None without two documents of each class."""
    d = len(FEATURES)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for by_label in moments:
        for k, (count, total, products) in by_label.items():
            n[k] += count
            s[k] += total
            p[k] += products
    if n.min() < 2:
        return None
    means = s / n[:, None]
    within = [p[k] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    common = (within[0] + within[1]) / n.sum()
    scale = np.diag(common) + 1e-6
    factors, constants = [], []
    for k in (0, 1):
        shrunk = (1 - pooled) * within[k] / n[k] + pooled * common + ridge * np.diag(scale)
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Qda(means, np.array(factors), np.array(constants))


def _apply(model, rows: DataFrame, keep: list[str], name: str, method: str) -> DataFrame:
    """``keep`` and ``name``: a number of the model for each row, from Arrow batches."""
    schema = rows.select(*keep, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            values = getattr(model, method)(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(values, pa.float64())], names=[*keep, name]
            )

    return rows.select(*keep, *FEATURES).mapInArrow(run, schema)


def _differences(model: Qda, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histogram of clipped differences: values, label-0 and label-1 counts; some hundred bins."""
    found = (
        _apply(model, rows, ["__label"], "__d", "difference")
        .groupBy(F.round(F.col("__d") / _STEP).cast("int").alias("bin"))
        .agg(F.sum(1 - F.col("__label")).alias("zero"), F.sum("__label").alias("one"))
        .orderBy("bin")
        .collect()
    )
    return tuple(
        np.array([float(r[k]) * (_STEP if k == "bin" else 1.0) for r in found])
        for k in ("bin", "zero", "one")
    )


def _calibrated(values: np.ndarray, zero: np.ndarray, one: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic curve by bounded Newton steps, and its log loss.

    A ridge pulls towards slope 0.5 and offset 0, so classes that are told apart without an error
    don't drive the curve to a step.
    """

    def chance(a: float, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a * values + b, -CLIP, CLIP)))

    a, b = 0.5, 0.0
    for _ in range(200):
        p = chance(a, b)
        g = one - (zero + one) * p
        w = (zero + one) * p * (1 - p)
        h = np.array(
            [[(w * values**2).sum() + 10.0, (w * values).sum()], [(w * values).sum(), w.sum() + 1.0]]
        )
        step = np.linalg.solve(h, [(g * values).sum() - 10.0 * (a - 0.5), g.sum() - b])
        step = np.clip(step, (-0.1, -0.5), (0.1, 0.5))
        a, b = float(np.clip(a + step[0], 0.01, 2.0)), float(np.clip(b + step[1], -20.0, 20.0))
        if abs(step).max() < 1e-9:
            break
    p = np.clip(chance(a, b), 1e-12, 1 - 1e-12)
    return a, b, float(-(one * np.log(p) + zero * np.log(1 - p)).sum())


def train(
    rows: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> Qda | Constant:
    """Model from the features ``rows`` of all labelled documents that aren't held out.

    Null labels and labels of unknown documents are left out; of several labels of one document
    the smallest counts.
    """
    one = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .filter(F.col("__label").isin(0, 1))
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"))
    )
    known = stage(
        rows.join(one, rows[id_col] == one["__id"])
        .withColumn("__fold", fold(F.col("__id")))
        .filter("__fold != 0")
        .select("__fold", "__label", *FEATURES),
        "labelled-features",
    )
    moments = _moments(known)
    by_fold: dict[int, dict[int, tuple]] = {}
    for (f, label), value in moments.items():
        by_fold.setdefault(f, {})[label] = value
    seen = sum(v[0] for v in moments.values())
    prior = sum(v[0] for (_, label), v in moments.items() if label == 1) / seen if seen else 0.5
    inner = [v for f, v in by_fold.items() if f != FOLDS - 1]
    tuning = known.filter(F.col("__fold") == FOLDS - 1)
    best = None
    for pooled in POOLED:
        for ridge in RIDGE:
            model = _fit(inner, pooled, ridge)
            if model is None:
                continue
            values, zero, ones = _differences(model, tuning)
            if not zero.sum() or not ones.sum():
                continue
            slope, offset, loss = _calibrated(values, zero, ones)
            if best is None or loss < best[0]:
                best = (loss, pooled, ridge, slope, offset)
    final = _fit(list(by_fold.values()), *(best[1:3] if best else (0.5, 0.1)))
    if final is None:
        return Constant(prior)
    slope, offset = best[3:] if best else (0.5, 0.0)
    return Qda(final.means, final.inverse_factors, final.constants, slope, offset)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
) -> tuple[DataFrame, Qda | Constant]:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``, and the model.

    Inputs are statistics of the text alone; a null text is scored as an empty one.  The texts are
    read once: the features are staged.
    """
    rows = stage(features(docs, id_col, text_col), "features")
    model = train(rows, labels, id_col, label_col)
    scored = _apply(model, rows, [id_col], "score", "score")
    return (
        scored.select(
            id_col,
            (fold(F.col(id_col)) == 0).alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        ),
        model,
    )
