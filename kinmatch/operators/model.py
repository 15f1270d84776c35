"""The two-step stack on Spark ML: pair model, meta features, second model, calibration.

Spark's vectors know no undefined values, so each feature that may be null comes with a flag.
``monotone=True`` fits a logistic model whose coefficients keep the features' signs; otherwise
boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import decide
from kinmatch.operators import features as P


def with_flags(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_null": F.col(n).isNull().cast("double") for n in names} | {f"{n}_x": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


@dataclass
class Model:
    """A fitted classifier over named features."""

    names: list[str]
    pipeline: PipelineModel

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        got = self.pipeline.transform(with_flags(df, self.names))
        return got.withColumn(out, vector_to_array("probability")[1]).select(*[c for c in df.columns if c != out], out)

    def importance(self, top: int = 20) -> list[tuple[str, float]]:
        """Shares of the features, largest first."""
        last = self.pipeline.stages[-1]
        raw = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
        k = len(self.names)
        both = raw[:k] + raw[k:]
        share = both / max(both.sum(), 1e-12)
        return sorted(zip(self.names, (100 * share).tolist()), key=lambda x: (-x[1], x[0]))[:top]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def fit(df: DataFrame, names: list[str], monotone: bool = True, iterations: int = 30, seed: int = 1) -> Model:
    """A classifier of y."""
    cols = [f"{n}_x" for n in names] + [f"{n}_null" for n in names]
    stages = [VectorAssembler(inputCols=cols, outputCol="features")]
    if monotone:
        signs = P.monotone_vector(names) + [0] * len(names)
        low = [0.0 if s > 0 else -1e3 for s in signs]
        high = [0.0 if s < 0 else 1e3 for s in signs]
        stages.append(LogisticRegression(labelCol="y", maxIter=iterations, regParam=1e-4, standardization=True, lowerBoundsOnCoefficients=DenseMatrix(1, len(cols), low), upperBoundsOnCoefficients=DenseMatrix(1, len(cols), high)))
    else:
        stages.append(GBTClassifier(labelCol="y", maxIter=iterations, maxDepth=5, stepSize=0.1, seed=seed))
    return Model(names, Pipeline(stages=stages).fit(with_flags(df.withColumn("y", F.col("y").cast("double")), names)))


def fit_isotonic(df: DataFrame, p: str = "p") -> IsotonicRegressionModel:
    """Calibrator; interpolates between its steps and clips outside."""
    return IsotonicRegression(featuresCol=p, labelCol="_y").fit(df.withColumn("_y", F.col("y").cast("double")))


def calibrate(df: DataFrame, model: IsotonicRegressionModel, p: str = "p") -> DataFrame:
    got = model.transform(df).withColumn("_c", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
    return got.drop("prediction", p).withColumnRenamed("_c", p)


@dataclass
class Stack:
    """First model, second model, calibrator."""

    first: Model
    second: Model
    calibrator: IsotonicRegressionModel

    def score(self, feats: DataFrame, write=None) -> DataFrame:
        """(features..., p): calibrated and exclusive; competition over all rows given.

        ``write`` cuts the lineage after the first model, whose scores three windows read.
        """
        first = self.first.transform(feats, "p")
        if write is not None:
            first = write(first)
        meta = decide.meta_features(first)
        second = self.second.transform(meta.drop("p"), "p")
        clip = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
        even = calibrate(second, self.calibrator).withColumn("p", clip)
        return decide.exclusivity(even, out="_e").drop("p").withColumnRenamed("_e", "p").withColumn("p", clip)


def fit_stack(feats: DataFrame, roles: DataFrame, names: list[str], monotone: bool = True, write=None) -> Stack:
    """Each part on the entities of its own role (country, s1, role).

    ``write`` cuts the lineage before each fit, whose passes else repeat every window and join.
    """
    keep = write or (lambda df: df)
    first = fit(keep(feats.join(roles, ["country", "s1"]).where("role = 'm1'")), names, monotone)
    meta = decide.meta_features(keep(first.transform(feats, "p")))
    meta = keep(meta.join(roles.where("role IN ('m2', 'cal')"), ["country", "s1"]))
    both = names + list(P.META_FEATURES)
    second = fit(meta.where("role = 'm2'").drop("p"), both, monotone)
    cal = second.transform(meta.where("role = 'cal'").drop("p"), "p")
    return Stack(first, second, fit_isotonic(keep(cal)))


def supcon_loss(vectors: np.ndarray, clusters: list, temperature: float = 0.05) -> float:
    """Supervised contrastive loss of unit vectors; singletons are negatives only."""
    n = len(vectors)
    sim = vectors @ vectors.T / temperature
    np.fill_diagonal(sim, -np.inf)
    top = sim.max(axis=1, keepdims=True)
    log_sum = top[:, 0] + np.log(np.exp(sim - top).sum(axis=1))
    losses = []
    for i in range(n):
        same = [j for j in range(n) if j != i and clusters[j] == clusters[i]]
        if same:
            losses.append(float(np.mean([log_sum[i] - sim[i, j] for j in same])))
    return float(np.mean(losses)) if losses else 0.0
