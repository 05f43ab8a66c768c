"""Pixel classifiers on Spark ML: scaling, MLP, approximate RBF SVM, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.features import FEATURE_NAMES

SCALERS = ("standard", "minmax", "none")


@dataclass(frozen=True)
class MlpConfig:
    """Three hidden layers of 100 logistic units, L-BFGS, standard scaling."""

    hidden: tuple[int, ...] = (100, 100, 100)
    max_iter: int = 500
    seed: int = 2026
    scaler: str = "standard"


@dataclass(frozen=True)
class RbfSvmConfig:
    """RBF SVM settings; the kernel is approximated by ``components`` random Fourier features."""

    c: float = 1.0
    gamma: float | str = "scale"
    scaler: str = "standard"
    components: int = 256
    max_iter: int = 100
    seed: int = 2026


def scaler_table(df: DataFrame, features: Sequence[str], mode: str) -> DataFrame:
    """Shift and scale of each feature, one row; population deviation, constant columns keep scale 1."""
    if mode not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}")
    aggs = []
    for f in features:
        if mode == "standard":
            shift, scale = F.avg(f), F.stddev_pop(f)
        elif mode == "minmax":
            shift, scale = F.min(f).cast("double"), (F.max(f) - F.min(f)).cast("double")
        else:
            shift, scale = F.lit(0.0), F.lit(1.0)
        aggs += [shift.alias(f"shift_{f}"), F.when(scale > 0, scale).otherwise(1.0).alias(f"scale_{f}")]
    return df.agg(*aggs)


def fit_scaler(df: DataFrame, features: Sequence[str], mode: str) -> dict[str, tuple[float, float]]:
    """The same as plain numbers (two per feature), so applying it is a map-only expression."""
    row = scaler_table(df, features, mode).first()
    return {f: (row[f"shift_{f}"], row[f"scale_{f}"]) for f in features}


def scaled_array(scaler: dict[str, tuple[float, float]]) -> Column:
    return F.array(*[(F.col(f) - F.lit(shift)) / F.lit(scale) for f, (shift, scale) in scaler.items()])


def _fourier_lift(n_inputs: int, components: int, gamma: float, seed: int):
    """Arrow UDF for sqrt(2/D) cos(Wx + b), whose inner products approximate the RBF kernel."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (n_inputs, components))
    offset = rng.uniform(0.0, 2.0 * np.pi, components)
    norm = np.sqrt(2.0 / components)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(norm * np.cos(np.vstack(x.to_numpy()) @ weights + offset))) if len(x) else x

    return lift


def resolve_gamma(df: DataFrame, inputs: Column, n_inputs: int, gamma: float | str) -> float:
    """``scale`` is 1 / (number of features * variance of all scaled inputs)."""
    if gamma != "scale":
        return float(gamma)
    variance = df.select(F.explode(inputs).alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (n_inputs * variance) if variance else 1.0


@dataclass
class PixelModel:
    """A fitted classifier with the input transform it was fitted on."""

    name: str
    inputs: Column
    model: object
    score_column: str

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score`` (continuous, positive class) and ``prediction``; map-only."""
        out = self.model.transform(df.withColumn("_x", array_to_vector(self.inputs)))
        made = [c for c in ("_x", "rawPrediction", "probability") if c in out.columns]
        return (
            out.withColumn("score", vector_to_array(self.score_column)[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop(*made)
        )


def mlp_classifier(sample: DataFrame, config: MlpConfig | None = None, features: Sequence[str] = FEATURE_NAMES) -> PixelModel:
    cfg = config or MlpConfig()
    inputs = scaled_array(fit_scaler(sample, features, cfg.scaler))
    estimator = MultilayerPerceptronClassifier(
        layers=[len(features), *cfg.hidden, 2], solver="l-bfgs", maxIter=cfg.max_iter, seed=cfg.seed,
        featuresCol="_x", labelCol="label",
    )
    fitted = estimator.fit(sample.select(array_to_vector(inputs).alias("_x"), F.col("label").cast("double").alias("label")))
    return PixelModel("mlp", inputs, fitted, "probability")


def rbf_svm_classifier(sample: DataFrame, config: RbfSvmConfig | None = None, features: Sequence[str] = FEATURE_NAMES) -> PixelModel:
    """Approximate RBF SVM: random Fourier features under a linear hinge-loss model."""
    cfg = config or RbfSvmConfig()
    inputs = scaled_array(fit_scaler(sample, features, cfg.scaler))
    gamma = resolve_gamma(sample, inputs, len(features), cfg.gamma)
    lifted = _fourier_lift(len(features), cfg.components, gamma, cfg.seed)(inputs)
    estimator = LinearSVC(
        maxIter=cfg.max_iter, regParam=1.0 / (cfg.c * sample.count()), standardization=False, featuresCol="_x", labelCol="label"
    )
    fitted = estimator.fit(sample.select(array_to_vector(lifted).alias("_x"), F.col("label").cast("double").alias("label")))
    return PixelModel("svm", lifted, fitted, "rawPrediction")
