"""Principal components of soil properties."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_components(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[list[float], np.ndarray, np.ndarray]:
    """(means, components, explained-variance ratios) of centred columns; the largest loading of each component is positive.

    The covariance matrix comes from one aggregation; only that small matrix reaches the driver.
    """
    complete = df.dropna(subset=list(cols))
    row = complete.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).head()
    means = [row[f"m{i}"] or 0.0 for i in range(len(cols))]
    matrix = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts = np.array([p if p[np.abs(p).argmax()] > 0 else -p for p in parts])
    total = values.sum()
    return means, parts, values[order] / total if total > 0 else np.zeros(len(order))


def soil_pca(soil: DataFrame, cols: Sequence[str], k: int = 2, key: str = "adm") -> DataFrame:
    """(key, soil_1 .. soil_k) for every region; null where a property is."""
    means, parts, _ = principal_components(soil, cols, k)
    score = lambda p: sum(((F.col(c) - m) * float(w) for c, m, w in zip(cols, means, p)), F.lit(0.0))
    return soil.select(key, *[score(p).alias(f"soil_{i + 1}") for i, p in enumerate(parts)])


def soil_features(yields: DataFrame, soil: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """Yield rows with their region's components, each brought to mean 0 and population deviation 1 over those rows."""
    from fieldloom.operators.folds import standardize_columns

    return standardize_columns(yields.join(soil_pca(soil, cols, k), "adm", "left"), [f"soil_{i + 1}" for i in range(k)])
