"""Models fitted in every fold, and features that come from outside."""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.gram import gram_sums, unpacked
from fieldloom.functions.lineage import cut_lineage
from fieldloom.functions.numeric import gp_predict, lasso_weights
from fieldloom.operators.trees import split_key, tree_fits


def log_uniform_grid(ranges: Mapping[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """``n`` seeded draws of parameters, uniform in their logarithms."""
    rng = np.random.default_rng(seed)
    return [{k: float(np.exp(rng.uniform(np.log(a), np.log(b)))) for k, (a, b) in ranges.items()} for _ in range(n)]


def _gp(params: Mapping[str, float], x: np.ndarray, t: np.ndarray, y: np.ndarray, x_new: np.ndarray, t_new: np.ndarray) -> np.ndarray:
    """Predictions of a Gaussian process; columns are scaled by the training rows."""
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 0, s, 1.0)
    span = (t.max() - t.min()) or 1.0
    one = lambda v: np.c_[(v - m) / s, np.ones(len(v))]
    return gp_predict(one(x), (t - t.mean()) / span, y, one(x_new), (t_new - t.mean()) / span, params["sigma"], params["l_s"], params["l_t"], params["noise"])


@dataclass
class Sums:
    """What rows (x, y) add up to, enough to fit a linear model on them and to score one."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(*(getattr(self, f) + getattr(other, f) for f in ("n", "x", "y", "xx", "xy", "yy")))

    def of(self, columns: Sequence[int]) -> "Sums":
        return Sums(self.n, self.x[columns], self.y, self.xx[np.ix_(columns, columns)], self.xy[columns], self.yy)

    def fit(self, model: str, alpha: float) -> tuple[np.ndarray, float]:
        """(weights, intercept) of a ridge or lasso on columns scaled by these rows' mean and population deviation."""
        mean_x, mean_y = self.x / self.n, self.y / self.n
        cov = self.xx / self.n - np.outer(mean_x, mean_x)
        spread = np.diag(cov)
        spread = np.sqrt(np.where(spread > 1e-12 * np.diag(self.xx) / self.n, spread, 0.0))
        s = np.where(spread > 0, spread, 1.0)
        gram = np.where(np.outer(spread, spread) > 0, cov / np.outer(s, s), 0.0)
        cross = np.where(spread > 0, (self.xy / self.n - mean_x * mean_y) / s, 0.0)
        w = lasso_weights(gram, cross, alpha) if model == "lasso" else np.linalg.solve(gram + alpha * np.eye(len(gram)), cross)
        return w / s, float(mean_y - (w / s) @ mean_x)

    def error(self, w: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear model on these rows."""
        squares = self.yy + self.n * intercept**2 + w @ self.xx @ w + 2 * (intercept * (w @ self.x) - intercept * self.y - w @ self.xy)
        return float(max(squares, 0.0) / self.n)


def inner_folds(years: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Fold of each row: distinct years in a seeded order dealt to ``n`` folds, or one each."""
    distinct = sorted(set(years.tolist()), key=lambda v: (zlib.crc32(f"{seed}:{v}".encode()), v))
    place = {v: i % n if len(distinct) > n else i for i, v in enumerate(distinct)}
    return np.array([place[v] for v in years.tolist()])


def fold_model(
    df: DataFrame,
    split: str,
    features: Sequence[str],
    y: str = "yield",
    model: str = "ridge",
    grid: Sequence[Mapping[str, float]] = ({"alpha": 1.0},),
    n_folds: int = 5,
    upper: float = 0.5,
    selection: DataFrame | None = None,
    keep: Sequence[str] = ("harv_year",),
    benchmark: str = "y_bench",
    seed: int = 42,
) -> DataFrame:
    """(split, year_out, adm, harv_year, y_pred, train_mse, n_trials): predictions of every held-out year of every split.

    In each fold all parameter sets are scored by their mean squared error over inner folds of the training years; one whose
    error passes ``upper`` in any inner fold is pruned. The best is refitted on all training years; if none is left the benchmark
    column is the prediction. ``selection`` (split, year_out, features array) names each fold's features; ``keep`` always stays.

    ``ridge`` and ``lasso`` need sums of products by split and year only, from one aggregation; a task fits all folds of a split from
    these, and predictions are made where the rows are. ``rf`` and ``gbt`` are grown from sums over bins, for all folds at once, and no
    split is gathered (see ``trees``). ``gp`` brings each fold's rows into one task: splits must be small.
    """
    if model not in ("ridge", "lasso", "gp", "rf", "gbt"):
        raise ValueError(f"unknown model {model}")
    if model in ("rf", "gbt"):
        return tree_models(df, split, features, y, model, grid, n_folds, upper, selection, keep, benchmark, seed)[0]
    rows, chosen, wanted, columns = _fold_rows(df, split, features, y, selection, keep, benchmark)
    params = [dict(g) for g in grid]
    fits = _linear_fits if model != "gp" else _gp_fits
    return fits(rows, chosen, wanted, len(columns), model, params, n_folds, upper, seed)


def _fold_rows(df: DataFrame, split: str, features: Sequence[str], y: str, selection: DataFrame | None, keep: Sequence[str], benchmark: str) -> tuple[DataFrame, DataFrame | None, Column, list[str]]:
    """Rows (split, adm, harv_year, y, bench, x) without nulls, places of selected columns by fold, those of the kept ones, and the columns' names."""
    columns = [*dict.fromkeys([*keep, *features])]
    x = [F.col(c).cast("double") for c in columns]
    rows = df.select(F.col(split).alias("split"), "adm", F.col("harv_year").cast("int").alias("harv_year"), F.col(y).cast("double").alias("y"), F.col(benchmark).cast("double").alias("bench"), F.array(*x).alias("x"))
    rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    wanted = F.array(*[F.lit(columns.index(c)) for c in keep]).cast("array<int>")
    if selection is None:
        return rows, None, wanted, columns
    place = F.create_map(*[v for i, c in enumerate(columns) for v in (F.lit(c), F.lit(i))])
    chosen = selection.select(F.col("split").alias("of"), F.col("year_out").cast("int").alias("year_out"), F.transform("features", lambda c: place[c]).alias("chosen"))
    return rows, chosen, wanted, columns


def tree_models(
    df: DataFrame,
    split: str,
    features: Sequence[str],
    y: str = "yield",
    model: str = "rf",
    grid: Sequence[Mapping[str, float]] = ({},),
    n_folds: int = 5,
    upper: float = 0.5,
    selection: DataFrame | None = None,
    keep: Sequence[str] = ("harv_year",),
    benchmark: str = "y_bench",
    seed: int = 42,
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Predictions as of ``fold_model``, and the importances (split, year_out, feature, importance) of each fold's refitted model.

    ``rf`` takes trees, depth, min_leaf and share (of the features, offered to a node), ``gbt`` trees, depth, min_leaf and rate. An importance
    is a feature's part of the fold's gains in squared error; folds whose parameters were all pruned have none. ``cuts`` gives every
    column's cut points, quantiles of the split if it is not given. Rows without a split form a split.
    """
    rows, chosen, wanted, columns = _fold_rows(df, split, features, y, selection, keep, benchmark)
    rows = cut_lineage(rows.where(F.col("harv_year").isNotNull()))  # read for counts, blocks, quantiles and folds
    folds = _columns_of(rows.select("split", F.col("harv_year").alias("year_out")).distinct(), chosen, wanted, len(columns))
    known = folds.select(split_key(F.col("split")).alias("of"), "split").distinct()
    folds = folds.select(split_key(F.col("split")).alias("of"), "year_out", "names")
    edges = None if cuts is None else [cuts[c] for c in columns]
    keyed = rows.select(split_key(F.col("split")).alias("of"), "adm", "harv_year", "y", "bench", "x")
    found, gains = tree_fits(keyed, folds, len(columns), model, grid, n_folds, upper, seed, edges)
    predictions = found.join(known, "of").select("split", "year_out", "adm", "harv_year", "y_pred", "train_mse", F.lit(len(grid)).alias("n_trials"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return predictions, gains.join(known, "of").select("split", "year_out", name.alias("feature"), F.col("gain").alias("importance"))


def _columns_of(folds: DataFrame, chosen: DataFrame | None, wanted: Column, size: int) -> DataFrame:
    """Folds (split, year_out, ...) with the places ``names`` of their columns; a fold that nothing was selected for has the kept ones."""
    if chosen is None:
        return folds.withColumn("names", F.sequence(F.lit(0), F.lit(size - 1)))
    found = folds.join(chosen.withColumnRenamed("of", "split"), ["split", "year_out"], "left")
    return found.withColumn("names", F.array_distinct(F.concat(wanted, F.coalesce("chosen", F.array().cast("array<int>"))))).drop("chosen")


def _best(params: Sequence[Mapping[str, float]], errors) -> tuple[Mapping[str, float] | None, float]:
    """The parameters with the least mean of ``errors(parameters)``, None if all were pruned (None)."""
    best, least = None, np.inf
    for p in params:
        found = errors(p)
        if found and np.mean(found) < least:
            best, least = p, float(np.mean(found))
    return best, least


def _linear_fits(rows: DataFrame, chosen: DataFrame | None, wanted: Column, size: int, model: str, params: list, n_folds: int, upper: float, seed: int) -> DataFrame:
    centre = rows.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(size)]).alias("x"), F.avg("y").alias("y")).head()
    middle, middle_y = [float(v or 0.0) for v in centre.x], float(centre.y or 0.0)
    near = rows.withColumn("c", F.array(*[F.col("x")[i] - middle[i] for i in range(size)])).withColumn("d", F.col("y") - middle_y)
    near = near.select("split", F.col("harv_year").alias("year_out"), F.concat(F.array(F.lit(1.0)), "c", F.array("d")).alias("z"))
    packed = gram_sums(near, ["split", "year_out"], "z", size + 2)
    packed = _columns_of(packed, chosen, wanted, size)

    def unpack(v: np.ndarray) -> Sums:
        m = unpacked(v, size + 2)
        return Sums(m[0, 0], m[0, 1:-1], m[0, -1], m[1:-1, 1:-1], m[1:-1, -1], m[-1, -1])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("year_out", kind="stable")
        years = part["year_out"].to_numpy()
        of_year = [unpack(np.asarray(v, float)) for v in part["v"]]
        out = []
        for held, names in zip(years.tolist(), part["names"]):
            names = [int(i) for i in names]
            train = [(year, s.of(names)) for year, s in zip(years.tolist(), of_year) if year != held]
            best, error, weights, intercept = None, np.inf, np.zeros(size), 0.0
            if sum(s.n for _, s in train) > 1 and names:
                place = dict(zip([year for year, _ in train], inner_folds(np.array([year for year, _ in train]), n_folds, seed).tolist()))

                def errors(p: Mapping[str, float]) -> list[float] | None:
                    found = []
                    for fold in sorted(set(place.values())):
                        inside, outside = ([s for year, s in train if (place[year] == fold) == own] for own in (True, False))
                        if not outside:
                            continue
                        found.append(reduce(Sums.__add__, inside).error(*reduce(Sums.__add__, outside).fit(model, p["alpha"])))
                        if found[-1] > upper:
                            return None
                    return found

                best, error = _best(params, errors)
                if best is not None:
                    w, intercept = reduce(Sums.__add__, [s for _, s in train]).fit(model, best["alpha"])
                    weights[names] = w
            out.append((part["split"].iloc[0], held, None if best is None else weights.tolist(), float(intercept - weights @ np.array(middle) + middle_y), None if best is None else error))
        return pd.DataFrame(out, columns=["split", "year_out", "w", "w0", "train_mse"])

    fits = packed.groupBy("split").applyInPandas(solve, f"split {dict(rows.dtypes)['split']}, year_out int, w array<double>, w0 double, train_mse double")
    dot = F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.col("w0"), lambda s, v: s + v)
    found = rows.join(fits, (rows["harv_year"] == fits["year_out"]) & rows["split"].eqNullSafe(fits["split"])).drop(fits["split"])
    return found.select("split", "year_out", "adm", "harv_year", F.when(F.col("w").isNull(), F.col("bench")).otherwise(dot).alias("y_pred"), "train_mse", F.lit(len(params)).alias("n_trials"))


def _gp_fits(rows: DataFrame, chosen: DataFrame | None, wanted: Column, size: int, model: str, params: list, n_folds: int, upper: float, seed: int) -> DataFrame:
    folds = _columns_of(rows.select("split", F.col("harv_year").alias("year_out")).distinct(), chosen, wanted, size)
    schema = f"split {dict(rows.dtypes)['split']}, year_out int, adm string, harv_year int, y_pred double, train_mse double, n_trials int"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["harv_year", "adm"], kind="stable")
        years, held, names = part["harv_year"].to_numpy(), part["year_out"].iloc[0], [int(i) for i in part["names"].iloc[0]]
        x, y, t = np.stack(part["x"].to_numpy())[:, names].astype(float), part["y"].to_numpy(float), years.astype(float)
        test, train = np.flatnonzero(years == held), np.flatnonzero(years != held)
        best, error = None, np.inf
        if len(train) > 1:
            place = inner_folds(years[train], n_folds, seed)

            def errors(p: Mapping[str, float]) -> list[float] | None:
                found = []
                for fold in range(place.max() + 1):
                    a, b = train[place != fold], train[place == fold]
                    if not len(a) or not len(b):
                        continue
                    found.append(float(np.mean((_gp(p, x[a], t[a], y[a], x[b], t[b]) - y[b]) ** 2)))
                    if found[-1] > upper:
                        return None
                return found

            best, error = _best(params, errors)
        predicted = part["bench"].to_numpy(float)[test] if best is None else _gp(best, x[train], t[train], y[train], x[test], t[test])
        return pd.DataFrame({"split": part["split"].iloc[0], "year_out": held, "adm": part["adm"].to_numpy()[test], "harv_year": years[test], "y_pred": predicted, "train_mse": None if best is None else error, "n_trials": len(params)})

    return rows.join(folds, "split").groupBy("split", "year_out").applyInPandas(run, schema)


def distributed_model(df: DataFrame, features: Sequence[str], y: str, model: str = "rf", seed: int = 42, **params) -> tuple[Model, VectorAssembler]:
    """One large split's model, trained by Spark: ``rf``, ``gbt`` or ``lasso``."""
    kinds = {"rf": RandomForestRegressor, "gbt": GBTRegressor}
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")
    if model == "lasso":
        estimator = LinearRegression(featuresCol="__features", labelCol=y, elasticNetParam=1.0, **params)
    else:
        estimator = kinds[model](featuresCol="__features", labelCol=y, seed=seed, **params)
    return estimator.fit(assembler.transform(df)), assembler


def held_out_years(df: DataFrame, years: Sequence[int] | None) -> list[int]:
    """The given years, or all of ``df``: a short list of folds."""
    return sorted(years if years is not None else (int(r.harv_year) for r in df.select("harv_year").where("harv_year IS NOT NULL").distinct().collect()))


def distributed_predictions(df: DataFrame, years: int | Sequence[int] | None, features: Sequence[str], y: str, model: str = "rf", seed: int = 42, **params) -> DataFrame:
    """The rows of the held-out years (all, if none are given) with ``y_pred`` of a model trained on the other years' rows."""
    out, df = [], cut_lineage(df)  # read for every year
    for year in held_out_years(df, [years] if isinstance(years, int) else years):  # each one a distributed job
        fitted, assembler = distributed_model(df.where(F.col("harv_year") != year), features, y, model, seed, **params)
        rows = fitted.transform(assembler.transform(df.where(F.col("harv_year") == year)))
        out.append(rows.withColumnRenamed("prediction", "y_pred").drop("__features"))
    return reduce(DataFrame.unionByName, out)


def feature_importance(df: DataFrame, features: Sequence[str], y: str, years: Sequence[int] | None = None, model: str = "rf", seed: int = 42, **params) -> DataFrame:
    """(year_out, feature, importance): gain importance in the tree model of each held-out year, all if none are given."""
    rows, df = [], cut_lineage(df.select("harv_year", *features, y))  # read for every year
    for year in held_out_years(df, years):  # each one a distributed job
        fitted, _ = distributed_model(df.where(F.col("harv_year") != year), features, y, model, seed, **params)
        rows += [(int(year), c, float(v)) for c, v in zip(features, fitted.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "year_out int, feature string, importance double")


def attach_transfer_features(df: DataFrame, transfer: DataFrame, mode: str = "internal", fallback: str = "zero") -> DataFrame:
    """Rows (source, year_out[, country_out], adm, harv_year, ...) with the transferred features of the same held-out year.

    ``external`` also matches the held-out country. Where a (source, held-out year) has no features at all, ``y_pred`` is 0 or the
    benchmark and ``tag`` is ``no-source-model``.
    """
    fold = ["source", "year_out"] + (["country_out"] if mode == "external" else [])
    known = transfer.select(*fold).distinct().withColumn("__known", F.lit(True))
    features = [c for c in transfer.columns if c.startswith("transfer_")]
    rows = df.join(transfer.select(*fold, "adm", "harv_year", *features), [*fold, "adm", "harv_year"], "left").join(known, fold, "left")
    lost = F.col("__known").isNull()
    instead = F.lit(0.0) if fallback == "zero" else F.col("y_bench")
    return rows.withColumn("y_pred", F.when(lost, instead)).withColumn("tag", F.when(lost, "no-source-model")).drop("__known")
