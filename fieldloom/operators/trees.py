"""Forests and boosted trees in nested leave-one-year-out folds, grown for all folds at once from sums over bins.

A model is one fit: a held-out year, an inner fold (or none) and a parameter set. Rows are packed into blocks of binned values, one byte a
value; models of a split come in chunks. Block and chunk meet by the split, and a task sends, for each open node of each tree, counts and
sums of the target by feature and bin. Added up, these give every node's best cut, so one pass over the blocks grows all trees of
all folds by a level, and neither a split nor a fold is gathered in a task. What returns to the state is a few numbers a node.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage

#: Gains that differ by less than this part are equal; of equal ones the first counts, whatever order sums were taken in.
TIE = 1e-9
#: Bins of a feature, rows of a block, models that meet a block at once.
BINS, ROWS, CHUNK = 32, 32_768, 32
DEFAULTS = {"rf": {"trees": 20, "depth": 3, "min_leaf": 1, "share": 1 / 3}, "gbt": {"trees": 20, "depth": 2, "min_leaf": 1, "rate": 0.1}}

_MIX = np.uint64(0x9E3779B97F4A7C15)


def scrambled(*parts) -> np.ndarray:
    """Pseudo-random 64-bit numbers, fixed by the whole numbers in ``parts``, which may be arrays."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * _MIX
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return h


def drawn_times(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a forest's tree draws each row: Poisson with mean 1, from a hash of the row's key."""
    u = scrambled(keys, tree, seed) / 2.0**64
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720.0])), u).astype(float)


def offered(features: Sequence[int], share: float, tree: int, node: int, seed: int) -> list[int]:
    """The features that a node of a forest chooses from: a ``share`` of them, one at least, by hashes."""
    order = sorted(features, key=lambda f: (int(scrambled(f, tree, node, seed + 1)), f))
    return sorted(order[: max(1, round(share * len(features)))])


class Tree:
    """Cuts of the inner nodes, {node: (feature, bin, gain)}, and values of all nodes; node i has children 2i + 1 and 2i + 2."""

    def __init__(self) -> None:
        self.cuts: dict[int, tuple[int, int, float]] = {}
        self.values: dict[int, float] = {}

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``bins``."""
        at = np.zeros(len(bins), np.int64)
        for node, (feature, cut, _) in sorted(self.cuts.items()):
            here = at == node
            at[here] = 2 * node + 1 + (bins[here, feature] > cut)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        leaves, where = np.unique(self.nodes(bins), return_inverse=True)
        return np.array([self.values[n] for n in leaves.tolist()])[where]


def predicted(kind: str, params: Mapping[str, float], trees: Sequence[Tree], bins: np.ndarray) -> np.ndarray:
    """A forest's mean, or boosted trees' sum, of which all but the first are scaled by the rate; the first of them is a constant."""
    if not len(bins):
        return np.zeros(0)
    each = [t.predict(bins) for t in trees]
    return np.mean(each, axis=0) if kind == "rf" else each[0] + params["rate"] * np.sum(each[1:], axis=0)


def best_cut(n: np.ndarray, s: np.ndarray, min_leaf: float) -> tuple[float, int]:
    """(gain in squared error, bin) of the best cut after a bin; gain 0 where no cut leaves ``min_leaf`` on both sides."""
    left, sum_left = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
    right, sum_right = n.sum() - left, s.sum() - sum_left
    fits = (left >= min_leaf) & (right >= min_leaf) & (left > 0) & (right > 0)
    gain = np.where(fits, sum_left**2 / np.where(fits, left, 1) + sum_right**2 / np.where(fits, right, 1) - s.sum() ** 2 / max(n.sum(), 1e-300), 0.0)
    at = int((gain >= gain.max() * (1 - TIE)).argmax())
    return float(gain[at]), at


def inner_places(years: Sequence[int], n: int, seed: int) -> dict[int, int]:
    from fieldloom.operators.models import inner_folds

    return dict(zip(years, inner_folds(np.array(years), n, seed).tolist()))


# -- blocks --------------------------------------------------------------------------------------------------------------------

_BLOCK = "of string, n int, adm array<string>, year binary, y binary, bench binary, key binary, x binary"


def _blocks(rows: DataFrame, size: int, cuts: Sequence[Sequence[float]] | None) -> DataFrame:
    """(of, n, adm, year, y, bench, key, x): rows in blocks of about ROWS, ``x`` as bins of ``cuts`` or of quantiles of the split, stored."""
    counts = cut_lineage(rows.groupBy("of").agg(F.count("*").alias("rows")))
    few = counts.limit(100_001).count() <= 100_000
    key = F.xxhash64("adm", "harv_year", "y")
    dealt = rows.join(F.broadcast(counts) if few else counts, "of").withColumn("key", key).withColumn("block", F.pmod("key", F.floor(F.col("rows") / ROWS) + 1))

    def pack(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        raw = lambda c, t: [np.ascontiguousarray(g[c].to_numpy().astype(t)).tobytes()]
        x = [g["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]
        out = {"of": [g["of"][0].as_py()], "n": [g.num_rows], "adm": [g["adm"].to_pylist()], "year": raw("harv_year", np.int32), "y": raw("y", np.float64), "bench": raw("bench", np.float64), "key": raw("key", np.int64), "x": x}
        return pa.table(out, pa.schema([("of", pa.string()), ("n", pa.int32()), ("adm", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("year", "y", "bench", "key", "x")]]))

    packed = dealt.groupBy("of", "block").applyInArrow(pack, _BLOCK)
    if cuts is not None:
        edges = F.lit(pickle.dumps([list(map(float, c)) for c in cuts]))
        packed = packed.withColumn("edges", edges)
    else:
        steps = [i / BINS for i in range(1, BINS)]
        found = rows.groupBy("of").agg(F.array(*[F.percentile_approx(F.col("x")[i], steps, 100_000) for i in range(size)]).alias("edges"))
        packed = packed.join(found, "of")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                edges = pickle.loads(r["edges"]) if isinstance(r["edges"], bytes) else r["edges"]
                x = np.frombuffer(r["x"]).reshape(r["n"], size)
                r["x"] = np.stack([np.searchsorted(np.unique(e), x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8).tobytes()
                del r["edges"]
                yield pa.RecordBatch.from_pylist([r], batch.schema.remove(batch.schema.get_field_index("edges")))

    return cut_lineage(packed.mapInArrow(binned, _BLOCK))


class _Block:
    """A block's rows as arrays."""

    def __init__(self, r: dict, size: int) -> None:
        self.adm, self.n = r["adm"], r["n"]
        self.year, self.key = np.frombuffer(r["year"], np.int32), np.frombuffer(r["key"], np.int64)
        self.y, self.bench = np.frombuffer(r["y"]), np.frombuffer(r["bench"])
        self.x = np.frombuffer(r["x"], np.uint8).reshape(self.n, size)


# -- models: (of, m, spec), spec a pickled dict of held, fold, param, years, test, columns, kind, params, seed, trees, level --------------

_MODEL = "of string, m int, spec binary"


def _chunks(models: DataFrame) -> DataFrame:
    return models.groupBy("of", F.floor(F.col("m") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("m", "spec")).alias("models")).select("of", "models")


def _met(blocks: DataFrame, models: DataFrame) -> DataFrame:
    return blocks.join(_chunks(models), "of")


def _open_nodes(spec: dict) -> list[tuple[int, int]]:
    """(tree, node) that the next level may cut."""
    growing = range(len(spec["trees"])) if spec["kind"] == "rf" else [len(spec["trees"]) - 1]
    first = 2 ** spec["level"] - 1
    return [(t, node) for t in growing for node in range(first, 2 * first + 1) if node == 0 or (node - 1) // 2 in spec["trees"][t].cuts]


def _histograms(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(of, m, tree, node, feature, n, s): counts and sums of the target by bin, for each open node and feature offered to it."""
    for batch in batches:
        for r in batch.to_pylist():
            block, out = _Block(r, size), []
            for model in r["models"]:
                spec = pickle.loads(model["spec"])
                inside = np.isin(block.year, spec["years"])
                x, y, key = block.x[inside], block.y[inside], block.key[inside]
                target = y if spec["kind"] == "rf" else y - predicted("gbt", spec["params"], spec["trees"][:-1], x) if len(spec["trees"]) > 1 else y
                nodes = {}
                for t, node in _open_nodes(spec):
                    if t not in nodes:
                        times = drawn_times(key, t, spec["seed"]) if spec["kind"] == "rf" else np.ones(len(x))
                        nodes[t] = spec["trees"][t].nodes(x), times
                    at, times = nodes[t]
                    here = (at == node) & (times > 0)
                    share = spec["params"]["share"] if spec["kind"] == "rf" else 1.0
                    for f in offered(spec["columns"], share, t, node, spec["seed"]):
                        bins = x[here, f]
                        out.append((r["of"], model["m"], t, node, f, np.bincount(bins, times[here], BINS), np.bincount(bins, (times * target)[here], BINS)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:5]], *[pa.array(list(c), pa.list_(pa.float64())) for c in columns[5:]]], ["of", "m", "tree", "node", "feature", "n", "s"])


def _levelled(blocks: DataFrame, models: DataFrame, size: int) -> DataFrame:
    """``models`` with one more level on every tree under growth."""
    found = _met(blocks, models).mapInArrow(partial(_histograms, size=size), "of string, m int, tree int, node int, feature int, n array<double>, s array<double>")
    sums = found.groupBy("of", "m", "tree", "node", "feature").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(BINS)]).alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(BINS)]).alias("s"))
    by_model = sums.groupBy("of", "m").agg(F.collect_list(F.struct("tree", "node", "feature", "n", "s")).alias("sums"))  # a model's open nodes

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spec, best = pickle.loads(r["spec"]), {}
                for h in sorted(r["sums"] or [], key=lambda h: (h["tree"], h["node"], h["feature"])):
                    n, s = np.array(h["n"]), np.array(h["s"])
                    tree = spec["trees"][h["tree"]]
                    tree.values[h["node"]] = float(s.sum() / n.sum()) if n.sum() else tree.values.get((h["node"] - 1) // 2, 0.0)
                    gain, cut = best_cut(n, s, spec["params"]["min_leaf"])
                    if gain > best.get((h["tree"], h["node"]), (1e-12,))[0] * (1 + TIE) and spec["level"] < spec["params"]["depth"]:
                        best[h["tree"], h["node"]] = (gain, h["feature"], cut)
                for (t, node), (gain, feature, cut) in best.items():
                    spec["trees"][t].cuts[node] = (feature, cut, gain)
                spec["level"] += 1
                if spec["kind"] == "gbt" and spec["level"] > (spec["params"]["depth"] if len(spec["trees"]) > 1 else 0) and len(spec["trees"]) <= spec["params"]["trees"]:
                    if len(spec["trees"]) == 1:
                        spec["trees"][0].cuts = {}  # the constant
                    spec["trees"].append(Tree())
                    spec["level"] = 0
                for t in spec["trees"]:
                    t.values.setdefault(0, 0.0)
                out.append({"of": r["of"], "m": r["m"], "spec": pickle.dumps(spec)})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("of", pa.string()), ("m", pa.int32()), ("spec", pa.binary())]))

    return cut_lineage(models.join(by_model, ["of", "m"], "left").mapInArrow(grown, _MODEL))


def _grown(blocks: DataFrame, models: DataFrame, size: int, kind: str, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """``models`` fully grown: a pass for each level, for boosted trees of each tree in turn."""
    deepest = max(p["depth"] for p in grid)
    passes = deepest + 1 if kind == "rf" else 1 + max(p["trees"] for p in grid) * (deepest + 1)
    for _ in range(int(passes)):
        models = _levelled(blocks, models, size)
    return models


def _started(folds: DataFrame, make) -> DataFrame:
    """Models from rows (of, years, year_out, names, ..): what ``make`` yields as specs for one fold's row, numbered within the split."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                place = sorted(r["years"]).index(r["year_out"])
                specs = list(make(r))
                rows += [{"of": r["of"], "m": place * len(specs) + i, "spec": pickle.dumps(s)} for i, s in enumerate(specs)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("of", pa.string()), ("m", pa.int32()), ("spec", pa.binary())]))

    return cut_lineage(folds.mapInArrow(start, _MODEL))


def tree_fits(rows: DataFrame, folds: DataFrame, size: int, kind: str, grid: Sequence[Mapping[str, float]], n_folds: int, upper: float, seed: int, cuts: Sequence[Sequence[float]] | None) -> tuple[DataFrame, DataFrame]:
    """Predictions (of, year_out, adm, harv_year, y_pred, train_mse) and importances (of, year_out, place, gain) of all folds.

    ``rows`` has (of, adm, harv_year, y, bench, x), ``folds`` (of, year_out, names), names being places of the columns that a fold may use.
    """
    params = [DEFAULTS[kind] | dict(p) for p in grid]
    blocks = _blocks(rows, size, cuts)
    years = folds.groupBy("of").agg(F.sort_array(F.collect_set("year_out")).alias("years"))  # a split's years
    folds = cut_lineage(folds.join(years, "of"))

    def spec(r: dict, years: list[int], fold: int, param: int) -> dict:
        trees = [Tree() for _ in range(int(params[param]["trees"]) if kind == "rf" else 1)]
        return {"held": r["year_out"], "fold": fold, "param": param, "years": years, "test": [], "columns": r["names"], "kind": kind, "params": params[param], "seed": seed, "trees": trees, "level": 0}

    def tuned(r: dict) -> Iterator[dict]:
        train = [v for v in sorted(r["years"]) if v != r["year_out"]]
        place = inner_places(train, n_folds, seed) if train else {}
        for p in range(len(params)):
            for f in range(n_folds if len(train) > n_folds else max(len(train), 1)):
                one = spec(r, [v for v in train if place[v] != f], f, p)
                yield one | {"test": [v for v in train if place[v] == f]}

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                block = _Block(r, size)
                for model in r["models"]:
                    s = pickle.loads(model["spec"])
                    here = np.isin(block.year, s["test"])
                    if here.any() and s["years"]:
                        found = predicted(kind, s["params"], s["trees"], block.x[here])
                        out.append({"of": r["of"], "year_out": s["held"], "param": s["param"], "fold": s["fold"], "n": int(here.sum()), "e": float(((found - block.y[here]) ** 2).sum())})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("of", pa.string()), ("year_out", pa.int32()), ("param", pa.int32()), ("fold", pa.int32()), ("n", pa.int64()), ("e", pa.float64())]))

    trial = _grown(blocks, _started(folds, tuned), size, kind, params)
    scored = _met(blocks, trial).mapInArrow(errors, "of string, year_out int, param int, fold int, n long, e double")
    by_fold = scored.groupBy("of", "year_out", "param", "fold").agg((F.sum("e") / F.sum("n")).alias("mse"))
    kept = by_fold.groupBy("of", "year_out", "param").agg(F.avg("mse").alias("mse"), F.max("mse").alias("worst")).where(F.col("worst") <= upper)
    best = kept.groupBy("of", "year_out").agg(F.min(F.struct("mse", "param")).alias("best")).select("of", "year_out", "best.*")
    chosen = cut_lineage(folds.join(best, ["of", "year_out"], "left"))

    def final(r: dict) -> Iterator[dict]:
        train = [v for v in sorted(r["years"]) if v != r["year_out"]]
        yield spec(r, train if r["param"] is not None else [], -1, r["param"] or 0) | {"test": [r["year_out"]], "mse": r["mse"]}

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = _Block(r, size)
                for model in r["models"]:
                    s = pickle.loads(model["spec"])
                    here = np.flatnonzero(block.year == s["held"])
                    if not len(here):
                        continue
                    found = predicted(kind, s["params"], s["trees"], block.x[here]) if s["years"] else block.bench[here]
                    bad = np.isnan(found)
                    columns = [[r["of"]] * len(here), [s["held"]] * len(here), [block.adm[i] for i in here], block.year[here].tolist(), [None if b else v for v, b in zip(found.tolist(), bad)], [s["mse"]] * len(here)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64()))], ["of", "year_out", "adm", "harv_year", "y_pred", "train_mse"])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s = pickle.loads(r["spec"])
                total = np.zeros(size)
                for t in s["trees"]:
                    for feature, _, gain in t.cuts.values():
                        total[feature] += gain
                if s["years"]:
                    out += [{"of": r["of"], "year_out": s["held"], "place": c, "gain": float(total[c] / (total.sum() or 1.0))} for c in s["columns"]]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("of", pa.string()), ("year_out", pa.int32()), ("place", pa.int32()), ("gain", pa.float64())]))

    models = _grown(blocks, _started(chosen, final), size, kind, params)
    found = _met(blocks, models).mapInArrow(predictions, "of string, year_out int, adm string, harv_year int, y_pred double, train_mse double")
    return found, models.mapInArrow(gains, "of string, year_out int, place int, gain double")


def split_key(split: Column) -> Column:
    """A split's name that tells null from every text, for joins."""
    return F.coalesce(F.concat(F.lit("="), split.cast("string")), F.lit("-"))
