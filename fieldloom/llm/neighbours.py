"""Nearest neighbours by largest inner product: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and residual codebooks are trained on the driver on a bounded sample of the vectors' directions; every vector is indexed,
by its direction and its length, so that long and short ones are told alike well. A query visits the lists whose centroids have the largest
inner product with it, scores their codes by asymmetric distance tables, and its best candidates are reranked on the original
vectors. How many lists and candidates it takes for the wanted recall is measured on ``PROBES`` queries against all rows. Only codes and ids go to the search: vectors are met again in the reranking, by a join of the few candidates. Lists are packed into
buckets of bounded size, a long list into several, and queries into blocks; a task searches one bucket for one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, small_side

#: Vectors that centroids and codebooks are trained on; a bound on what the driver holds.
SAMPLE = 16_384
#: Lists are this times the root of the number of rows, but each has PER_LIST vectors of the sample on average at least.
LISTS, PER_LIST = 2.0, 16
#: Rows of a bucket, and queries, that meet in one task.
BLOCK = 16_384
QUERY_BLOCK = 2048
#: Least number of candidates by their codes, in multiples of ``k``, that are reranked.
RERANK = 8
#: Queries that are answered by brute force to measure recall, and share of true neighbours that the candidates must hold.
PROBES, HELD = 256, 0.99


@dataclass
class Quantiser:
    """Centroids (lists, size) of directions, codebooks (parts, codes, size of a part), lists that a query visits, and the sample as its codes tell it."""

    centroids: np.ndarray
    codebooks: np.ndarray
    visits: int
    sample: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One byte for each part of each vector's residual."""
        residual, parts = x - self.centroids[lists], []
        at = 0
        for book in self.codebooks:
            parts.append(_nearest(residual[:, at : at + book.shape[1]], book).astype(np.uint8))
            at += book.shape[1]
        return np.stack(parts, axis=1)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes say of the vectors."""
        return self.centroids[lists] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], axis=1)

    def least(self, queries: np.ndarray, wanted: int, rows: int) -> np.ndarray:
        """A score that about ``wanted`` of ``rows`` rows reach for each query, going by the sample; from its third place on."""
        at = len(self.sample) - min(len(self.sample), max(3, 2 + wanted * len(self.sample) // max(1, rows)))
        return np.concatenate([np.partition(queries[i : i + 512] @ self.sample.T, at, axis=1)[:, at] for i in range(0, len(queries), 512)] or [np.zeros(0)])

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the codes: (parts, codes, queries)."""
        q = queries.reshape(len(queries), len(self.codebooks), -1)
        return np.einsum("qmd,mcd->mcq", q, self.codebooks)

    def cosines(self, tables: np.ndarray, heads: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products (rows, queries) of rows' coded directions with queries, of which ``tables`` and the centroids' products ``heads`` are given."""
        out = heads.T.take(lists, axis=0)
        for m, column in enumerate(codes.T):
            out += tables[m].take(column, axis=0)
        return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and the lengths. No row may be zero; nothing overflows."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / length).astype(np.float32), (scale * length)[:, 0]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = 0.5 * (centroids * centroids).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, x)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        centroids[~filled] = x[rng.integers(0, len(x), int((~filled).sum()))]
    return centroids


def train_quantiser(sample: np.ndarray, rows: int, k: int = 20, recall: float = 0.94, part: int = 2, seed: int = 3) -> Quantiser:
    """Fit on a sample of ``rows`` vectors; visits suffice for ``recall`` of the ``k`` nearest among the sample's own vectors."""
    rng, (x, length) = np.random.default_rng(seed), directions(np.asarray(sample, np.float64))
    n_lists = int(max(1, min(len(x) // PER_LIST, LISTS * np.sqrt(rows))))
    centroids = _kmeans(x, n_lists, rng)
    own = _nearest(x, centroids)
    residual = x - centroids[own]
    size = next(p for p in range(min(part, x.shape[1]), 0, -1) if x.shape[1] % p == 0)
    books = np.stack([np.resize(_kmeans(residual[:, i : i + size], 256, rng), (256, size)) for i in range(0, x.shape[1], size)])
    probes = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    near = np.argsort(-(probes @ x.T * length), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(probes @ centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centroids))[None], 1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel()) + 1
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1
    quantiser = Quantiser(centroids, books, visits, x)
    quantiser.sample = quantiser.decoded(own, quantiser.codes(x, own)) * length[:, None]
    return quantiser


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length without nulls as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, vector) of the rows that take part: with an id, not null, not zero, all components finite; ``row`` numbers them."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad).where(F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector")


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.94) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` on column ``id`` its ``k`` nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller id, fewer than ``k`` rows come only where fewer
    candidates exist. Null and zero vectors, vectors with null or non-finite components, and null ids take no part. Vectors of different
    lengths have no inner product: each length has an index of its own. Of repeated ids each row is a candidate, but for the query's own
    id, and each repeated query id is one query for the first of its vectors of a length. An empty table gives an empty result.
    """
    rows = cut_lineage(valid_vectors(vectors, id_col, vector_col))
    lengths = [r.n for r in rows.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]  # a few
    found = [_of_one_length(rows.where(F.size("vector") == n) if len(lengths) > 1 else rows, is_query, k, recall) for n in lengths]
    found = reduce(DataFrame.unionAll, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(rows: DataFrame, k: int, recall: float) -> Quantiser:
    """A quantiser for rows (row, id, vector), from a sample by hashes of the rows' numbers; all of them take part if they are few."""
    total = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "row"), F.lit(1_000_000)) < int(1.2e6 * SAMPLE / max(1, total)) + 1)
    sample = chosen.select("row", "vector").orderBy(F.xxhash64(F.lit("order"), "row"), "row").limit(SAMPLE).collect()
    sample = sorted((r.row, r.vector) for r in sample)
    return train_quantiser(np.array([v for _, v in sample]), total, k, recall)


def _buckets(sizes: np.ndarray) -> list[list[int]]:
    """For each list the buckets that hold it: several for a list over BLOCK rows, else one, shared with lists that fit in."""
    out, bucket, room = [], -1, 0
    for n in sizes.tolist():
        if n > BLOCK:
            parts = -(-n // BLOCK)
            out.append(list(range(bucket + 1, bucket + 1 + parts)))
            bucket, room = bucket + parts, 0
            continue
        if n > room or bucket < 0:
            bucket, room = bucket + 1, BLOCK
        room -= n
        out.append([bucket])
    return out


def _of_one_length(rows: DataFrame, is_query: Column, k: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score) of the candidates, reranked, for vectors of one length."""
    quantiser = fit(rows, k, recall)
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(quantiser)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length = directions(_matrix(batch.column("vector")))
            own = shared.value.lists(x)
            codes = [c.tobytes() for c in shared.value.codes(x, own)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(own, pa.int32()), pa.array(length), pa.array(codes, pa.binary())], ["row", "id", "list", "length", "code"])

    indexed = cut_lineage(rows.mapInArrow(index, "row long, id long, list int, length double, code binary"))
    counts = {r.list: r.n for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    sizes = np.array([counts.get(i, 0) for i in range(len(quantiser.centroids))])
    total = int(sizes.sum())
    asked = cut_lineage(rows.where(is_query).groupBy("id").agg(F.min("vector").alias("vector")))
    visits, keep = measured(rows, indexed, asked, shared, k, recall)
    buckets = context.broadcast(_buckets(sizes))

    def visit(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        """The lists of each query, by bucket: the best ones, and more until they hold enough rows; or every list, and no least score."""
        for batch in batches:
            x = directions(_matrix(batch.column("vector")))[0]
            order = np.argsort(-(x @ shared.value.centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            needed = np.maximum(visits, (held < 2 * k + 2).sum(axis=1) + 1)
            least = shared.value.least(x, keep, total) if not every else np.full(len(x), -np.inf)
            needed = needed if not every else np.full(len(x), len(sizes))
            of, where, lists = [], [], []
            for i, (o, n) in enumerate(zip(order, needed)):
                by_bucket: dict[int, list[int]] = {}
                for one in o[:n].tolist():
                    for bucket in buckets.value[one] if sizes[one] else ():
                        by_bucket.setdefault(bucket, []).append(one)
                of += [i] * len(by_bucket)
                where += by_bucket
                lists += by_bucket.values()
            of = pa.array(of, pa.int64())
            least = pa.array(least, pa.float64()).take(of)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("vector").take(of), pa.array(where, pa.int32()), pa.array(lists, pa.list_(pa.int32())), least], ["id", "vector", "bucket", "lists", "least"])

    held = buckets.value  # a list has a place in both arrays
    first, parts = (F.element_at(F.lit([f(b) for b in held]), F.col("list") + 1) for f in (lambda b: b[0], len))
    bucketed = indexed.withColumn("bucket", (first + F.pmod(F.xxhash64("row"), parts)).cast("int"))

    def search(codes: pa.Table, asked: pa.Table) -> pa.Table:
        if not codes.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        return _search(shared.value, codes.combine_chunks(), asked.combine_chunks(), keep)

    def best_of(queries: DataFrame, every: bool) -> DataFrame:
        """(query_id, row, vec_id) of the best candidates by their codes."""
        blocks = max(1, -(-queries.count() // max(64, QUERY_BLOCK * RERANK * k // keep)))  # a task's results stay as many
        right = queries.mapInArrow(partial(visit, every=every), "id long, vector array<double>, bucket int, lists array<int>, least double")
        right = right.withColumn("queries", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        left = bucketed.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["bucket", "queries"]
        near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, row long, vec_id long, near double")
        # Every task sends what reaches a query's least score, its bucket's ``keep`` best at most; the best of all are met with their vectors.
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "row"))
        return near.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "row", "vec_id")

    best = cut_lineage(best_of(asked, False))
    # The sample that sets the least score may hold the query's own rows, and its lists may hold few others: such queries are asked again, everywhere.
    got = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("got"))
    short = cut_lineage(asked.join(got, "id", "left").where(F.coalesce("got", F.lit(0)) < min(k, total - 1)).select("id", "vector"))
    if not short.isEmpty():
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionAll(best_of(short, True))
    best = best.join(rows.select("row", "vector"), "row").join(small_side(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))), "query_id")
    score = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return best.select("query_id", "vec_id", score.alias("score"))


def measured(rows: DataFrame, indexed: DataFrame, asked: DataFrame, shared: Broadcast, k: int, recall: float) -> tuple[int, int]:
    """(lists, candidates) that a query needs so that ``recall`` of the true neighbours lie in its lists and HELD of them among its candidates by their codes.

    The true neighbours are those of PROBES queries at most, found among all rows by brute force; a task keeps ``k`` rows a probe.
    """
    probes = asked.orderBy(F.xxhash64(F.lit("probe"), "id"), "id").limit(PROBES).collect()
    if not probes:
        return shared.value.visits, RERANK * k
    ids, vectors = np.array([p.id for p in probes]), np.array([p.vector for p in probes])
    unit = directions(vectors)[0]

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            x, own, number = _matrix(batch.column("vector")), batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for i, s in enumerate(vectors @ x.T):
                s[own == ids[i]] = -np.inf
                some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                some = some[s[some] > -np.inf]
                every = [np.concatenate(v) for v in zip(best[i], (s[some], own[some], number[some]))]
                first = np.lexsort((every[2], every[1], -every[0]))[:k]
                best[i] = tuple(v[first] for v in every)
        of = np.repeat(np.arange(len(ids)), [len(b[0]) for b in best])
        columns = [np.concatenate(v) for v in zip(*best)]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], ["probe", "score", "id", "row"])

    place = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "id", "row"))
    near = rows.mapInArrow(truth, "probe int, score double, id long, row long").withColumn("place", place).where(F.col("place") <= k)
    true = near.select("probe", "row").join(indexed, "row").select("probe", "row", "id", "list", "length", "code").collect()
    if not true:
        return shared.value.visits, RERANK * k
    of, lists = np.array([t.probe for t in true]), np.array([t.list for t in true])
    heads = unit @ shared.value.centroids.T
    ahead = np.sort((heads[of] > heads[of, lists][:, None]).sum(axis=1) + 1)
    visits = int(ahead[min(len(ahead) - 1, int(np.ceil(recall * len(ahead))))])
    tables = shared.value.tables(unit)
    told = shared.value.cosines(tables, heads, lists, np.stack([np.frombuffer(t.code, np.uint8) for t in true]))[np.arange(len(true)), of] * np.array([t.length for t in true])
    true = [(np.array([t.id for t in true])[of == i], told[of == i], np.flatnonzero(of == i)) for i in range(len(ids))]

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows go before each true neighbour by their codes."""
        count = np.zeros(len(told), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                own, length = part.column("id").to_numpy(), part.column("length").to_numpy()
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
                scores = shared.value.cosines(tables, heads, part.column("list").to_numpy(), codes) * length[:, None]
                for i, (its, value, at) in enumerate(true):
                    if len(at):
                        some = np.flatnonzero((scores[:, i] >= value.min()) & (own != ids[i]))
                        s, o = scores[some, i][:, None], own[some][:, None]
                        count[at] += ((s > value) | ((s == value) & (o < its))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(count)), pa.int32()), pa.array(count)], ["at", "n"])

    ranks = np.sort([r.n for r in indexed.mapInArrow(better, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()]) + 1
    return visits, max(RERANK * k, int(ranks[min(len(ranks) - 1, int(np.ceil(HELD * len(ranks))))]))


def _search(q: Quantiser, rows: pa.Table, asked: pa.Table, keep: int) -> pa.Table:
    """Each query's ``keep`` best rows of the lists that it visits, by their codes, from its least score on; ties by id."""
    order = np.lexsort((rows["row"].to_numpy(), rows["id"].to_numpy()))
    ids, numbers, lists, length = (rows[c].to_numpy()[order] for c in ("id", "row", "list", "length"))
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
    members = {i: np.flatnonzero(lists == i) for i in np.unique(lists).tolist()}
    asking, least, vectors, visits = asked["id"].to_numpy(), asked["least"].to_numpy(), directions(_matrix(asked["vector"].combine_chunks()))[0], asked["lists"].to_pylist()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(asking), 64):
        block = vectors[start : start + 64]
        tables, near = q.tables(block), np.full((len(block), len(ids)), -np.inf, np.float32)
        wants: dict[int, list[int]] = {}
        for i, lists_of in enumerate(visits[start : start + 64]):
            for one in lists_of:
                wants.setdefault(one, []).append(i)
        for one, who in wants.items():
            at = members.get(one)
            if at is None:
                continue
            sums = np.zeros((len(at), len(block)), np.float32)
            for m, column in enumerate(codes[at].T):
                sums += tables[m].take(column, axis=0)  # for the whole block, which is cheaper than to choose columns
            near[np.ix_(who, at)] = sums.T[who] + (block[who] @ q.centroids[one])[:, None]
        for i, scores in enumerate(near):
            scores = scores * length
            scores[ids == asking[start + i]] = -np.inf
            some = np.flatnonzero(scores >= least[start + i])
            some = some[np.argsort(-scores[some], kind="stable")][:keep]  # rows are in order of ids
            out.append((np.full(len(some), start + i), some, scores[some]))
    who, some, near = (np.concatenate(x) for x in zip(*out))
    return pa.table({"query_id": pa.array(asking[who], pa.int64()), "row": pa.array(numbers[some], pa.int64()), "vec_id": pa.array(ids[some], pa.int64()), "near": pa.array(near, pa.float64())})
