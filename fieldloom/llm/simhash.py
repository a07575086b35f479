"""Near-duplicates by SimHash fingerprints that differ in few bits.

A fingerprint's bits are the majority bits of its shingles' hashes. To find all pairs within ``k`` bits, the fingerprint is
cut into ``k // 2 + 1`` segments: two fingerprints within ``k`` bits differ by at most one bit in some segment. Each segment is
indexed by its one-wildcard variants (the segment with one bit left out), so such a pair meets under an equal key. Equal
keys are brought together by one shuffle, and every meeting is verified on the whole fingerprints.

Copies collapse to one fingerprint before that. Inside a key a search over the fingerprints not yet reached replaces the
comparison of all pairs, and only a spanning forest of links leaves the task. A key with more than ``BLOCK`` fingerprints is
dealt into blocks and compared by pairs of blocks in separate tasks. Components come from rounds of contraction on the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, give_back, slices, small_side, spread_join

BITS = 64
#: Fingerprints of one key that a task compares at once.
BLOCK = 4096
#: Keys with up to so many fingerprints are compared by shifted vectors, many keys at once.
_SHORT = 6
#: Hot keys up to which their table is broadcast; beyond, it is joined by a shuffle.
_BROADCAST_KEYS = 100_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _shingled(text: str | None, width: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _fingerprint(shingles: list[bytes], seed: int) -> int:
    if not shingles:
        return 0
    hashes = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles)), np.uint8).reshape(-1, 8)
    counts = np.bincount((hashes + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def simhash(text: Column, width: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> Column:
    """64-bit fingerprints, signed longs, one for each seed in a struct (fp_0, fp_1, ..), of a whole text's ``width``-word shingles, repeats included or each once.

    Letters A-Z are lower-cased; words are runs of characters other than the six ASCII white-space characters. A shorter text
    has its whole word sequence as its only shingle; null and wordless texts have fingerprint 0.
    """

    names = [f"fp_{s}" for s in range(len(seeds))]

    @F.arrow_udf(", ".join(f"{name} long" for name in names))
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            all_shingles = (_shingled(t, width) for t in batch.to_pylist())
            found = [[_fingerprint(shingles, seed) for seed in seeds] for shingles in (list(set(x)) if distinct else x for x in all_shingles)]
            yield pa.StructArray.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in range(len(seeds))], names)

    return fingerprints(text)


def _segments(k: int) -> list[tuple[int, int]]:
    """(shift, width) of each of the k // 2 + 1 segments, two at least, as even as 64 bits allow."""
    n = max(2, k // 2 + 1)
    cuts = [i * BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys_of(value: Column, segment: int, width: int) -> list[Column]:
    """Keys of a segment's one-wildcard variants: segment, wildcard position, and the bits with that one cleared."""
    return [value.bitwiseAND(F.lit(~(1 << i))) + F.lit((segment * 64 + i) << 40) for i in range(width)]


def _value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _reach(points: np.ndarray, k: int) -> np.ndarray:
    """For each point the first point of its component, where points within ``k`` bits are linked."""
    first, left = np.arange(len(points)), np.arange(len(points))
    while left.size:
        seed, left = left[0], left[1:]
        edge = np.array([seed])
        while edge.size and left.size:
            block, edge = edge[:64], edge[64:]
            near = (np.bitwise_count(points[left][None, :] ^ points[block][:, None]) <= k).any(axis=0)
            first[left[near]] = seed
            edge = np.concatenate([edge, left[near]])
            left = left[~near]
    return first


def _forest(keys: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, under each key, what links within ``k`` bits connect. Both arrays are sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    short = np.repeat((sizes > 1) & (sizes <= _SHORT), sizes)
    for step in range(1, _SHORT):
        i = np.flatnonzero(short[:-step] & (keys[step:] == keys[:-step]))
        i = i[np.bitwise_count(points[i] ^ points[i + step]) <= k]
        a.append(points[i])
        b.append(points[i + step])
    for start, size in zip(starts[sizes > _SHORT], sizes[sizes > _SHORT]):
        run = points[start : start + size]
        first = _reach(run, k)
        linked = np.flatnonzero(first != np.arange(size))
        a.append(run[first[linked]])
        b.append(run[linked])
    return np.concatenate(a), np.concatenate(b)


def _link_runs(batches: Iterator[pa.RecordBatch], k: int, find) -> Iterator[pa.RecordBatch]:
    """Links of rows (block, fp) sorted by block; a run of equal blocks may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, points = (np.concatenate(x) for x in zip(*parts))
        if len(keys) > 1:
            a, b = find(keys, points, k)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        keys, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        last = np.searchsorted(keys, keys[-1])
        if last or (held and held[-1][0][-1] != keys[-1]):
            yield from links([*held, (keys[:last], points[:last])])
            held = []
        held.append((keys[last:], points[last:]))
    if held:
        yield from links(held)


def near_links(points: DataFrame, k: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within ``k`` bits.

    ``points`` has one column ``fp`` of distinct longs, written to shared storage beforehand, as it is read three times.
    """
    if not 0 <= k < 2 * BITS // 3:
        raise ValueError("k must lie between 0 and 41 bits")
    fp, parts = F.col("fp"), _segments(k)
    keys = F.explode(F.array(*[x for s, (shift, width) in enumerate(parts) for x in _keys_of(_value(fp, shift, width), s, width)]))
    variants = points.select(keys.alias("key"), "fp")

    # A variant's rows come from two values of its segment, so a key over `block` rows has a value over half of that.
    values = F.explode(F.array(*[_value(fp, *p) + F.lit(s << 40) for s, p in enumerate(parts)]))
    many = points.select(values.alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    many = cut_lineage(many)
    hot = None
    for s, (_, width) in enumerate(parts):
        low = F.col("value").bitwiseAND(F.lit((1 << 40) - 1))
        own = many.where(F.shiftright("value", 40) == s).select(F.explode(F.array(*_keys_of(low, s, width))).alias("key"), "n")
        hot = own if hot is None else hot.unionAll(own)
    # The other value has at most block // 2 rows if it is not in the table itself.
    hot = hot.groupBy("key").agg((F.floor((F.sum("n") + F.lit(block // 2)) / F.lit(block // 2)) + 1).cast("int").alias("parts"))
    if many.count() * max(w for _, w in parts) <= _BROADCAST_KEYS:
        hot = F.broadcast(hot)
    own, other = F.expr("pmod(xxhash64(fp), parts)"), F.col("other")
    dealt = (
        variants.join(hot, "key", "left")
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .withColumn(
            "block",
            F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(own, other.cast("long")), F.greatest(own, other.cast("long")))),
        )
        .select("block", "fp")
    )
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "block").sortWithinPartitions("block", "fp")
    return sorted_.mapInArrow(partial(_link_runs, k=k, find=_forest), "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): for every id that links, the smallest id that it reaches.

    Each round hooks every id to its smallest neighbour, follows those pointers to their ends and contracts the links, so
    their number falls geometrically. Only sums and minima are shuffled; no group is gathered.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut_lineage(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionAll(edges.select(b.alias("a"), a.alias("b")))
        step = cut_lineage(both.groupBy(a.alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
        while True:  # pointer doubling
            up = step.select(F.col("id").alias("root"), F.col("root").alias("top"))
            far = cut_lineage(spread_join(step, up, "root", "id").select("id", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")))
            step = far.select("id", "root")
            if far.where("moved").isEmpty():
                break
        if labels is None:
            labels = step
        else:
            up = step.select(F.col("id").alias("root"), F.col("root").alias("top"))
            known = up.join(labels.select("root").distinct(), "root", "right").select("root", F.coalesce("top", "root").alias("top"))
            labels = cut_lineage(spread_join(labels, known, "root", "id").select("id", F.col("top").alias("root")))
        left, right = step.select(F.col("id").alias("a"), F.col("root").alias("x")), step.select(F.col("id").alias("b"), F.col("root").alias("y"))
        moved = spread_join(spread_join(edges, left, "a", "b"), right, "b", "a").where("x != y")
        edges = cut_lineage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return labels if labels is not None else edges.select(a.alias("id"), b.alias("root"))


def _rooted(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``points``, one row for each fingerprint ``fp``: those that link, with the ``root`` of their component, and those that don't."""
    roots = components(near_links(points.select("fp"), k)).withColumnRenamed("id", "fp")
    both = cut_lineage(points.join(roots, "fp", "left"))
    return both.where(F.col("root").isNotNull()), both.where(F.col("root").isNull()).drop("root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, width: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id): fingerprints in hexadecimal and each component's smallest id.

    Every row is kept: repeated ids keep a row each, null ids take part and are never the smallest unless alone. Null and
    wordless texts have fingerprint zero and link like any other. An empty table gives an empty result.
    """
    prints = cut_lineage(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), width)["fp_0"].alias("fp")))
    points = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    # A component's smallest document: the minimum over its fingerprints.
    linked, alone = _rooted(points, k)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = spread_join(linked.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    classes = classes.unionAll(alone.select("fp", F.col("least").alias("component_id")))
    out = prints.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: For near-duplicates by similarity: the share of pairs just at the wanted similarity that are to meet under some key, how many standard
#: deviations more bits such a pair may differ in, and texts of a group that a task compares with each other.
RECALL, SPREAD, TILE = 0.99, 3.2, 256


def _bit_difference(similarity: float) -> float:
    """The chance that a fingerprint bit differs between equally long texts that share this part of all their shingles."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _plan(points: int, similarity: float, block: int = BLOCK) -> tuple[int, int, int]:
    """(segments of a fingerprint, fingerprints, bits by which a pair may differ in all) for so many points.

    Segments are the shortest under which a key's unrelated points stay few; fingerprints as many as ``RECALL`` takes.
    """
    p = _bit_difference(similarity)
    segments = next((n for n in range(5, 2, -1) if points >> (BITS // n - 1) <= block // 4), 2)
    width = BITS // segments
    meets = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    prints = next(n for n in range(1, 65) if 1 - (1 - meets) ** (segments * n) >= RECALL)
    bits = BITS * prints
    return segments, prints, int(np.ceil(bits * p + SPREAD * np.sqrt(bits * p * (1 - p))))


def _far(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Bits by which points differ over all their fingerprints."""
    return reduce(np.add, [np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b)])


def _stars(prints: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, member) for every point but the first of each component, where points within ``most`` bits are linked."""
    n = len(prints[0])
    first, left = np.arange(n), np.arange(n)
    while left.size:
        seed, left = left[0], left[1:]
        edge = np.array([seed])
        while edge.size and left.size:
            block, edge = edge[:64], edge[64:]
            near = (_far([x[left][None] for x in prints], [x[block, None] for x in prints]) <= most).any(axis=0)
            first[left[near]] = seed
            edge = np.concatenate([edge, left[near]])
            left = left[~near]
    members = np.flatnonzero(first != np.arange(n))
    return first[members], members


def _close(keys: np.ndarray, points: np.ndarray, prints: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that connect, under each key, what pairs within ``most`` bits connect: each point with the smallest one that it reaches,
    so that components settle in few rounds. Rows are sorted by key.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat((sizes > 1) & (sizes <= _SHORT), sizes)
    for step in range(1, _SHORT):
        i = np.flatnonzero(short[:-step] & (keys[step:] == keys[:-step]))
        i = i[_far([x[i] for x in prints], [x[i + step] for x in prints]) <= most]
        a.append(i)
        b.append(i + step)
    for start, size in zip(starts[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist()):
        run = [x[start : start + size] for x in prints]
        near = np.zeros(size, bool)
        for at in range(0, size, 256):
            block = _far([x[at : at + 256, None] for x in run], [x[None] for x in run]) <= most
            block[np.arange(len(block)), at + np.arange(len(block))] = False
            near[at : at + 256] = block.any(axis=1)
        some = np.flatnonzero(near)
        if len(some):
            some = some[np.argsort(points[start + some])]
            x, y = _stars([r[some] for r in run], most)
            a.append(start + some[x])
            b.append(start + some[y])
    return np.concatenate(a), np.concatenate(b)


def _close_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (block, point, fp_0, ..) sorted by block; a run of equal blocks may span batches."""
    held: list[list[np.ndarray]] = []

    def links(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, points, *prints = (np.concatenate(x) for x in zip(*parts))
        if len(keys) > 1:
            a, b = _close(keys, points, [x.view(np.uint64) for x in prints], most)
            yield pa.RecordBatch.from_arrays([pa.array(points[x]) for x in (a, b)], ["a", "b"])

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last or (held and held[-1][0][-1] != rows[0][-1]):
            yield from links([*held, [x[:last] for x in rows]])
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield from links(held)
    give_back()


def close_links(points: DataFrame, segments: int, most: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect points which agree but for one bit in a segment of a fingerprint and differ in ``most`` bits at most in all.

    ``points`` has distinct longs ``point`` and fingerprints fp_0, fp_1, .., stored, as it is read three times. Keys are those of
    ``near_links``, for each fingerprint; so are hot keys dealt into pairs of blocks.
    """
    prints = [c for c in points.columns if c.startswith("fp_")]
    cuts = [i * BITS // segments for i in range(segments + 1)]
    parts = [(p, s, cuts[s], cuts[s + 1] - cuts[s]) for p in range(len(prints)) for s in range(segments)]
    values = F.explode(F.array(*[_value(F.col(prints[p]), shift, width) + F.lit((p * segments + s) << 40) for p, s, shift, width in parts]))
    # A key's rows come from two values of its segment; see near_links.
    many = cut_lineage(points.select(values.alias("value")).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > block // 2))
    names = ["key", "point", *prints]

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every point under the keys of its segments' one-wildcard variants."""
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                found = {n: batch.column(n).to_numpy().view(np.uint64) for n in names[1:]}
                for place, (p, _, shift, width) in enumerate(parts):
                    value = (found[prints[p]] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    for i in range(width):
                        keys = (value & np.uint64(~(1 << i) & ((1 << 40) - 1))) + np.uint64((place * 64 + i) << 40)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, *found.values())], names)

    keyed = points.select(*names[1:]).mapInArrow(variants, ", ".join(f"{n} long" for n in names))
    if not many.isEmpty():
        low, hot = F.col("value").bitwiseAND(F.lit((1 << 40) - 1)), None
        for place, (*_, width) in enumerate(parts):
            own = many.where(F.shiftright("value", 40) == place).select(F.explode(F.array(*_keys_of(low, place, width))).alias("key"), "n")
            hot = own if hot is None else hot.unionAll(own)
        hot = cut_lineage(hot.groupBy("key").agg((F.floor((F.sum("n") + F.lit(block // 2)) / F.lit(block // 2)) + 1).cast("int").alias("parts")))
        own, other = F.expr("pmod(xxhash64(point), parts)"), F.col("other").cast("long")
        pairs = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = keyed.join(small_side(hot), "key", "left").withColumn("other", pairs)
        dealt = dealt.withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(own, other), F.greatest(own, other))))
        keyed = dealt.select(*names)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(partial(_close_runs, most=most), "a long, b long")


def _shingles(text: Column, width: int) -> Column:
    """Sorted distinct hashes of a text's shingles."""

    @F.arrow_udf("array<long>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            out = []
            for t in batch.to_pylist():
                out.append(np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, _shingled(t, width))), np.int64)))
            yield pa.array(out, pa.list_(pa.int64()))

    return hashes(text)


def _similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets share at least ``similarity`` of all their members."""
    size, n = np.array([len(s) for s in sets]), len(sets)
    owner, member = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, name, count = np.unique(member, return_inverse=True, return_counts=True)
    often = count[name] > 1
    owner, name = owner[often], np.unique(name[often], return_inverse=True)[1]
    shared, order = np.zeros((n, n), np.int64), np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    for start in range(0, int(name[-1]) + 1 if len(name) else 0, 4096):
        rows = slice(*np.searchsorted(name, [start, start + 4096]))
        there = np.zeros((n, 4096), bool)
        there[owner[rows], name[rows] - start] = True
        bits = np.packbits(there, axis=1).view(np.uint64)
        bits = bits[:, bits.any(axis=0)]
        for i in range(n):
            shared[i] += np.bitwise_count(bits[i] & bits).sum(axis=1, dtype=np.int64)
    # Sets are sorted arrays of distinct hashes: equal ones, the empty ones too, share all.
    return shared >= similarity * (size[:, None] + size[None] - shared)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (block, point, set) sorted by block that connect, in each block, all pairs of sets as similar as asked."""
    key, points, sets = None, [], []

    def links() -> pa.RecordBatch:
        near, a, b, left = _similar(sets, similarity), [], [], np.ones(len(sets), bool)
        while left.any():
            edge = [int(left.argmax())]
            left[edge[0]] = False
            while edge:
                at = edge.pop()
                found = np.flatnonzero(left & near[at])
                left[found] = False
                a += [points[at]] * len(found)
                b += [points[i] for i in found]
                edge += found.tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        blocks, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        column = batch.column(2)
        for i in range(batch.num_rows):
            if blocks[i] != key:
                if len(points) > 1:
                    yield links()
                key, points, sets = blocks[i], [], []
            points.append(own[i])
            sets.append(column[i].values.to_numpy().copy())  # not the whole batch with it
    if len(points) > 1:
        yield links()
    give_back()


def _similar_links(points: DataFrame, texts: DataFrame, segments: int, most: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all texts whose points are connected by ``close_links`` and which share ``similarity`` of their shingles.

    ``texts`` has (point, text). What close points connect is a group; its texts are compared with each other, group by group, exactly. A
    group of more than ``TILE`` texts is dealt into tiles, each pair of which is compared in a task of its own.
    """
    groups = components(close_links(points, segments, most)).withColumnRenamed("id", "point")
    sizes = groups.groupBy("root").agg((F.floor((F.count("*") - 1) / TILE) + 1).cast("int").alias("parts"))
    placed = cut_lineage(spread_join(groups, sizes, "root", "point"))
    sets = texts.join(small_side(placed), "point").select("point", "root", "parts", _shingles(F.col("text"), width).alias("set"))
    own, other = F.expr("pmod(xxhash64(point), parts)"), F.col("other").cast("long")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select(F.xxhash64("root", F.least(own, other), F.greatest(own, other)).alias("block"), "point", "set")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "block").sortWithinPartitions("block").mapInArrow(partial(_verified, similarity=similarity), "a long, b long")


def similarity_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one row of each component of near-duplicates, linked by ``similarity`` of their shingle sets; columns as they are.

    Candidates agree but for one bit in a segment of a fingerprint of their distinct shingles; ``_plan`` chooses segments and fingerprints by the
    number of different texts, such that of pairs just as similar as asked ``RECALL`` meet, and more of those that are more similar.
    Groups of close candidates are compared exactly on their whole texts. The row kept is the one with the smallest id, null ids last, then
    by a hash of the text; rows alike in both are told apart by a stored number. Rows with neither id nor text are taken for copies of
    nothing and stay. An empty table gives an empty result.
    """
    doc_id, text = F.col(id_col), F.col(text_col)
    segments, prints, most = _plan(docs.count(), similarity)
    names = [f"fp_{s}" for s in range(prints)]
    first = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("n"))
    copy = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("")), 256))
    fp = simhash(text, width, tuple(range(42, 42 + prints)), distinct=True)
    rows = docs.select(F.struct("*").alias("row"), fp.alias("fp"), copy.alias("copy"), first.alias("first"), (doc_id.isNull() & text.isNull()).alias("void"))
    rows = cut_lineage(rows.select("row", "fp.*", "copy", "first", "void"))
    # Exact copies are one point, named by its first row.
    heads = rows.where(~F.col("void")).groupBy("copy").agg(F.min("first").alias("first"), *[F.min(c).alias(c) for c in names])
    heads = cut_lineage(heads.select("first", F.col("first.n").alias("point"), *names))
    texts = rows.select(F.col("first.n").alias("point"), F.col(f"row.`{text_col}`").alias("text"))
    roots = components(_similar_links(heads.select("point", *names), texts, segments, most, width, similarity)).withColumnRenamed("id", "point")
    rooted = cut_lineage(heads.select("first", "point").join(roots, "point", "left"))
    kept = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("first")).select("first").unionAll(rooted.where("root IS NULL").select("first"))
    found = rows.select("row", "void", "first.n").join(kept.select(F.col("first.n").alias("kept")), F.col("n") == F.col("kept"), "left")
    return found.where(F.col("void") | F.col("kept").isNotNull()).select("row.*")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, width: int = 4) -> DataFrame:
    """Keep one row of each component of near-duplicates; columns as they are.

    It is the row with the smallest id, null ids last, then by a hash of the text; rows alike in both are told apart by a number
    that is stored with the fingerprints. Rows with neither id nor text are not taken for copies of anything and stay.
    """
    doc_id, text = F.col(id_col), F.col(text_col)
    first = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("n"))
    rows = docs.select(F.struct("*").alias("row"), simhash(text, width)["fp_0"].alias("fp"), first.alias("first"), (doc_id.isNull() & text.isNull()).alias("void"))
    rows = cut_lineage(rows)
    points = cut_lineage(rows.where(~F.col("void")).groupBy("fp").agg(F.min("first").alias("first")))
    linked, alone = _rooted(points, k)
    kept = linked.groupBy("root").agg(F.min("first").alias("first")).select("first").unionAll(alone.select("first")).select(F.col("first.n").alias("kept"))
    found = rows.select("row", "void", "first.n").join(kept, F.col("n") == F.col("kept"), "left")
    return found.where(F.col("void") | F.col("kept").isNotNull()).select("row.*")
