"""Token counts of texts by a map-side lookup of pre-token lengths in two tiers.

A first pass, of a few tasks a core, sums up which pre-tokens are frequent, in a summary of bounded size a task. Their hashes and
counts merge in a tree of small tasks; only the strings of the hashes that are left at its top, at most ``TABLE``, are then read from
the summaries, each from one of them. So no pre-token is shuffled. The table of the frequent pre-tokens' lengths is broadcast. A second
pass looks up each pre-token there first; only a miss asks the worker's own caches, which outlive a task, and what they lack is merged,
the misses of some megabytes of text at once. Only lengths are kept, no ids. Whether a pre-token is in a tier changes the speed only,
never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, kept_in_worker, slices
from fieldloom.llm.bpe import CACHED_CHARS, Cache, Encoder, Vocabulary

#: Pre-tokens in the broadcast table, and in every summary.
TABLE = 16_384
_FAN = 32
#: Tasks a core of the pass that sums up; the number of summaries follows the cluster, not the data.
SUMMARIES = 8
#: Memory of each of a worker's two caches, of pieces and of chunks.
CACHE_BYTES = 64 << 20


def _cut(counts: Counter, size: int) -> Counter:
    """The ``size`` largest counts, less what the next one has: the sums that are lost are bounded, as in Misra and Gries."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    least = top[-1][1]
    return Counter({k: n - least for k, n in top[:-1] if n > least})


_SUMMARY = pa.schema([("part", pa.int32()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("pieces", pa.list_(pa.string()))])
_MERGED = pa.schema([("part", pa.int32()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("sources", pa.list_(pa.int32()))])
_STRINGS = pa.schema([("hash", pa.int64()), ("piece", pa.string())])


def _hash(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode()) - (1 << 63)


def _merge(rows: pa.Table, size: int) -> pa.Table:
    """One row of some: the most frequent hashes, their counts, and for each the summary that its string can be read from."""
    total, sources = Counter(), {}
    for _, hashes, counts, parts in sorted(zip(*(rows[c].to_pylist() for c in ("part", "hashes", "counts", "sources")))):
        total.update(dict(zip(hashes, counts)))
        for h, part in zip(hashes, parts):
            sources.setdefault(h, part)
        total = _cut(total, 4 * size)
    top = sorted(_cut(total, size).items(), key=lambda x: (-x[1], x[0]))
    columns = [[rows["part"][0].as_py() // _FAN], [[h for h, _ in top]], [[n for _, n in top]], [[sources[h] for h, _ in top]]]
    return pa.table(columns, schema=_MERGED)


def frequent_pieces(docs: DataFrame, text_col: str, path: str, size: int = TABLE) -> list[str]:
    """The pre-tokens that are frequent in all texts together, ``size`` at most, most frequent first."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        first, later = Counter(), Counter()
        for column in slices(b.column(0) for b in batches):
            for text in column.to_pylist():
                for segment in encoder.segments(text or "")[::2]:
                    chunks = encoder.chunks(encoder.normalize(segment) if encoder.v.lower else segment)
                    first[chunks[0]] += 1
                    later.update(chunks[1:])
            for counts in (first, later):
                if len(counts) > 16 * size:
                    kept = _cut(counts, 4 * size)
                    counts.clear()
                    counts.update(kept)
        pieces = Counter()
        for counts, before in ((first, ""), (later, "" if encoder.v.lower else " ")):
            for chunk, n in _cut(counts, 2 * size).items():
                if len(chunk) < 256:  # the table is for the frequent ones
                    for piece in encoder.pieces(before + chunk):
                        pieces[piece] += n
        top = sorted(_cut(pieces, size).items(), key=lambda x: (-x[1], x[0]))
        row = [TaskContext.get().partitionId()], [[_hash(p) for p, _ in top]], [[n for _, n in top]], [[p for p, _ in top]]
        yield pa.RecordBatch.from_pydict(dict(zip(_SUMMARY.names, row)), _SUMMARY)

    few = docs.select(text_col).coalesce(SUMMARIES * docs.sparkSession.sparkContext.defaultParallelism)
    summaries = cut_lineage(few.mapInArrow(summarise, "part int, hashes array<long>, counts array<long>, pieces array<string>"))
    parts = (summaries.agg(F.max("part")).head()[0] or 0) + 1
    merged = summaries.select("part", "hashes", "counts", F.transform("hashes", lambda h: F.col("part")).alias("sources"))
    while True:
        merged = merged.groupBy(F.floor(F.col("part") / _FAN)).applyInArrow(lambda rows: _merge(rows, size), "part int, hashes array<long>, counts array<long>, sources array<int>")
        parts = -(-parts // _FAN)
        if parts == 1:
            break
    found = merged.select("hashes", "counts", "sources").collect()  # one row of `size` hashes
    if not found:
        return []
    counts, wanted = dict(zip(found[0].hashes, found[0].counts)), {}
    for h, part in zip(found[0].hashes, found[0].sources):
        wanted.setdefault(part, set()).add(h)
    named = docs.sparkSession.sparkContext.broadcast(wanted)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, pieces in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "pieces"))):
                own = named.value.get(part, ())
                kept = {h: p for h, p in zip(hashes, pieces) if h in own}
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.string())], schema=_STRINGS)

    rows = summaries.select("part", "hashes", "pieces").mapInArrow(strings, "hash long, piece string").collect()  # `size` strings, one a hash
    return [r.piece for r in sorted(rows, key=lambda r: (-counts[r.hash], r.piece))]


#: Byte lengths up to which pieces are merged many at once, as rows of one matrix each.
_ROWS = (8, 16, 32)


class LengthCounter:
    """Counts tokens in one process: pre-tokens' lengths from the table, else from this worker's caches, else merged."""

    def __init__(self, vocabulary: Vocabulary, table: dict[str, int]) -> None:
        self.encoder, self.v, self.table = Encoder(vocabulary), vocabulary, table
        blank = "" if vocabulary.lower else " "
        # What stands between two blanks and is one pre-token, with the blank before it, is found in the table without being cut.
        self.whole = {p[len(blank) :]: n for p, n in table.items() if len(p) > len(blank) and p.startswith(blank) and self.encoder.pieces(p) == [p]}
        self.of_piece, self.of_chunk = Cache(size=CACHE_BYTES), Cache(size=CACHE_BYTES)
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in vocabulary.merges.items())
        self.pairs, self.ranks, self.new = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([-1], [0], [0])))
        self.first, self.last = np.array(vocabulary.first, np.int64), np.array(vocabulary.last, np.int64)

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of symbols stands among the merges, and its rank, one beyond all for no merge or padding."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return at, np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], len(self.ranks))

    def _merged(self, data: list[bytes], width: int) -> np.ndarray:
        """Tokens of each of ``data``, none empty or longer than ``width`` bytes: each round merges every row's best pair."""
        n, rows = len(data), np.arange(len(data))
        length = np.array([len(x) for x in data])
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in data]), np.uint8).reshape(n, width)
        symbols = np.where(np.arange(width) < length[:, None], self.first[raw], -1)
        symbols[rows, length - 1] = self.last[raw[rows, length - 1]]
        symbols = np.concatenate([symbols, np.full((n, 1), -1)], axis=1)
        rank, column = self._places(symbols[:, :-1], symbols[:, 1:])[1], np.arange(width + 1)
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost one of a rank
            live = rank[np.arange(len(rows)), best] < len(self.ranks)
            rows, best, symbols, rank = rows[live], best[live], symbols[live], rank[live]
            here = np.arange(len(rows))
            length[rows] -= 1
            at = self._places(symbols[here, best], symbols[here, best + 1])[0]
            moved = column > best[:, None]
            symbols = np.where(moved, np.concatenate([symbols[:, 1:], np.full((len(rows), 1), -1)], axis=1), symbols)
            rank = np.where(moved[:, :-1], np.concatenate([rank[:, 1:], np.full((len(rows), 1), len(self.ranks))], axis=1), rank)
            symbols[here, best] = self.new[at]
            rank[here, best] = self._places(symbols[here, best], symbols[here, best + 1])[1]
            before = np.maximum(best - 1, 0)
            rank[here, before] = np.where(best > 0, self._places(symbols[here, before], symbols[here, before + 1])[1], rank[here, before])
        return length

    def piece_lengths(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each of these pre-tokens."""
        data = [p.encode("utf-8", "replace") for p in pieces]
        out, least = {}, 0
        for width in _ROWS:
            some = [i for i, d in enumerate(data) if least < len(d) <= width]
            if some:
                out.update(zip([pieces[i] for i in some], self._merged([data[i] for i in some], width).tolist()))
            least = width
        out.update({p: len(self.encoder.piece_ids(p)) for p, d in zip(pieces, data) if len(d) > least})
        return out

    def _pieces(self, chunks: list[str], before: str) -> list[list[str]]:
        """Each chunk's pre-tokens."""
        cut = self.encoder.pieces
        return [[before + c] if c.isascii() and c.isalpha() else cut(before + c) for c in chunks]

    def _new_chunks(self, chunks: list[str], before: str) -> list[int]:
        """Tokens of each of these distinct chunks."""
        pieces = self._pieces(chunks, before)
        lengths, missing = {}, []
        table, recent, older = self.table, self.of_piece, self.of_piece.before
        for p in set().union(*pieces):
            n = table.get(p) or recent.get(p) or older.get(p)
            if n:
                lengths[p] = n
            else:
                missing.append(p)
        new = self.piece_lengths(missing)
        self.of_piece.keep_all(new)
        lengths |= new
        get = lengths.__getitem__
        return [sum(map(get, p)) for p in pieces]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        encoder, special, parts, firsts, rests = self.encoder, [], [], [], []
        for text in texts:
            cut = encoder.segments(text or "")
            special.append(len(cut) // 2)
            chunks = [encoder.chunks(encoder.normalize(x) if self.v.lower else x) for x in cut[::2] if x]
            parts.append((len(chunks), sum(map(len, chunks)) - len(chunks)))
            for c in chunks:
                firsts.append(c[0])
                rests += c[1:]
        starts = list(set(firsts))
        of_start = dict(zip(starts, self._new_chunks(starts, "")))
        blank, cache = "" if self.v.lower else " ", self.of_chunk
        lengths = list(map(self.whole.get, rests))
        places = [i for i, n in enumerate(lengths) if n is None]
        if places:
            found, missing, older = {}, [], cache.before
            for c in {rests[i] for i in places}:
                if n := cache.get(c) or older.get(c):
                    found[c] = n
                else:
                    missing.append(c)
            found.update(zip(missing, self._new_chunks(missing, blank)))
            for i in places:
                lengths[i] = found[rests[i]]
            cache.keep_all(found)
        sums = []
        for n, many in zip(([of_start[c] for c in firsts], lengths), np.array(parts, np.int64).reshape(-1, 2).T):
            upto, ends = np.cumsum(np.array([0, *n], np.int64)), np.cumsum(many)
            sums.append(upto[ends] - upto[ends - many])
        return np.array(special, np.int64) + sums[0] + sums[1]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", table: list[str] | None = None) -> Column:
    """Number of tokens of each whole text, as the file's own library counts without added special tokens.

    Null and empty texts have 0. Special tokens written out inside a text count as one, the library's default. ``table`` lists
    the pre-tokens of the first tier; by default the frequent ones of ``docs`` are found by a pass over all of it.
    """
    vocabulary = Vocabulary.load(path)
    pieces = frequent_pieces(docs, text_col, path) if table is None else table
    lengths = LengthCounter(vocabulary, {}).piece_lengths(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, lengths))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, table = shared.value
        counter = kept_in_worker(f"{vocabulary.key} lengths", lambda: LengthCounter(vocabulary, table))
        for batch in slices(batches):
            yield pa.array(counter.counts(batch.to_pylist()))

    return count(F.col(text_col))
