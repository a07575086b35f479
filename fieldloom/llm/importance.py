"""Importance resampling of documents towards the distribution of a target corpus (Xie et al., 2023).

A text's features are its word runs of one to three words, hashed into ``BUCKETS`` buckets. Each bucket's gain is the smoothed
log-ratio of its share in the target to its share in the documents; a document's weight adds up the gains of its features, looked
up in one array. Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

Which rows are drawn is decided by numbers alone: the scores are stored, and exact counts above thresholds bisect the range of the
score, then, among rows tied there, that of the id, then that of a stored row number. Only counts reach the driver. Drawn rows are
dealt into ranges of their order, so a rank is the row's place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, scratch, slices

BUCKETS = 10_000
#: Words in the longest feature.
RUN = 3
#: Halvings of the range that one counting job decides.
HALVINGS = 4

#: Letters A-Z become a-z, the other ASCII characters but digits and a-z become blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words: runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def feature_hashes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of every run of one to ``RUN`` words joined by a blank; a run's hash goes on from that of the run without its last word."""
    found = np.empty(sum(max(0, len(words) - n) for n in range(RUN)), np.uint32)
    hashes, at = list(map(crc32, words)), 0
    found[: len(words)] = hashes
    blanked = [b" " + w for w in words]
    for n in range(1, RUN):
        at += len(hashes)
        hashes = list(map(crc32, blanked[n:], hashes))
        found[at : at + len(hashes)] = hashes
    return found


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends one row a bucket, whatever it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(b.column(0) for b in batches):
            for text in part.to_pylist():
                total += np.bincount(feature_hashes(words_of(text)) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS, np.int64)
    for r in rows:  # BUCKETS rows at most
        found[r.bucket] = r.n
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log-ratio of target to source in whole thousandths; every bucket counts one more than it holds."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def importance_weight(docs: DataFrame, text: Column, gains: np.ndarray) -> Column:
    """Struct (n_words, n_features, weight) of a whole text; zeros for null and wordless ones."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS longs
    names = ["n_words", "n_features", "weight"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            out = []
            for t in batch.to_pylist():
                words = words_of(t)
                hashes = feature_hashes(words)
                out.append((len(words), len(hashes), int(shared.value[hashes % BUCKETS].sum())))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3, names)

    return weigh(text)


def gumbel_score(weight: Column, id_col: Column, seed: int) -> Column:
    """The weight plus Gumbel noise in thousandths, from the SHA-256 of seed and id; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def highest(rows: DataFrame, column: str, wanted: int) -> tuple[int, int] | None:
    """(cutoff, number above it): the ``wanted`` highest of a non-null whole-number column are those above the cutoff and some equal to it.

    Bisection: every job counts exactly how many rows reach each of the thresholds that ``HALVINGS`` halvings of the range may ask for.
    None if nothing is wanted or there are no rows.
    """
    low, top = rows.agg(F.min(column), F.max(column)).first()
    if low is None or wanted < 1:
        return None
    # Invariant: at least `wanted` rows reach `low`, fewer reach `high`, or all rows are wanted.
    high, above = top + 1, 0
    while high - low > 1:
        steps = min(1 << HALVINGS, high - low)
        cuts = [low + (high - low) * i // steps for i in range(1, steps)]
        counts = rows.agg(*[F.count(F.when(F.col(column) >= c, 1)) for c in cuts]).first()
        reached = sum(n >= wanted for n in counts)  # counts fall along the cuts
        if reached < len(cuts):
            high, above = cuts[reached], counts[reached]
        if reached:
            low = cuts[reached - 1]
    return low, above


def _drawn(rows: DataFrame, wanted: int, order: list[str]) -> Column:
    """Whether a row is among the ``wanted`` first by the columns of ``order``, each the higher the better, unique together."""
    chosen, tied = F.lit(False), F.lit(True)
    for column in order:
        found = highest(rows.where(tied), column, wanted)
        if found is None:
            break
        cutoff, above = found
        chosen = chosen | (tied & (F.col(column) > cutoff))
        tied, wanted = tied & (F.col(column) == cutoff), wanted - above
        if rows.where(tied).count() <= wanted:
            return chosen | tied
    return chosen


def scored_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42, **carried: Column) -> DataFrame:
    """(row, id, the ``carried`` columns, n_words, n_features, weight, score), stored; ``row`` numbers the rows."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    weighed = docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in carried.items()], importance_weight(docs, F.col(text_col), gains).alias("w"))
    numbered = weighed.select(F.monotonically_increasing_id().alias("row"), "id", *carried, "w.*")
    return cut_lineage(numbered.withColumn("score", gumbel_score(F.col("weight"), F.col("id"), seed)))


def ranked_draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """``scored`` rows with ``rank``: 1, 2, .. for the ``percent`` of the rows with ``least_words`` words or more that score highest, else null.

    Ties go to the smaller id, null ids last, then to the earlier row.
    """
    # Whole numbers, higher ones first; ``~id`` falls as the id rises, without an overflow.
    low_id = F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit(0))
    marked = scored.select("*", F.col("id").isNotNull().cast("int").alias("has_id"), low_id.alias("low_id"), F.bitwise_not("row").alias("early"))
    order = ["score", "has_id", "low_id", "early"]
    fit = cut_lineage(marked.where(F.col("n_words") >= least_words).select(*order))  # numbers only, as it is read for every count
    marked = marked.withColumn("drawn", (F.col("n_words") >= least_words) & _drawn(fit, percent * fit.count() // 100, order))
    spread = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.desc(c) for c in order]
    ranged = marked.where("drawn").repartitionByRange(spread, *keys).sortWithinPartitions(*keys)
    ranged = cut_lineage(ranged.select(*scored.columns, F.monotonically_increasing_id().alias("place")))  # range, place in the range
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)])])
    rank = F.element_at(F.lit([int(n) for n in before]), part.cast("int") + 1) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.select(*scored.columns, rank.cast("long").alias("rank")).unionByName(marked.where("NOT drawn").select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(id_col, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null where the row is not drawn.

    ``target`` has its texts in ``text_col`` too; null texts have no words on either side, weigh 0 and are never drawn. Repeated ids keep a
    row each, with the same noise; of rows alike in score and id the earlier one ranks first. Null ids come after all others of a
    score. Other columns are not looked at. Without target texts the gains compare with an even spread; an empty table gives an empty result.
    """
    ranked = ranked_draw(scored_documents(docs, target, id_col, text_col, text_col, seed), percent, least_words)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, rank_col: str | None = None) -> DataFrame:
    """The drawn rows of ``docs``, columns as they are, whatever their names, with their rank in ``rank_col`` if it is named."""
    scored = scored_documents(docs, target, id_col, text_col, text_col, seed, kept=F.struct("*"))
    drawn = ranked_draw(scored, percent, least_words).where("rank IS NOT NULL")
    out = drawn.select("kept.*", F.col("rank").alias(scratch(docs.columns, "rank")[0]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([F.col(f"`{out.columns[-1]}`").alias(rank_col)] if rank_col else []))
