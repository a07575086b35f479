"""Mixing sources to target weights, with DataFrame functions only.

Targets come from filling up: each source gets its weight's share until it meets its limit, and what it leaves goes to the
others by weight. Rows of a source are ordered by a hash of their id, and rows that share that by a hash of their text. A source's
order is cut into ranges of that hash, a fixed number of them; the ranges' word counts and their running sums tell in which range the
source's budget ends, and that range is cut again, until it holds few rows, which are sorted to find the exact row and word. Every row
then compares its hash with its source's cut, so documents are not shuffled, and a source with most of the rows is as evenly spread
as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import SPACE, cut_lineage, scratch, size_words, small_side

WEIGHTS = (5.0, 2.0, 1.0)


#: Hexadecimal digits of a hash, of which an order has three, and how many of them tell ranges apart in one pass.
_HASH, _DIGITS = 32, 2
#: Ends of the digits that a pass looks at; past four passes into one hash only ties are left, which the next hash tells apart.
_PASSES = tuple(start * _HASH + _DIGITS * i for start in range(3) for i in range(1, 5))


def _order(id_col: Column, text_col: Column, seed: int) -> Column:
    """A hash-random key of each row: by id, the same in every run and engine, then by text, then by a number of the row.

    It has to be stored where it is read more than once, as the number may differ when it is computed again.
    """
    parts = [F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), F.coalesce(text_col, F.lit("")), F.monotonically_increasing_id().cast("string")]
    return F.concat(*map(F.md5, parts))


def mix_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """(source, size) with ``source_size`` and ``target`` words of each source.

    Sources in order of code points, null last, take the weights in turn. Targets add up to ``share`` of all words;
    none exceeds ``limit`` times its source's size. One row for each source, so one small task suffices.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    full = (limit * F.col("source_size")).cast("double")
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = (
        sizes.withColumn("weight", by_weight)
        .withColumn("ratio", full / F.col("weight"))
        .withColumn("level", (F.lit(share) * total - filled) / rest)
    )
    # The first source in order of its limit by weight that the level doesn't reach sets the level of all after it.
    first = F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))
    open_ = F.first(first, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(open_.isNull() | (F.col("ratio") < open_["ratio"]), full).otherwise(F.least(full, open_["level"] * F.col("weight")))
    return ranked.select("source", "n_rows", "source_size", target.alias("target"))


def mix_cuts(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: int = 2, rows_per_range: int = 1000) -> DataFrame:
    """For each source of rows (source, size, order): size, target, whole epochs, and where its last epoch ends.

    ``sized`` is stored, and no two rows have one ``order``.
    A row takes ``epochs`` times its size, and once more if its ``order`` is below ``cut``; at the cut it takes ``cut_words``.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = mix_targets(sizes, weights, share, limit).withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    targets = cut_lineage(targets)

    here = F.col("source").eqNullSafe(F.col("of")) & F.expr("startswith(`order`, last)")
    ends = targets.where("rest > 0").select(F.col("source").alias("of"), "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("last"), F.col("n_rows").alias("n"))
    for length in _PASSES:
        if ends.where(F.col("n") > 4 * rows_per_range).isEmpty():
            break
        ranged = sized.join(small_side(ends), here).withColumn("range", F.expr(f"substring(`order`, 1, {length})"))
        sums = ranged.groupBy("of", "rest", "before", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        lower = F.coalesce(F.sum("words").over(W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", F.col("before") + lower)
        ends = sums.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
        ends = cut_lineage(ends.select("of", "rest", "before", F.col("range").alias("last"), "n"))
    last = sized.join(small_side(ends), here)
    upto = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("order").rowsBetween(W.unboundedPreceding, 0))
    words = last.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
    cut = words.groupBy("source").agg(F.min(F.struct("order", (F.col("rest") - F.col("upto") + F.col("size")).alias("cut_words"))).alias("at"))
    cut = cut.select(F.col("source").alias("of"), F.col("at.order").alias("cut"), "at.cut_words")
    return cut_lineage(
        targets.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "epochs", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("cut_words", F.lit(0)).cast("long").alias("cut_words")
        )
    )


def _taken(size: Column, order: Column) -> Column:
    once = F.when(order < F.col("cut"), size).when(order == F.col("cut"), F.least(size, F.col("cut_words"))).otherwise(F.lit(0))
    return (F.col("epochs") * size + once).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row: the words that the mix takes of it, repeats counted.

    Null texts and wordless texts have size 0 and are never taken; a null source is a source like any other. A row takes at
    most ``limit`` times its size. Rows without an id or with a repeated one stand together in the order, by a hash of their text.
    """
    order = _order(F.col(id_col), F.col(text_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_words(F.col(text_col)).alias("size"), order.alias("order"))
    rows = cut_lineage(rows)
    cuts = mix_cuts(rows.select("source", "size", "order"), **how).withColumnRenamed("source", "of")
    found = rows.join(small_side(cuts), F.col("source").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(F.col("size"), F.col("order")).alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns as they are; a last, partial copy has its first words only.

    White space between those words stays as it is. Documents that the mix takes no word of, wordless ones included, are left out.
    """
    order = _order(F.col(id_col), F.col(text_col), seed)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), size_words(F.col(text_col)).alias("size"), order.alias("order"))
    rows = cut_lineage(rows)
    cuts = mix_cuts(rows.select("source", "size", "order"), **how)
    cuts = small_side(cuts.select(F.struct(*cuts.columns).alias("mix")))
    found = rows.join(cuts, F.col("source").eqNullSafe(F.col("mix.source")))
    m, size, order = F.col("mix"), F.col("size"), F.col("order")
    once = F.when(order < m["cut"], size).when(order == m["cut"], F.least(size, m["cut_words"])).otherwise(F.lit(0))
    copies = F.array_repeat(F.lit(-1).cast("long"), m["epochs"])
    part = F.when(once >= size, F.array(F.lit(-1).cast("long"))).when(once > 0, F.array(once.cast("long"))).otherwise(F.array().cast("array<long>"))
    (words,) = scratch(docs.columns, "words")
    found = found.where(size > 0).select("row.*", F.explode(F.concat(copies, part)).alias(words))
    # Each piece is a word and the white space after it; a text's leading white space is a piece of its own.
    pieces = F.split(F.col(text_col), f"(?<=[{SPACE}])(?=[^{SPACE}])")
    leading = F.col(text_col).rlike(f"^[{SPACE}]").cast("int")
    prefix = F.rtrim(F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int") + leading), ""), F.lit(" \t\n\x0b\x0c\r"))
    text = F.when(F.col(words) < 0, F.col(text_col)).otherwise(prefix)
    return found.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
