"""Quality rules whose thresholds adapt to each language and source.

Each document gets a few ratios as whole numbers (such as per mille of words). Their distribution in every language and source is
summed up in a quantile sketch with bins of bounded relative width, as in DDSketch (Masson et al., 2019): a value counts in the bin of
its leading ``BITS`` binary digits. Bins add up, so sketches of parts merge exactly, in any order and number; a quantile's rank is exact, and
its value is too low by less than one part in ``2 ** (BITS - 1)``. A sketch has at most ``64 * 2 ** (BITS - 1)`` bins, and no value is clipped.

Fences come from quantiles of these sketches, for everything, each language, and each source in a language. A group's own fence and its
parent's are averaged, by its documents and ``PRIOR``: groups with few documents lean on their parent, without a switch. As a group full of
junk would lift its own fences, a fence lies at most ``REACH`` times as far from the parent's median as the parent's own fence does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, slices, small_side

_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Metric:
    """A ratio in whole units. Its fence lies ``stretch`` times as far from the median as the ``percent`` quantile does.

    ``least`` is the smallest distance that counts, so that a group in which nearly all are alike doesn't reject small deviations.
    Fences of percentages above 50 are upper ones.
    """

    name: str
    value: str
    percent: int
    stretch: int
    least: int

    @property
    def sign(self) -> int:
        return 1 if self.percent > 50 else -1


#: Symbols per word, repeated lines per line, words in repeated windows per word, all per mille; tenths of characters per word.
METRICS = (
    Metric("symbols", "symbols", 90, 3, 30), Metric("dup_lines", "dup_lines", 99, 3, 40), Metric("repeats", "repeats", 99, 3, 40),
    Metric("long_words", "chars", 90, 5, 4), Metric("short_words", "chars", 5, 5, 3),
)
#: Binary digits of a value that its bin keeps.
BITS = 8
#: Documents that a parent's fence counts for in its children's.
PRIOR = 50
#: How many times as far as the parent's own fence a fence may lie from the parent's median.
REACH = 1.5
#: Lines and words that every text is taken to have besides its own, without repeats, so that one repeat in few is not much.
MORE_LINES, MORE_WORDS = 5, 50


def _repeated(words: list[bytes]) -> int:
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "replace").split()
    if not words:
        return (0,) * 6
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)] if "\n" in text else [text]
    chars = len(text) - sum(map(text.count, _BLANKS))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeated(words)


def text_stats(text: Column) -> Column:
    """Counts of a whole text as a struct; all 0 for null and wordless texts.

    Words are runs of characters other than the six ASCII white-space characters; a line counts if it has a word;
    ``n_dup_lines`` are lines equal to an earlier one; ``n_repeat_words`` are the words covered by three-word windows that
    occur more than once, the first occurrence included.
    """

    @F.arrow_udf(_STATS)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in _STATS.split(", ")]
        for batch in slices(batches):
            columns = list(zip(*map(_stats, batch.to_pylist()))) or [()] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return stats(text)


def base_failed(s: Column) -> Column:
    """The fixed rules: fewer than 50 words, or over half of the words in repeated windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _values(s: Column) -> dict[str, Column]:
    ratio = lambda a, b, unit: F.floor(F.lit(unit) * a / F.greatest(b, F.lit(1))).cast("long")
    return {
        "symbols": ratio(s["n_symbols"], s["n_words"], 1000),
        "dup_lines": ratio(s["n_dup_lines"], s["n_lines"] + MORE_LINES, 1000),
        "repeats": ratio(s["n_repeat_words"], s["n_words"] + MORE_WORDS, 1000),
        "chars": ratio(s["word_chars"], s["n_words"], 10),
    }


def _group(c: Column) -> Column:
    """A group's name that tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def bin_of(value: str) -> Column:
    """The least value with the same leading ``BITS`` binary digits as the one in column ``value``."""
    cut = f"greatest(length(bin({value})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {cut}), {cut})")


def quantile_sketches(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sketches (by, metric, bin, n) of rows (by, metric, value)."""
    return merged(values.select(*by, "metric", bin_of("value").alias("bin"), F.lit(1).cast("long").alias("n")), by)


def merged(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One sketch for each ``by`` from any number of partial ones."""
    return sketches.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))


def _quantiles(own: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """(g_lang, g_source, and for each metric a struct of n, median and own fence) for each source, each language (g_source null) and everything."""
    levels = [[], ["g_lang"], ["g_lang", "g_source"]]
    sets = [[F.col(c) for c in ("metric", "bin", *by)] for by in levels]
    every = own.groupingSets(sets, "metric", "bin", "g_lang", "g_source").agg(F.sum("n").alias("n"))
    group = W.partitionBy("g_lang", "g_source", "metric")  # as many rows as a sketch has bins
    ranked = every.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bin")))
    found = ranked.groupBy("g_lang", "g_source", "metric").agg(F.max("total").alias("n"), at(50).alias("median"), *[at(p).alias(f"q{p}") for p in sorted({m.percent for m in metrics})])
    columns = []
    for m in metrics:
        far = F.greatest(m.sign * (F.col(f"q{m.percent}") - F.col("median")), F.lit(m.least))
        fence = F.struct("n", "median", (F.col("median") + m.sign * m.stretch * far).cast("double").alias("fence"))
        columns.append(F.max(F.when(F.col("metric") == m.value, fence)).alias(m.name))
    return found.groupBy("g_lang", "g_source").agg(*columns)


def fences(own: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(g_lang, g_source, one fence per metric) for each group of the sketches (g_lang, g_source, metric, bin, n)."""
    found = cut_lineage(_quantiles(own, metrics))
    above = found.where("g_lang IS NULL").drop("g_lang", "g_source")
    for own_keys, on in ((F.col("g_lang").isNotNull() & F.col("g_source").isNull(), []), (F.col("g_source").isNotNull(), ["g_lang"])):
        up = above.select(*on, *[F.col(m.name).alias(f"{m.name}_above") for m in metrics])
        found_here = found.where(own_keys)
        joined = found_here.join(small_side(cut_lineage(up)), on) if on else found_here.join(F.broadcast(up), F.lit(True))  # one row for everything
        for m in metrics:
            x, parent = F.col(m.name), F.col(f"{m.name}_above")
            fence = (x["n"] * x["fence"] + PRIOR * parent["fence"]) / (x["n"] + PRIOR)
            bound = parent["median"] + REACH * (parent["fence"] - parent["median"])
            fence = F.least(fence, bound) if m.sign > 0 else F.greatest(fence, bound)
            joined = joined.withColumn(m.name, F.struct(x["n"].alias("n"), x["median"].alias("median"), fence.alias("fence")))
        above = joined.select("g_lang", *(["g_source"] if on else []), *[m.name for m in metrics])
    return cut_lineage(above.select("g_lang", "g_source", *[F.col(m.name)["fence"].alias(m.name) for m in metrics]))


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, **carried: Column) -> DataFrame:
    """(the ``carried`` columns, stats, base_failed, kept) for every row of ``docs``, each row by its own counts."""
    rows = docs.select(*[c.alias(name) for name, c in carried.items()], text_stats(F.col(text_col)).alias("stats"), _group(F.col(lang_col)).alias("g_lang"), _group(F.col(source_col)).alias("g_source"))
    rows = cut_lineage(rows.withColumn("base_failed", base_failed(F.col("stats"))))
    values = _values(F.col("stats"))
    long = rows.where(~F.col("base_failed")).select("g_lang", "g_source", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("metric", "value"))
    limits = fences(cut_lineage(quantile_sketches(long, ("g_lang", "g_source"))))
    out = rows.join(small_side(limits), ["g_lang", "g_source"], "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.coalesce(m.sign * values[m.value] <= m.sign * F.col(m.name), F.lit(True))
    return out.select(*carried, "stats", "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, the counts of ``text_stats``, base_failed, kept) for every row of ``docs``.

    Fences are learnt from all rows that pass the fixed rules; rows on or inside all fences of their language and source are kept.
    Nulls in language or source form groups of their own. Rows with repeated or null ids are judged one by one. An empty table gives
    an empty result.
    """
    out = _judged(docs, text_col, lang_col, source_col, id=F.col(id_col))
    return out.select(F.col("id").alias(id_col), "stats.*", "base_failed", "kept")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the fixed rules and their group's fences, columns as they are.

    Each row goes by its own verdict, whatever its id; the row travels with its counts, so nothing is joined by id.
    """
    return _judged(docs, text_col, lang_col, source_col, row=F.struct("*")).where("kept").select("row.*")
