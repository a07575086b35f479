import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm.quality import BITS, METRICS, merged, quality_filter, quality_verdicts, quantile_sketches


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if counts[g] > 1 for o in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "") if words else 0
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "a b c a b c", "one two\none two\n\nthree", "x\u00a0y z", "# * $ & | < >", "a\x0bb\x0cc\rd", "é 日本 🙂",
    "a a a a a a", "w " * 30000, " ".join(f"w{i}" for i in range(60)), "same line here\n" * 40, "a b c d a b c", "\x1c\x1d a",
]


def test_counts_against_brute_force(spark):
    rows = [(i, t, "en", None, i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, stats long").repartition(3)
    got = {r.doc_id: r for r in quality_verdicts(df).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), repr(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


SCHEMA = "doc_id long, text string, lang string, source string"


def plain(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_fences_follow_the_source(spark):
    """Repeated lines that are usual in one source are rejected in another."""
    lines = lambda i, n, again: "\n".join([plain(f"{i}l{k}", 8) for k in range(n - again)] + [plain(f"{i}l0", 8)] * again)
    rows = [(i, lines(i, 30, 0), "en", "prose") for i in range(400)] + [(1000 + i, lines(i, 30, i % 12), "en", "forum") for i in range(400)]
    rows += [(5000, lines("a", 40, 15), "en", "prose"), (5001, lines("b", 40, 13), "en", "forum"), (5002, lines("c", 30, 1), None, None), (None, lines("d", 30, 2), "en", "prose")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in quality_verdicts(df).collect()}
    assert not got[5000] and got[5001] and got[5002] and got[None]
    assert all(got[i] for i in range(400)) and all(got[1000 + i] for i in range(400))
    kept = quality_filter(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 1


def test_a_source_full_of_junk_does_not_lift_its_fences(spark):
    """Symbols in two fifths of a source: its own quantiles are junk, its language's are not."""
    rows = [(i, plain(i, 80), "en", "good") for i in range(600)]
    rows += [(1000 + i, plain(i, 60) + " #" * 60 * (i % 5 < 2), "en", "bad") for i in range(100)]
    got = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(600))
    assert all(got[1000 + i] == (i % 5 >= 2) for i in range(100))


def test_sketches_merge_in_any_order(spark):
    """Parts merged in any grouping and order are the sketch of all; ranks are exact and values within their bins."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 50, 300), (10 ** rng.uniform(0, 9, 700)).astype(int), [0, 127, 128, 255, 256, 2**40]])
    rows = spark.createDataFrame([(int(i % 7), "m", int(v)) for i, v in enumerate(values)], "part int, metric string, value long")
    by_part = quantile_sketches(rows, ("part",))
    whole = quantile_sketches(rows, ())
    table = lambda df: sorted((r.bin, r.n) for r in df.collect())
    first = by_part.where("part < 3")
    again = merged(first, ()).unionByName(by_part.where("part >= 3").drop("part").orderBy(F.rand(1)))
    assert table(merged(by_part, ())) == table(merged(again, ())) == table(whole)
    bins = np.repeat(*np.array(table(whole)).T)
    exact = np.sort(values)
    assert len(bins) == len(values) and (bins <= exact).all() and (exact - bins <= exact / 2 ** (BITS - 1)).all()
    assert len(table(whole)) <= 64 * 2 ** (BITS - 1)


def test_empty_table_and_few_rows(spark):
    schema = SCHEMA
    assert quality_verdicts(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(55)), "en", "s")] * 2, schema)
    assert [r.kept for r in quality_verdicts(few).collect()] == [True, True]
    assert {m.name for m in METRICS} >= {"symbols", "repeats"}


def test_filter_judges_each_row_by_itself(spark):
    """Rows that share an id with a rejected one, or have none as a rejected one has, stay."""
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, good(i), "en", "s", 2 * i) for i in range(150)] + [(None, good(1000 + i), "en", "s", i) for i in range(20)]
    rows += [(None, "too short", "en", "s", -1), (7, "too short", "en", "s", -2), (7, good(3000), "en", "s", -3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long")
    kept = quality_filter(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where("text <> 'too short'").collect()))


def test_fences_adapt_at_every_size(spark):
    """What is usual in a forum is rejected in prose of 100, 400 or 2,000 documents; a source of few documents leans on its language."""
    lines = lambda i, n, again: "\n".join([plain(f"{i}l{k}", 8) for k in range(n - again)] + [plain(f"{i}l0", 8)] * again)
    for size in (5, 100, 400, 2000):
        rows = [(i, lines(i, 30, 0), "en", "prose") for i in range(size)] + [(10_000 + i, lines(i, 30, i % 9), "en", "forum") for i in range(400)]
        rows += [(5000, lines("a", 40, 15), "en", "prose"), (5001, lines("b", 40, 10), "en", "forum")]
        got = {r.doc_id: r.kept for r in quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got[5001] and all(got[i] for i in range(size)) and all(got[10_000 + i] for i in range(400))
        assert got[5000] == (size == 5), size
