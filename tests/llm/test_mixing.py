import hashlib
import re

import pytest

from fieldloom.llm.mixing import mix_plan, mix_rows


def order(doc_id):
    return hashlib.md5(f"17:{'' if doc_id is None else doc_id}".encode()).hexdigest()


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, limit=2):
    """Share out, stop at the limits, share the excess of the stopped among the rest, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= limit * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def rows():
    out = [(i, " ".join(["w"] * (i % 7 * 3)), ["a", "b", None, "é", "hot", "hot", "hot"][i % 7], i) for i in range(900)]
    return out + [(9000, None, "a", 1), (9001, "", "empty", 2), (9002, " \n", "empty", 3), (9003, "x " * 40000, "long", 4), (None, "one two three", "b", 5)]


@pytest.mark.parametrize("rows_per_range", [1, 20, 1000])
def test_plan_against_brute_force(spark, rows_per_range):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size long").repartition(5)
    got = {r.doc_id: r for r in mix_plan(df, rows_per_range=rows_per_range).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows()}
    source = {i: s for i, _, s, _ in rows()}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    targets = brute_targets(sizes)
    for s, total in sizes.items():
        budget = int(targets[s] + 0.5)
        epochs, rest = divmod(budget, total) if total else (0, 0)
        for i in sorted((i for i in size if source[i] == s), key=order):
            taken = epochs * size[i] + min(size[i], rest)
            rest -= min(size[i], rest)
            assert (got[i].size, got[i].source_size, got[i].taken) == (size[i], total, taken), i
            assert got[i].target == pytest.approx(targets[s]) and taken <= 2 * size[i]


def test_equal_sources_share_by_weight(spark):
    df = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    plan = {r.source_size: None for r in mix_plan(df).collect()}
    assert plan == {400: None}
    by = {}
    for r in mix_plan(df).collect():
        by.setdefault(round(r.target, 6), 0)
        by[round(r.target, 6)] += r.taken
    assert by == {800.0: 800, round(1000 * 2 / 3, 6): 667, round(1000 / 3, 6): 333}


def test_rows_hold_the_taken_words(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, words long").repartition(3)
    plan = {r.doc_id: r.taken for r in mix_plan(df).collect()}
    mixed = mix_rows(df)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: n for i, n in plan.items() if n}


def test_a_cut_copy_keeps_its_white_space(spark):
    text = "\n  one\ttwo  three\n\nfour five\u00a0six "
    df = spark.createDataFrame([(1, text, "s", -7, "m")], "doc_id long, text string, source string, words long, mix string")
    for share, want in ((1.2, "\n  one"), (1.4, "\n  one\ttwo"), (1.6, "\n  one\ttwo  three"), (1.8, "\n  one\ttwo  three\n\nfour")):
        got = mix_rows(df, share=share).collect()
        assert sorted(r.text for r in got) == sorted([text, want]) and all((r.words, r.mix) == (-7, "m") for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(df).count() == 0 and mix_rows(df).count() == 0


@pytest.mark.parametrize("ids", [lambda i: None if i % 3 == 0 else i, lambda i: None, lambda i: i % 4])
@pytest.mark.parametrize("same_text", [False, True])
def test_rows_that_share_an_id_are_cut_one_by_one(spark, ids, same_text):
    """900 rows of 100 words: the cut falls within the rows that share an id, and the target is met to the word."""
    texts = [" ".join([f"w{0 if same_text else i}"] * 100) for i in range(900)]
    df = spark.createDataFrame([(ids(i), t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    for rest in (45_050, 74_950, 89_000):
        how = {"share": 1 + rest / 90_000, "rows_per_range": 10}
        taken = sorted(r.taken for r in mix_plan(df, **how).collect())
        whole, part = divmod(rest, 100)
        assert taken == sorted([200] * whole + [100 + part] * (part > 0) + [100] * (900 - whole - (part > 0)))
    assert sum(len(r.text.split()) for r in mix_rows(df, **how).collect()) == 90_000 + rest
