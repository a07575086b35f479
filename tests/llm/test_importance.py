import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from fieldloom.llm import importance
from fieldloom.llm.importance import feature_hashes, highest, importance_ranks, importance_resample, ranked_draw, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """(n_features, weight, score, rank) of each row (id, text), by the formulas."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(h % 10000 for h in features(text))
    for text in target:
        t.update(h % 10000 for h in features(text))
    total, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % 10000] for x in f)
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((i for i in range(len(docs)) if len(words(docs[i][1])) >= 20), key=lambda i: (-out[i][2], docs[i][0] is None, docs[i][0] or 0))
    for place, i in enumerate(fit[: 5 * len(fit) // 100]):
        out[i][3] = place + 1
    return out


TEXTS = [None, "", " .,;", "One", "a-b_c d\x7fe", "ÀÉ x y İ 日本 🙂 ABC123", "a a a a a", "tab\tnew\nline", "\x00 w"]


def test_words_and_hashes():
    for text in TEXTS:
        assert words_of(text) == [w.encode() for w in words(text)]
        assert feature_hashes(words_of(text)).tolist() == features(text)


def test_ranks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary[: rng.choice([50, 300])], k=rng.choice([5, 19, 20, 60])))) for i in range(700)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(2000, "long " * 40000), (-5, "below zero " * 30), (2**63 - 1, "last " * 21), (-(2**63), "first " * 21), (None, "nobody " * 25)]
    target = [None, "", " ".join(vocabulary[:50]), "w1 w2 w3 W1", "elsewhere"]
    schema = "doc_id long, text string, score long, rank string, id int"
    df = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in docs], schema).repartition(5)
    marks = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in importance_ranks(df, marks).collect()}
    want = {i: w for (i, _), w in zip(docs, brute(docs, target))}
    assert got == want and sum(w[3] is not None for w in want.values()) == 5 * sum(len(words(t)) >= 20 for _, t in docs) // 100
    drawn = importance_resample(df, marks, rank_col="place")
    assert drawn.columns == [*df.columns, "place"]
    assert {r.doc_id: r.place for r in drawn.collect()} == {i: w[3] for i, w in want.items() if w[3]}
    assert all(r.score == 1 and r["rank"] == "r" for r in drawn.collect())


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a b " * 20)] * 30, schema)
    assert importance_ranks(none, some).count() == 0 and importance_resample(none, none).count() == 0
    got = importance_ranks(some, none).collect()  # repeated rows: one of thirty is drawn
    assert len(got) == 30 and [r["rank"] for r in got if r["rank"]] == [1] and len({r.weight for r in got}) == 1


@pytest.mark.parametrize("halvings", [1, 4])
def test_bisection_finds_the_cutoff(spark, monkeypatch, halvings):
    monkeypatch.setattr(importance, "HALVINGS", halvings)
    rng = random.Random(halvings)
    values = [rng.choice([rng.randint(-(2**40), 2**40), 5, 5, 7, -3]) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 2, 30, 59, 60):
        cutoff = sorted(values, reverse=True)[wanted - 1]
        assert highest(df, "v", wanted) == (cutoff, sum(v > cutoff for v in values))
    assert highest(df, "v", 0) is None and highest(df.where("v IS NULL"), "v", 3) is None


def test_ties_in_score_and_id(spark):
    """A third of all rows tie at the cutoff, many of them in the id too: the smaller id, then any of its rows, null ids last."""
    rows = [(n, 9 if n < 5 else 4 if n < 300 else 1, [7, 7, 3, None][n % 4], 20 + n % 3, n, n) for n in range(600)]
    df = spark.createDataFrame(rows, "row long, score long, id long, n_words long, n_features long, weight long").repartition(7)
    got = ranked_draw(df, percent=40, least_words=20)
    drawn = sorted((r["rank"], r.score, r.id, r.row) for r in got.collect() if r["rank"])
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))[:240]
    assert drawn == [(k + 1, s, i, n) for k, (n, s, i, *_) in enumerate(want)] and got.count() == 600
