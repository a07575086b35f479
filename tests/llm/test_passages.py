import random
import zlib

import numpy as np
import pytest

from fieldloom.llm.passages import PASSAGE, WIDTH, PassageModel, passages, score_quality, train_passage_model


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def rows_of(n, rng):
    """Documents in several passages; those of label 0 have one passage of junk, at any place."""
    made = []
    for i in range(n):
        parts = [" ".join("".join(rng.choices(["ba", "do", "ki", "lu", "me"], k=rng.randint(1, 4))) for _ in range(PASSAGE)) for _ in range(rng.randint(1, 6))]
        bad = rng.random() < 0.3
        if bad:
            junk = rng.choice(["WORD!! ", "x*** y### ", "same same "])
            parts[rng.randrange(len(parts))] = junk * 25
        made.append((i, " ".join(parts), int(not bad)))
    return made


def test_measures_of_passages():
    text = " ".join(f"w{i}" for i in range(PASSAGE)) + " A$ A$ A$ A$"
    bag = passages(text)
    assert bag.shape == (2, WIDTH) and passages(None).shape == passages(" \n").shape == (0, WIDTH)
    same, distinct, again, long, spread, size = bag[1, -6:]
    assert (same, distinct, again, spread) == (0.75, 0.25, 1.0, 0.0) and long == pytest.approx(np.log(2)) and size == pytest.approx(4 / PASSAGE)
    assert bag[0, -6:-3].tolist() == [0, 1, 0] and bag[0, 0] == pytest.approx(np.sqrt(PASSAGE / len(text.split(" A")[0])))
    long_text = "a b c " * 5000
    assert len(passages(long_text)) == 15000 // PASSAGE and len(passages(long_text, 24)) == 24


def test_gradients():
    rng = np.random.default_rng(0)
    x, starts, y, weight = rng.standard_normal((9, WIDTH)), np.array([0, 2, 6]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    model = PassageModel.create(x, codes=4, gates=3)
    model.score[...] = rng.standard_normal(5)

    def loss():
        p = 1 / (1 + np.exp(-model._forward(x, starts)[0]))
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean()

    for p, g in zip(model._parameters(), model._gradients(x, starts, y, weight)):
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), (0,) * g.ndim]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-8)


def brute_score(model, bag):
    """One document's score by the plain formulas, passage by passage."""
    codes, energies = [], []
    for x in bag:
        scaled = np.append(np.clip((x - model.mean) / model.scale, -8, 8), 1)
        h = np.tanh(scaled @ model.code)
        codes.append(h)
        energies.append(model.attend @ (np.tanh(h @ model.gate_tanh) / (1 + np.exp(-h @ model.gate_sigmoid))))
    weights = np.exp(energies) / np.exp(energies).sum()
    z = sum(w * h for w, h in zip(weights, codes))
    return 1 / (1 + np.exp(-(z @ model.score[:-1] + model.score[-1])))


def test_quality_held_out(spark):
    made = rows_of(900, random.Random(4))
    rows = [(i, t, "x", 0.5) for i, t, _ in made] + [(5000, None, "x", 0.0), (5001, " \n", "x", 0.0), (5002, "word " * 40000, "x", 0.0), (None, "some text", "x", 0.0), (0, "repeated id", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double").repartition(4)
    labels = spark.createDataFrame([*[(i, q) for i, _, q in made], (5000, None), (None, 1), (5001, 1), (1, 7), (0, made[0][2])], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    held = [i for i in range(1, 900) if out(i)]
    assert all(by[i].held_out == out(i) for i in range(1, 900)) and by[None].held_out
    assert np.mean([by[i].predicted == made[i][2] for i in held]) > 0.95
    assert by[5000].score == by[5001].score == 0.0
    model = train_passage_model(docs, labels)
    for i in held[:40]:
        assert by[i].score == pytest.approx(brute_score(model, passages(made[i][1]).astype(float)), abs=1e-9)


def test_attention_finds_the_passage():
    """Where one passage decides, it gets most of the weight."""
    made = rows_of(500, random.Random(5))
    bags, y = [passages(t).astype(float) for _, t, _ in made], np.array([q for _, _, q in made])
    model = PassageModel.create(np.concatenate(bags)).train(bags, y, np.ones(len(y)))
    top = [bag for bag, q in zip(bags, y) if q == 0 and len(bag) > 3]
    hits = 0
    for bag in top:
        *_, a, _ = model._forward(bag, np.array([0]))[1]
        hits += bag[:, 0].argmin() == a.argmax() or bag[:, -6].argmax() == a.argmax()
    assert hits >= 0.9 * len(top)


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d e")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in score_quality(docs, none).collect()} == {1: 0.5, 2: 0.0, 3: 0.5}
    ids = [i for i in range(1, 30) if not out(i)][:2]
    rows = spark.createDataFrame([(ids[0], "A B C " * 30), (ids[1], "a b c d")], "doc_id long, text string")
    one = spark.createDataFrame([(ids[0], 1)], "doc_id long, quality int")
    assert {r.score for r in score_quality(rows, one).collect()} == {2 / 3}
    both = spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in score_quality(rows, both).collect()}
    assert got == {ids[0]: 0, ids[1]: 1}
    assert score_quality(docs.limit(0), both).count() == 0
