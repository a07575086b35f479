"""Language, toxicity, token counts and neighbours: held-out accuracy, exact equality or recall."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import language, neighbours
from fieldloom.llm.bpe import Encoder, Vocabulary
from fieldloom.llm.language import ByteNet, identify_languages, language_filter
from fieldloom.llm.neighbours import nearest_neighbours
from fieldloom.llm.token_counts import LengthCounter, count_tokens, frequent_pieces
from fieldloom.llm.toxicity import STEPS, _grams, _unexplained, score_toxicity, train_toxicity
from fieldloom.llm.toxicity import WINDOW as WINDOW_BYTES
from tests.llm.test_bpe import texts

STEMS = {"aa": ["the", "and", "ing", "er", "on"], "bb": ["sch", "ung", "der", "ei", "lich"], "cc": ["ció", "ñar", "los", "ez", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_languages_held_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(STEMS)), rng.choice([3, 30, 400])), lang, None) for i in range(400)]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !? 456", "bb", "s"), (1003, prose(rng, "bb", 20000), None, "s"), (1003, "x", "aa", "s"), (None, prose(rng, "cc", 50), "cc", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    got = identify_languages(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 1003}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    held = [i for i in range(400) if out(i)]
    assert all(by[i].held_out == out(i) for i in range(400))
    assert np.mean([by[i].lang_pred == rows[i][2] for i in held]) > 0.95
    kept = language_filter(df)
    assert kept.columns == df.columns and kept.where(F.col("doc_id").isin(1000, 1001, 1002)).count() == 0
    assert {r.lang_pred for r in identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_languages(df.limit(0)).count() == 0


def test_network_gradients():
    net, rng = ByteNet.create(["a", "b"], n=3, size=4), np.random.default_rng(0)
    for p in net._parameters():
        p[...] = p.astype(np.float32)
    x, y = rng.integers(0, 256, (6, 256)), rng.integers(0, 2, 6)

    def loss():
        z = net.scorer().log_probabilities(np.ascontiguousarray(x.T))
        return -z[np.arange(6), y].mean()

    for p, g in zip(net._parameters(), net._gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.15, abs=1e-3)


def brute_toxicity(model, text):
    """A score by the plain formula: bytes of each window after each dictionary, steps, and the curve."""

    def compressed(data, dictionary):
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(9, source_size=2 * WINDOW_BYTES, dict_size=len(dictionary), min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress(data))

    gains, words = [], []
    for word in (text or "").lower().encode().split():
        words.append(word)
        if sum(map(len, words)) + len(words) >= WINDOW_BYTES:
            gains.append(words)
            words = []
    gains = [b" " + b" ".join(w) + b" " for w in [*gains, *([words] if words else [])]]
    gains = [compressed(w, model.ordinary) - compressed(w, model.toxic) for w in gains]
    n, low, high = len(gains), *STEPS
    plain, above = sum(min(max(g, 0), high) for g in gains), sum(min(max(g - low, 0), high) for g in gains)
    z = np.dot(model.weights, [plain / (n + 2), above / (n + 2), above / np.sqrt(n + 1), 1.0])
    return 1 / (1 + np.exp(-z))


def test_what_ordinary_text_leaves_unexplained():
    reference = np.unique(_grams(b" the quick brown fox jumps over it "))
    assert _unexplained("The quick zebra fox jumps over IT", reference) == b"zebra"
    assert _unexplained("", reference) == b"  " and _unexplained("the quick brown fox", reference) == b""


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    insults = ["numbskull", "dunderhead", "blockhead", "nitwit", "scoundrel"]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.choice(["aa", "bb"]), rng.randint(40, 200)).split()
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * (3 + len(words) // 40)):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "nitwit", "x"), (None, "some text", "x"), (0, "repeated id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    marks = spark.createDataFrame([*labels, (5000, None), (None, 1), (0, labels[0][1])], "doc_id long, toxic int")
    got = score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    held = [i for i in range(1, 900) if out(i)]
    assert np.mean([by[i].predicted == labels[i][1] for i in held]) > 0.95
    model = train_toxicity(docs, marks)
    for i in (*held[:40], 5000, 5001, 5002):
        assert by[i].score == pytest.approx(brute_toxicity(model, rows[i][1] if i < 900 else rows[i - 4100][1]), abs=1e-12)
    assert by[5000].predicted == by[5001].predicted == 0
    assert {r.score for r in score_toxicity(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    every = [None, "word, " * 50000, *texts()[:800]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(every)], "doc_id long, text string, n_tokens int").repartition(40)
    for table in (None, []):
        got = {r.doc_id: r.n for r in df.select("doc_id", count_tokens(df, path, table=table).alias("n")).collect()}
        assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(every)}
    assert frequent_pieces(df.where("doc_id = 1"), "text", path, 2) == [",", " word" if name.startswith("byte") else "word"]
    assert df.limit(0).select(count_tokens(df.limit(0), path)).count() == 0


def test_frequent_pieces_of_many_summaries(spark):
    """The same as by counting in one place, when pieces are spread unevenly over 40 tasks; a table is asked before any cache."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    every = [" " + " ".join(rng.choices(names[: 20 + i], [1 / (j + 1) for j in range(20 + i)], k=300)) for i in range(180)]
    encoder, want = Encoder(Vocabulary.load(path)), Counter()
    for t in every:
        want.update(p for c in t.split(" ")[2:] for p in encoder.pieces(" " + c))
    df = spark.createDataFrame([(t,) for t in every], "text string").repartition(40)
    got = frequent_pieces(df, "text", path, 1000)
    assert set(want) <= set(got) and got[:3] == [p for p, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))][:3]
    counter = LengthCounter(Vocabulary.load(path), {" word": 7})
    assert [*counter.counts(["a word word", None])] == [15, 0] and [*counter.counts(["a word"])] == [8]
    assert "word" not in counter.of_chunk and " word" not in counter.of_piece


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    asked = {}
    for q, x in ok:
        if q % 20 == 0:
            asked[q] = min(asked.get(q, x.tolist()), x.tolist())
    for q, x in asked.items():
        yield q, sorted(((-(v * np.array(x)).sum(), i) for i, v in ok if i != q and len(v) == len(x)))[:k]


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    rows += [(i, rng.standard_normal(8).tolist()) for i in (7, 7, 7, 20, 11)]  # repeated ids
    rows += [(3000 + i, rng.standard_normal(3).tolist()) for i in range(30)]  # another length
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2100, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = {}
    for r in nearest_neighbours(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, best in brute_neighbours(rows, 20):
        mine = sorted(got.pop(q))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert sorted(((-s, i) for _, i, s in mine)) == [(-s, i) for _, i, s in mine]
        hits += (Counter(i for _, i in best) & Counter(m[1] for m in mine)).total()
        total += len(best)
    assert not got and hits / total > 0.9


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [0.5, 0.0])], schema)
    rows = nearest_neighbours(few, F.col("id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert nearest_neighbours(few.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest_neighbours(few.limit(1), F.col("id") % 20 == 0).count() == 0


def test_neighbours_of_a_query_with_many_rows_of_its_own(spark):
    """Rows with the query's id are near it and no candidates; a cluster that the sample hardly knows is found as well."""
    rng = np.random.default_rng(6)
    rows = [(0, (np.full(8, 3.0) + 0.1 * rng.standard_normal(8)).tolist()) for _ in range(400)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 401)]
    rows += [(1001 + i, (np.array([9.0, -9.0] * 4) + 0.01 * rng.standard_normal(8)).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest_neighbours(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, best in brute_neighbours(rows, 20):
        assert len(got[q]) == 20 and q not in got[q]
        hits += (Counter(i for _, i in best) & Counter(got[q])).total()
    assert hits >= 0.9 * 20 * len(got) and len(got) == 21


def test_codes_tell_long_vectors_that_the_sample_lacks():
    """Codes are of directions: a vector far longer than the sample's is told as well as these, and huge ones do not overflow."""
    rng = np.random.default_rng(8)
    quantiser = neighbours.train_quantiser(rng.standard_normal((2000, 16)), 6000)
    for scale in (1e-200, 1.0, 100.0, 1e200):
        x = scale * rng.standard_normal((500, 16))
        unit, length = neighbours.directions(x)
        assert np.allclose(unit * length[:, None], x, rtol=1e-4, atol=scale * 1e-5)
        own = quantiser.lists(unit)
        assert np.abs(quantiser.decoded(own, quantiser.codes(unit, own)) - unit).max() < 0.3


def test_every_language_is_learnt(spark, monkeypatch):
    """More languages than rows of each may be taken: all are classes, and the sample keeps its bound."""
    monkeypatch.setattr(language, "ALL", 900)
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 12)}{j % 3}" for j in range(20)), f"l{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows = language.labelled_windows(df, "doc_id", "text", "lang")
    per = Counter(label for label, _ in windows)
    assert len(per) == 300 and max(per.values()) <= 3 and len(windows) <= 900
    assert language.labelled_windows(df.limit(0), "doc_id", "text", "lang") == []


def test_toxicity_sample_without_texts_in_the_shuffle(spark):
    """Rows are chosen by ids and hashes and their texts read afterwards: what joining whole windows gives, copies and repeated ids included."""
    from fieldloom.llm.language import bounded_sample
    from fieldloom.llm.toxicity import _sampled_windows

    rows = [(i % 90, f"text {i % 50}") for i in range(300)] + [(3, "same")] * 5
    windows = spark.createDataFrame(rows, "id long, window string").repartition(4)
    known = spark.createDataFrame([(i, i % 2) for i in range(80)], "id long, label int")
    sizes = spark.createDataFrame([(0, 40, 30), (1, 40, 25)], "label int, n long, size int")
    want = [(r.label, r.window) for r in bounded_sample(windows.join(known, "id").select("label", "id", "window"), sizes)]
    hashed = windows.withColumn("at", F.xxhash64(F.lit("sample"), "id", "window"))
    got = [(r.label, r.window) for r in _sampled_windows(hashed, known, sizes)]
    assert got == want and len(got) == 55
