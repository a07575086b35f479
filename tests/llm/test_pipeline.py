"""Every pipeline stage against a brute-force version on a small table, each on what the stage before kept."""

import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm.language import PAD, WINDOW, train_language_net
from fieldloom.llm.queries import REGISTRY
from tests.llm.test_mixing import brute_targets, order
from tests.llm.test_simhash import similar_heads

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def convolved(net, text):
    """Best language and score of a text by the plain formula, window by window."""
    data, total = text.encode(), 0.0
    for start in range(0, len(data), WINDOW):
        part = data[start : start + WINDOW]
        e = net.embedding[np.array([*part, *[PAD] * (WINDOW - len(part))])].astype(float)
        pooled = []
        for w, f, b in zip(net.widths, net.filters, net.biases):
            z = np.array([np.einsum("we,wef->f", e[i : i + w], f) for i in range(WINDOW - w + 1)])
            pooled.append(np.maximum(z.max(0) + b, 0))
        z = np.concatenate(pooled) @ net.dense + net.dense_bias
        z = z - z.max()
        total = total + (z - np.log(np.exp(z).sum())) * len(part)
    p = np.exp(total / len(data))
    return net.classes[int(p.argmax())], p.max() / p.sum()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, written and read again in between."""
    root, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{root}/{k}")
        kept.append(spark.read.parquet(f"{root}/{k}"))
    return kept


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({REGISTRY.sql['op7_quality']})").fetchall() if kept}
    assert set(rows(stages[1])) == want and stages[1].columns == stages[0].columns and 0 < len(want) < stages[0].count()


def test_language_stage(stages):
    net, kept = train_language_net(stages[1]), set(rows(stages[2]))
    for i, r in sorted(rows(stages[1]).items())[:25]:
        lang, score = convolved(net, r.text)
        assert (i in kept) == (score >= 0.35 and re.search(r"[^\W\d_]", r.text) is not None)
    assert len(kept) >= 0.95 * stages[1].count()


def test_near_duplicate_stage(stages):
    docs = rows(stages[2])
    assert set(rows(stages[3])) == similar_heads({i: r.text for i, r in docs.items()})


def test_mixing_stage(stages):
    docs = rows(stages[3])
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for i, r in docs.items()}
    sizes = {}
    for i, n in size.items():
        sizes[docs[i].source] = sizes.get(docs[i].source, 0) + n
    targets, want = brute_targets(sizes), {}
    for s, total in sizes.items():
        epochs, rest = divmod(int(targets[s] + 0.5), total)
        for i in sorted((i for i in size if docs[i].source == s), key=order):
            want[i] = [size[i]] * epochs + ([min(size[i], rest)] if rest else [])
            rest -= min(size[i], rest)
    got = {}
    for r in stages[4].collect():
        got.setdefault(r.doc_id, []).append(len(r.text.split()))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}


def test_encoding_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in stages[4].collect())
    assert sorted((r.doc_id, list(r.ids)) for r in stages[5].collect()) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, words long, row string, found string, kept string, fp long, salt int, size long"


def odd_rows(ids):
    """Documents with nulls everywhere, empty and long texts, ties and repeats, and columns named like intermediate ones."""
    rng = random.Random(9)
    parts = [a + b + c for a in "bdlmnrst" for b in "aeiou" for c in ("n", "r", "")]
    prose = lambda n: " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))
    out = [(ids(i), prose(60 + i), "en", ["a", "b", None][i % 3], i, 1, "r", "f", None, i, 2, 3) for i in range(60)]
    out += out[:3] + [(ids(99), prose(30000), None, "a", 1, 1, None, None, "k", 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None, None)] * 2
    return out + [(ids(100), "", "en", "a", 0, 1, "r", "f", "k", 1, 1, 1), (None, " \n", "de", None, 0, 1, "r", "f", "k", 1, 1, 1)]


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i // 2])
def test_stages_on_odd_rows(spark, ids):
    """Every stage keeps columns and clean rows whatever the ids are."""
    given = odd_rows(ids)
    docs = spark.createDataFrame(given, ODD).repartition(3)
    good = [r for r in given if r[1] and len(r[1].split()) >= 50]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        got = out.collect()
        if k < 2:
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, good)), name
            docs = spark.createDataFrame(got, ODD)
        elif k == 2:  # all but the four exact repeats
            assert len({r.text for r in got}) == len(got) == len({r[1] for r in good})
            docs = spark.createDataFrame(got, ODD)
        elif k == 3:
            want = sum(len(t.split()) for t in {r[1] for r in good})
            assert sum(len(r.text.split()) for r in got) == pytest.approx(1.5 * want, abs=3) and all(r.row in ("r", None) for r in got)
            docs = spark.createDataFrame(got, ODD)
        else:
            assert len(got) == docs.count() and all(r.n_tokens == len(r.ids) for r in got)
    assert [stage(spark, docs.limit(0), SF).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[5].collect())
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
