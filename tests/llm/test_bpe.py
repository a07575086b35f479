import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm.bpe import IdEncoder, Vocabulary, bpe_decode, bpe_encode

ODD = [
    "", " ", "  a  b   c", "it's I'LL DON'T 12345 ½ Ⅷ", "İstanbul ΣΑΣ ΟΔΟΣ", "é Å", "a\x1cb \x1d c\x85d\xa0e", "日本語 🙂🙂",
    "<|endoftext|> hi<|startoftext|>x <|endoft", "x\n\n  y \n z\t\t w  ", "a b　c", "a" * 500, "ab\u0000c", " \n a", "don't'll 's",
]


def texts():
    rng = random.Random(7)
    letters = "ab '\n\t<|>é Σİ1½日\x1c\xa0.!—st"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), IdEncoder(Vocabulary.load(path))
    for text in texts():
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.packed(text), np.int32).tolist() == expected, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point(name):
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), IdEncoder(Vocabulary.load(path))
    points = [i for i in [*range(0x40000), *range(0xE0000, 0xE0400), *range(0x40000, 0x110000, 997)] if not 0xD800 <= i < 0xE000]
    rng = random.Random(3)
    mixed = rng.sample(points, 60000)
    runs = [*(points[i : i + 64] for i in range(0, len(points), 64)), *(mixed[i : i + 5] for i in range(0, len(mixed), 5))]
    every = ["".join(f"a{chr(i)}b {chr(i)}" for i in run) for run in runs] + ["".join(map(chr, run)) for run in runs]
    for text, found in zip(every, library.encode_batch(every, add_special_tokens=False)):
        assert np.frombuffer(encoder.packed(text), np.int32).tolist() == found.ids, repr(text)


def test_combining_sequences():
    """Marks in any order after letters, also of scripts that Python's tables may not know."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), IdEncoder(Vocabulary.load(path))
    rng = random.Random(4)
    signs = [*range(0x300, 0x370), 0x897, 0x105D2, 0x105DA, 0x307, 0x11382, 0x113C9, 0x16D67, 0x41, 0x65, 0x1E0A, 0xAC00, 0x11A8, 0x1100, 0x1161, 0xA7CB, 0x1C89]
    for _ in range(4000):
        text = "".join(chr(rng.choice(signs)) for _ in range(6))
        assert np.frombuffer(encoder.packed(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_what_a_file_may_not_ask_for(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    changes = [("model", "dropout", 0.1), ("model", "ignore_merges", True), ("model", "byte_fallback", True), ("pre_tokenizer", "add_prefix_space", True), ("model", "type", "Unigram")]
    for part, name, value in changes:
        changed = {**spec, part: {**spec[part], name: value}}
        (tmp_path / "t.json").write_text(json.dumps(changed), encoding="utf-8")
        with pytest.raises(ValueError):
            Vocabulary.load(str(tmp_path / "t.json"))
    (tmp_path / "t.json").write_text(json.dumps({**spec, "normalizer": {"type": "StripAccents"}}), encoding="utf-8")
    with pytest.raises(ValueError):
        Vocabulary.load(str(tmp_path / "t.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_columns_nulls_and_decoding(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, "word " * 60000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids2 string").repartition(3)
    coded = df.withColumn("ids", bpe_encode(spark, F.col("text"), path)).withColumn("back", bpe_decode(spark, F.col("ids"), path))
    got = {r.doc_id: r for r in coded.collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].back == library.decode(ids, skip_special_tokens=False)


def test_byte_level_round_trip_is_exact(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(t,) for t in texts()[:500]], "text string")
    back = df.select("text", bpe_decode(spark, bpe_encode(spark, F.col("text"), path), path).alias("back"))
    assert back.where("text != back").count() == 0


def test_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([], "text string").select(bpe_encode(spark, F.col("text"), path).alias("ids"))
    assert df.collect() == []
