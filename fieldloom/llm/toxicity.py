"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary labelled text, each on what ordinary text doesn't explain: the
stretches of its samples that share no ``GRAM`` bytes with the reference part of the ordinary sample. (Whole samples of either class
hold mostly the same ordinary pieces, and dictionaries of these hardly differ.) Both stand behind one and the same dictionary of
ordinary text, so that two compressors result that differ in those bytes only. A window of whole words is compressed by both; the bytes
that the toxic one saves are its gain. A text's gains are turned into a score by thresholds (steps at ``STEPS`` bytes and a logistic
curve) calibrated on labelled texts that the dictionaries in use had not seen.

Training takes a bounded sample of labelled windows on the driver; the dictionaries, some hundred kB, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, slices
from fieldloom.llm.language import bounded_choice, held_out

#: Labelled rows of each class that are learnt from, and characters of each; bounds on what the driver holds.
SAMPLE = {1: 2000, 0: 6000}
SAMPLE_CHARS = 2048
#: Bytes of a window, and of a stretch that makes text ordinary.
WINDOW, GRAM = 96, 8
#: Share of the ordinary sample that is the reference, and folds of the rest and of the toxic one for the calibration.
REFERENCE, FOLDS = 0.6, 4
#: Bytes of the common dictionary and of each class's own, and bytes of a class's dictionary's pieces.
BASE, OWN, PIECE = 112_640, 2048, 16
#: A window's gain counts from the first and up to the second number of bytes, so that no single passage decides; see ``_features``.
STEPS = (3, 10)
_LEVEL = 9


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _windows(text: str) -> list[bytes]:
    """The text's words, lower-cased, in windows of WINDOW bytes or a little more."""
    out, current, size = [], [], 0
    for word in _words(text):
        current.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(current) + b" ")
            current, size = [], 0
    if current:
        out.append(b" " + b" ".join(current) + b" ")
    return out


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL, source_size=2 * WINDOW, dict_size=len(dictionary), min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """A trained dictionary; the samples' own tail where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(data: bytes) -> np.ndarray:
    """All stretches of GRAM bytes, as numbers."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM)).view(np.uint64).ravel()


def _unexplained(text: str, reference: np.ndarray) -> bytes:
    """The bytes of a text that lie in no stretch that ``reference`` (sorted) has too."""
    data = b" " + b" ".join(_words(text)) + b" "
    grams = _grams(data)
    if not len(grams) or not len(reference):
        return data
    at = np.minimum(np.searchsorted(reference, grams), len(reference) - 1)
    edges = np.zeros(len(data) + 1, np.int64)
    known = np.flatnonzero(reference[at] == grams)
    np.add.at(edges, known, 1)
    np.add.at(edges, known + GRAM, -1)
    return np.frombuffer(data, np.uint8)[np.cumsum(edges[:-1]) == 0].tobytes()


@dataclass
class ToxicModel:
    """Both compressors' dictionaries and the calibrated curve's weights."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    @classmethod
    def train(cls, toxic: list[str], ordinary: list[str]) -> "ToxicModel":
        """Dictionaries from all texts; the curve from texts scored by dictionaries made without their fold."""
        cut = max(1, int(REFERENCE * len(ordinary)))
        base = _trained([w for t in ordinary[:cut] for w in _windows(t)], BASE)
        reference = np.unique(_grams(b"".join(b" " + b" ".join(_words(t)) + b" " for t in ordinary[:cut])))
        texts = toxic, ordinary[cut:]
        rests = [[_unexplained(t, reference) for t in part] for part in texts]
        del reference
        gains = [[], []]
        for fold in range(FOLDS):
            own = cls._of(base, *([r for i, r in enumerate(rest) if i % FOLDS != fold] for rest in rests))
            for found, part in zip(gains, texts):
                found += [own.features(t) for t in part[fold::FOLDS]]
        model = cls._of(base, *rests)
        x, y = np.array([*gains[0], *gains[1]]), np.r_[np.ones(len(gains[0])), np.zeros(len(gains[1]))]
        # The classes weigh as much as they have texts, those of the reference included.
        weight = np.where(y == 1, 1.0, len(ordinary) / max(1, len(texts[1])))
        return cls(model.model.toxic, model.model.ordinary, _logistic(x, y, weight / weight.mean()))

    @classmethod
    def _of(cls, base: bytes, toxic: list[bytes], ordinary: list[bytes]) -> "_Scorer":
        """Dictionaries of equal size from both classes' unexplained stretches."""
        parts = [[r for r in rest if len(r) >= GRAM] for rest in (toxic, ordinary)]
        own = [_trained(part, OWN, k=PIECE, d=GRAM) for part in parts]
        size = max(map(len, own))
        return _Scorer(cls(*(base + part.rjust(size, b"\xff") for part in own), ()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights of the features and the offset, by Newton steps."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(z) * np.eye(len(w)) * np.r_[np.ones(len(w) - 1), 1e-6]
        step = np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * len(z) * np.r_[w[:-1], 0])
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


class _Scorer:
    """Scores texts in one process."""

    def __init__(self, model: ToxicModel) -> None:
        self.model, self.toxic, self.ordinary = model, _compressor(model.toxic).compress, _compressor(model.ordinary).compress

    def features(self, text: str | None) -> list[float]:
        """Of the gains of a text's windows: means from zero and from STEPS[0] bytes on, and the latter by the root of the windows' number."""
        low, high = STEPS
        windows = _windows(text or "")
        gains = [len(self.ordinary(w)) - len(self.toxic(w)) for w in windows]
        n = len(gains)
        plain, above = sum(min(max(g, 0), high) for g in gains), sum(min(max(g - low, 0), high) for g in gains)
        return [plain / (n + 2), above / (n + 2), above / (n + 1) ** 0.5]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        z = x @ np.array(self.model.weights[:-1]) + self.model.weights[-1] if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> ToxicModel | None:
    """A model from labelled rows outside the held-out fold, None unless both classes have three, one for each calibration fold.

    At most ``sample`` rows of each class, chosen by hashes, and one window of SAMPLE_CHARS characters of each: a bounded sample. Of contradicting labels of one id the higher one counts.
    """
    sample = sample or SAMPLE
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    text = F.col("text")
    start = F.pmod(F.xxhash64(F.lit("window"), "id"), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    windows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(text) > 0).select("id", F.substr(text, start.cast("int"), F.lit(SAMPLE_CHARS)).alias("window"))
    windows = windows.withColumn("at", F.xxhash64(F.lit("sample"), "id", "window"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).withColumn("size", F.when(F.col("label") == 1, F.lit(sample[1])).otherwise(F.lit(sample[0])))
    by_class: dict[int, list[str]] = {0: [], 1: []}
    for r in _sampled_windows(windows, known, cut_lineage(sizes)):
        by_class[r.label].append(r.window)
    return ToxicModel.train(by_class[1], by_class[0]) if min(map(len, by_class.values())) >= 3 else None


def _sampled_windows(windows: DataFrame, known: DataFrame, sizes: DataFrame) -> list:
    """Rows (label, window) as ``bounded_sample`` takes them from ``windows`` (id, window, at) with the labels of ``known`` (id, label).

    Labels and documents meet as ids and hashes; a window is read once its row is chosen, so that no text is shuffled but the sample's.
    """
    chosen = cut_lineage(bounded_choice(windows.select("id", "at").join(known, "id"), sizes, "id"))
    texts = windows.join(F.broadcast(chosen.select("id", "at").distinct()), ["id", "at"]).groupBy("id", "at").agg(F.first("window").alias("window"))
    return chosen.join(texts, ["id", "at"]).orderBy("label", "order").select("label", "window").collect()


def toxicity(docs: DataFrame, model: ToxicModel | None, text_col: str = "text") -> Column:
    """Score from 0 to 1 of each whole text, higher where label 1 is likelier; 0 for all texts without a model.

    Null, empty and wordless texts get the score of no gain at all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(shared.value) if shared.value else None
        for batch in slices(batches):
            yield pa.array(scorer.scores(batch.to_pylist()) if scorer else [0.0] * len(batch), pa.float64())

    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``; predicted is 1 from a score of 0.5.

    Labels, languages, sources and ids are no inputs of a score. A null id is held out. An empty table gives an empty result.
    """
    model = train_toxicity(docs, labels, id_col, text_col, label_col)
    found = docs.select(F.col(id_col).alias("id"), toxicity(docs, model, text_col).alias("score"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
