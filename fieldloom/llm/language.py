"""Language identification by a small convolutional network over bytes.

Byte embeddings go through filters of several widths, each filter's maximum over a window feeds a softmax layer. The network is
trained in numpy on the driver, on a bounded sample of labelled windows, and broadcast (some hundred kB). A text is scored on
all its fixed-length windows, in batches; its languages' log-probabilities are averaged by the windows' lengths. For scoring, a
filter is tabulated over byte pairs, so a position costs a few table rows instead of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, slices, small_side

WINDOW = 256
PAD = 256
UNDETERMINED = "und"
#: Labelled documents of each language that are learnt from, one window each, and of all languages together: with more languages than
#: ``ALL`` / ``SAMPLE`` each has fewer, one at least. Bounds on what the driver holds.
SAMPLE, ALL = 400, 100_000
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class ByteNet:
    """The network's parameters; ``widths[i]`` goes with ``filters[i]`` of shape (width, embedding, filters)."""

    classes: list[str]
    embedding: np.ndarray
    widths: tuple[int, ...]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def create(cls, classes: list[str], seed: int = 11, widths: tuple[int, ...] = (2, 3, 4), size: int = 8, n: int = 8) -> "ByteNet":
        rng = np.random.default_rng(seed)
        normal = lambda *shape, fan: (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)
        embedding = normal(257, size, fan=1.0)
        embedding[PAD] = 0
        filters = [normal(w, size, n, fan=w * size) for w in widths]
        return cls(classes, embedding, widths, filters, [np.zeros(n, np.float32) for _ in widths], normal(n * len(widths), len(classes), fan=n * len(widths)), np.zeros(len(classes), np.float32))

    def _parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.dense_bias]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over windows ``x`` with classes ``y``."""
        batch, size = len(x), self.embedding.shape[1]
        e = self.embedding[x]
        pooled, kept = [], []
        for w, f, b in zip(self.widths, self.filters, self.biases):
            patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(batch, -1, w * size)
            z = patches @ f.reshape(w * size, -1) + b
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((patches, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        p = _softmax(h @ self.dense + self.dense_bias)
        p[np.arange(batch), y] -= 1
        p /= batch
        dh, de = p @ self.dense.T, np.zeros_like(self.embedding)
        d_filters, d_biases, start, rows = [], [], 0, np.arange(batch)[:, None]
        for (patches, at, live), w, f in zip(kept, self.widths, self.filters):
            n = f.shape[2]
            dz = dh[:, start : start + n] * live
            start += n
            chosen = patches[rows, at]  # batch, filters, w * size
            d_filters.append(np.einsum("bf,bfk->kf", dz, chosen).reshape(f.shape))
            d_biases.append(dz.sum(0))
            back = dz[:, :, None] * f.reshape(w * size, n).T[None]
            for j in range(w):
                np.add.at(de, x[rows, at + j].ravel(), back[:, :, j * size : (j + 1) * size].reshape(-1, size))
        de[PAD] = 0
        return [de, *d_filters, *d_biases, h.T @ p, p.sum(0)]

    def train(self, texts: list[bytes], labels: np.ndarray, seed: int = 5, steps: int = 600, batch: int = 48, rate: float = 0.01) -> "ByteNet":
        """Adam on random cuts of the texts, long and short, every class drawn as often as any other."""
        rng, own = np.random.default_rng(seed), self._parameters()
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        members = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.classes), batch)
            x = np.full((batch, WINDOW), PAD)
            for row, c in enumerate(y):
                data = texts[rng.choice(members[c])]
                size = min(len(data), WINDOW, int(WINDOW * rng.random() ** 2) + 12)
                start = rng.integers(0, len(data) - size + 1)
                x[row, :size] = np.frombuffer(data, np.uint8)[start : start + size]
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(own, self._gradients(x, y), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def scorer(self) -> "_Scorer":
        return _Scorer(self)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Scorer:
    """Log-probabilities of windows, with the filters tabulated over byte pairs."""

    def __init__(self, net: ByteNet) -> None:
        self.net, self.tables = net, []
        for w, f in zip(net.widths, net.filters):
            single = [net.embedding @ f[j] for j in range(w)]
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(257 * 257, -1) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, single[-1] if w % 2 else None))

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows that stand in the columns of ``x``."""
        length, count = x.shape
        pairs_at = x[:-1] * 257 + x[1:]
        pooled = []
        for (w, pairs, odd), b in zip(self.tables, self.net.biases):
            n = length - w + 1
            z = pairs[0].take(pairs_at[:n].ravel(), axis=0, mode="clip")
            for k, table in enumerate(pairs[1:], 1):
                z += table.take(pairs_at[2 * k : 2 * k + n].ravel(), axis=0, mode="clip")
            if odd is not None:
                z += odd.take(x[w - 1 : w - 1 + n].ravel(), axis=0, mode="clip")
            pooled.append(np.maximum(z.reshape(n, -1).max(axis=0).reshape(count, -1) + b, 0))
        z = (np.concatenate(pooled, axis=1) @ self.net.dense + self.net.dense_bias).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, text of each, bytes of each), 64 windows at a time, over whole texts."""
    block, owner = [], []
    for i, data in enumerate(texts):
        for start in range(0, len(data), WINDOW):
            block.append(data[start : start + WINDOW])
            owner.append(i)
            if len(block) == 64:
                yield _padded(block), np.array(owner), np.array([len(b) for b in block])
                block, owner = [], []
    if block:
        yield _padded(block), np.array(owner), np.array([len(b) for b in block])


def _padded(block: list[bytes]) -> np.ndarray:
    """The windows as columns."""
    x = np.full((len(block), WINDOW), PAD, np.int32)
    for row, data in enumerate(block):
        x[row, : len(data)] = np.frombuffer(data, np.uint8)
    return x.T.astype(np.int64, order="C")


def _predict(scorer: _Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    data = [t.encode("utf-8", "replace") if t and _LETTER.search(t) else b"" for t in texts]
    total = np.zeros((len(data), len(scorer.net.classes)))
    for x, owner, size in _windows(data):
        np.add.at(total, owner, scorer.log_probabilities(x) * size[:, None])
    length = np.array([len(d) for d in data])
    p = _softmax(total / np.maximum(length, 1)[:, None])
    best = p.argmax(axis=1)
    found = length > 0
    return np.where(found, np.array(scorer.net.classes, object)[best], UNDETERMINED).tolist(), np.where(found, p.max(axis=1), 0.0).tolist()


def bounded_sample(rows: DataFrame, sizes: DataFrame) -> list:
    """Rows (label, id, text-like columns) of each label, at most its ``size`` in ``sizes`` (label, n, size), by hashes of id and content.

    A hash threshold set by the label's count ``n`` passes about twice as many; of these the first by hash are taken, so the number
    is bounded whatever repeats.
    """
    others = [c for c in rows.columns if c != "label"]
    hashed = rows.withColumn("at", F.xxhash64(F.lit("sample"), *others))
    return bounded_choice(hashed, sizes, *others).orderBy("label", "order").select("label", "window").collect()


def bounded_choice(hashed: DataFrame, sizes: DataFrame, *ties: str) -> DataFrame:
    """``hashed`` (label, at, ...) with ``order``: at most ``size`` rows of each label, by the hash ``at``, then by ``ties``."""
    hashed = hashed.join(small_side(sizes), "label")
    passed = hashed.where(F.pmod("at", F.lit(1_000_000)) < (2e6 * F.col("size") / F.col("n")).cast("long") + 1)
    order = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(F.lit("order"), "at"), *ties))
    return passed.withColumn("order", order).where(F.col("order") <= F.col("size"))


def labelled_windows(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, chars: int = WINDOW) -> list[tuple[str, str]]:
    """(label, window) of ``sample`` rows at most of each label, one window of each row's text, chosen by hashes.

    Rows of the held-out fold, without label or without text are never among them. Every label is learnt; see ``ALL``.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & (F.length(text) > 0) & ~held_out(F.col("id")))
    counts = cut_lineage(rows.groupBy("label").agg(F.count("*").alias("n")))
    sizes = counts.withColumn("size", F.lit(max(1, min(sample, ALL // max(1, counts.count())))))
    start = F.pmod(F.xxhash64(F.lit("window"), "id"), F.greatest(F.length(text) - chars, F.lit(0)) + 1) + 1
    windows = rows.select("label", "id", F.substr(text, start.cast("int"), F.lit(chars)).alias("window"))
    return [(r.label, r.window) for r in bounded_sample(windows, sizes)]


def train_language_net(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """A network for the languages that label ``docs``, None if none does."""
    windows = [(label, w) for label, w in labelled_windows(docs, id_col, text_col, lang_col, sample) if _LETTER.search(w)]
    if not windows:
        return None
    classes = sorted({label for label, _ in windows})
    labels = np.array([classes.index(label) for label, _ in windows])
    return ByteNet.create(classes).train([w.encode("utf-8", "replace") for _, w in windows], labels)


def predict_language(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of each whole text; ``und`` with score 0 for null texts, texts without a letter, or no network."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value.scorer() if shared.value else None
        for batch in slices(batches):
            texts = batch.to_pylist()
            found, score = _predict(scorer, texts) if scorer else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text_col))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row; the network is trained on the rows that are not held out.

    The label, source and id of a row are no inputs of its prediction. A null id counts as the empty text and so is held out.
    An empty table gives an empty result.
    """
    net = train_language_net(docs, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("id"), predict_language(docs, net, text_col).alias("found"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "found.lang_pred", "found.score")


def language_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.35) -> DataFrame:
    """The rows of ``docs`` with a language predicted with ``least_score`` or more, columns as they are, whatever their names.

    Rows with a null or letterless text go. Repeated and null ids are judged row by row. Where no row may be learnt from, as none is
    labelled or none has an id outside the held-out fold, all rows with a letter stay.
    """
    net = train_language_net(docs, id_col, text_col, lang_col)
    if net is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = docs.select(F.struct("*").alias("row"), predict_language(docs, net, text_col).alias("found"))
    return found.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least_score)).select("row.*")
