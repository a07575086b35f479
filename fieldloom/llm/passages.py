"""Document quality by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of ``PASSAGE`` words, of which only the document's label is known. Every passage is encoded: measured
(shares of kinds of characters, repeats, word lengths) and sent through a learned layer. A gated attention unit weighs the passages
against each other, and the weighted sum of their codes is scored. Codes, attention and score are learned together in numpy on the
driver, on a bounded sample of labelled documents, and broadcast (some 10 kB). Texts are scored whole, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._util import cut_lineage, slices
from fieldloom.llm.language import held_out

#: Words of a passage.
PASSAGE = 50
#: Labelled documents of each class that are learnt from, and passages of each, evenly spread; bounds on what the driver holds.
SAMPLE, BAG = 1500, 24

_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
#: The kind of each byte: letters by case, digits, bytes beyond ASCII, blanks, and every ASCII symbol by itself.
_KIND = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 5 + _SYMBOLS.index(b) if b in _SYMBOLS else 4 for b in range(256)])
_KINDS = 5 + len(_SYMBOLS)
#: Measures of a passage besides the kinds: repeats of the word before, distinct words, words in windows of three that the text has more than once, word length and its spread, words.
WIDTH = _KINDS + 6


def passages(text: str | None, most: int | None = None) -> np.ndarray:
    """The measures of each passage of a whole text, or of ``most`` of them, evenly spread; no row for wordless texts."""
    words = (text or "").encode("utf-8", "replace").split()
    n = len(words)
    count = -(-n // PASSAGE)
    chosen = np.arange(count) if most is None or count <= most else np.arange(most) * count // most
    if not n:
        return np.zeros((0, WIDTH), np.float32)
    lengths = np.fromiter(map(len, words), np.int64, n)
    name = np.fromiter(map(hash, words), np.int64, n)
    same = np.zeros(n)
    same[1:] = name[1:] == name[:-1]
    again = np.zeros(n + 3)
    if n > 2:
        grams = name[2:] + 31 * name[1:-1] + 961 * name[:-2]
        _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
        often = np.flatnonzero(times[at] > 1)
        np.add.at(again, often, 1)
        np.add.at(again, often + 3, -1)
    again = np.cumsum(again)[:n] > 0
    out = np.zeros((len(chosen), WIDTH), np.float32)
    for row, i in enumerate(chosen):
        part = slice(i * PASSAGE, (i + 1) * PASSAGE)
        data = b" ".join(words[part])
        kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=_KINDS)
        size, long = len(words[part]), np.log(lengths[part])
        out[row, :_KINDS] = np.sqrt(kinds / len(data))
        out[row, _KINDS:] = same[part].mean(), len(set(words[part])) / size, again[part].mean(), long.mean(), long.std(), size / PASSAGE
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class PassageModel:
    """Scaling of the measures and the parameters: code layer, both attention gates, attention weights, score weights."""

    mean: np.ndarray
    scale: np.ndarray
    code: np.ndarray
    gate_tanh: np.ndarray
    gate_sigmoid: np.ndarray
    attend: np.ndarray
    score: np.ndarray

    @classmethod
    def create(cls, bags: np.ndarray, codes: int = 12, gates: int = 8, seed: int = 7) -> "PassageModel":
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        return cls(bags.mean(axis=0), bags.std(axis=0) + 0.05, normal(WIDTH + 1, codes), normal(codes, gates), normal(codes, gates), normal(gates), np.zeros(codes + 1))

    def _parameters(self) -> list[np.ndarray]:
        return [self.code, self.gate_tanh, self.gate_sigmoid, self.attend, self.score]

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        """Log-odds of bags whose passages ``x`` come one after the other, each bag from its start on; and what led there."""
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        ones = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        h = np.tanh(ones @ self.code)
        t, s = np.tanh(h @ self.gate_tanh), _sigmoid(h @ self.gate_sigmoid)
        e = (t * s) @ self.attend
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        return z @ self.score[:-1] + self.score[-1], (owner, ones, h, t, s, a, z)

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross-entropy of bags with labels ``y``."""
        logit, (owner, ones, h, t, s, a, z) = self._forward(x, starts)
        d = weight * (_sigmoid(logit) - y) / len(y)
        dz = d[:, None] * self.score[:-1]
        through = (dz[owner] * h).sum(axis=1)
        de = a * (through - np.add.reduceat(a * through, starts)[owner])
        dt, ds = de[:, None] * self.attend * s * (1 - t * t), de[:, None] * self.attend * t * s * (1 - s)
        dh = a[:, None] * dz[owner] + dt @ self.gate_tanh.T + ds @ self.gate_sigmoid.T
        return [ones.T @ (dh * (1 - h * h)), h.T @ dt, h.T @ ds, (t * s).T @ de, np.r_[z.T @ d, d.sum()]]

    def train(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 1500, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> "PassageModel":
        """Adam on batches with as many bags of either class; ``weight`` puts the classes back to their shares."""
        rng, own = np.random.default_rng(seed), self._parameters()
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        members = [np.flatnonzero(y == c) for c in (0, 1)]
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(m, batch // 2) for m in members])
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.cumsum([0, *[len(bags[i]) for i in chosen[:-1]]])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(own, self._gradients(x, starts, y[chosen], weight[chosen]), first, second):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """From 0 to 1 for each bag; 0 for bags without passages."""
        found, some = np.zeros(len(bags)), [i for i, b in enumerate(bags) if len(b)]
        if some:
            starts = np.cumsum([0, *[len(bags[i]) for i in some[:-1]]])
            found[some] = _sigmoid(self._forward(np.concatenate([bags[i] for i in some]), starts)[0])
        return found


def train_passage_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> PassageModel | float:
    """A model from labelled rows outside the held-out fold; where they lack a class, the smoothed share of label 1 among them.

    At most ``sample`` ids of each class, chosen by their hashes, one text with words of each, and ``BAG`` passages of it: a bounded sample.
    Labels other than 0 and 1 are none; of contradicting labels of one id the lower one counts. Only ids and labels are shuffled to choose.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    there = cut_lineage(texts.select("id").distinct().join(known, "id"))
    total = {r.label: r.n for r in there.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(total) < 2:
        return (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    at = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000))
    # A threshold passes about twice as many as are wanted; of these the first by hash are taken.
    passed = there.where(at < F.when(F.col("label") == 1, F.lit(int(2e6 * sample / total[1]) + 1)).otherwise(F.lit(int(2e6 * sample / total[0]) + 1)))
    order = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64(F.lit("order"), "id"), "id"))
    chosen = F.broadcast(passed.withColumn("order", order).where(F.col("order") <= sample))  # 2 * sample rows at most
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    rows = texts.join(chosen, "id").groupBy("label", "order").agg(first).select("label", "order", F.col("first.text").alias("text"))

    @F.arrow_udf("binary")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([passages(t, BAG).tobytes() for t in batch.to_pylist()], pa.binary())

    found = rows.select("label", "order", measured(F.col("text")).alias("window")).orderBy("label", "order").collect()
    bags = [np.frombuffer(r.window, np.float32).reshape(-1, WIDTH).astype(float) for r in found]
    y = np.array([r.label for r in found])
    share = np.array([total[0], total[1]]) / sum(total.values())
    return PassageModel.create(np.concatenate(bags)).train(bags, y, 2 * share[y])


def passage_quality(docs: DataFrame, model: PassageModel | float, text_col: str = "text") -> Column:
    """Score from 0 to 1 of each whole text, higher where label 1 is likelier; 0 for null and wordless texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            bags = [passages(t) for t in batch.to_pylist()]
            found = np.where([len(b) > 0 for b in bags], shared.value, 0.0) if isinstance(shared.value, float) else shared.value.scores(bags)
            yield pa.array(found, pa.float64())

    return score(F.col(text_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``; predicted is 1 from a score of ``least``.

    Labels, languages, sources and ids are no inputs of a score. Null and wordless texts score 0. A null id is held out; rows with repeated
    ids are scored one by one. Other columns are not looked at. An empty table gives an empty result.
    """
    model = train_passage_model(docs, labels, id_col, text_col, label_col)
    found = docs.select(F.col(id_col).alias("id"), passage_quality(docs, model, text_col).alias("score"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
