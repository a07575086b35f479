"""Byte-pair encoding and decoding of text columns with a given, never trained, vocabulary.

A text is cut into pre-tokens; each pre-token that a worker has not met before is merged with a priority queue of merge
ranks over a doubly linked list of symbols, skipping stale entries, in O(n log n) of its length. Decoding concatenates the
vocabulary strings. Rows never leave their task: no shuffle, and the vocabulary is the only thing broadcast (a fixed size).

What counts as a letter, a number or white space, and what a character's lower case is, comes from the Unicode version of the library
that the vocabulary is for. It is asked once on the driver, so ids depend neither on Python's nor on another module's tables.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm._util import kept_in_worker, slices

#: About how many bytes a cache of a worker holds; bounds memory, never results.
CACHE_BYTES = 24 << 20
#: Longest piece, in characters, that is cached.
CACHED_CHARS = 64

_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The planes in which Unicode assigns letters, numbers or blanks.
_PLANES = (0, 1, 2, 3, 14)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _blocks(size: int = 0x800) -> Iterator[list[int]]:
    """The code points of ``_PLANES`` in blocks, surrogates left out."""
    for plane in _PLANES:
        for start in range(plane << 16, (plane + 1) << 16, size):
            if start != 0xD800:
                yield list(range(start, start + size))


def _ranges(points: list[int]) -> str:
    """Sorted code points as ranges of a character class of ``re``."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


@cache
def library_classes() -> dict[str, str]:
    """The library's letters (``p{L}``), numbers (``p{N}``) and white space (``s``), each as the inside of a class of ``re``."""
    from tokenizers import Regex, pre_tokenizers  # on the driver only

    kinds = {"p{L}": [], "p{N}": [], "s": []}
    any_of = pre_tokenizers.Split(Regex("|".join(f"\\{k}+" for k in kinds)), "isolated")
    one_of = {k: pre_tokenizers.Split(Regex(f"^\\{k}$"), "removed") for k in kinds}
    for block in _blocks():
        for piece, (start, end) in any_of.pre_tokenize_str("".join(map(chr, block))):
            for kind, split in one_of.items():
                if not split.pre_tokenize_str(piece[0]):
                    kinds[kind] += block[start:end]
    return {kind: _ranges(points) for kind, points in kinds.items()}


@cache
def library_lower() -> dict[int, str]:
    """Characters whose lower case in the library is not ``str.lower``'s."""
    from tokenizers import normalizers

    lower, out = normalizers.Lowercase(), {}
    for block in _blocks():
        chars = [chr(i) for i in block if i != 10]
        found = lower.normalize_str("\n".join(chars)).split("\n")
        out |= {ord(c): x for c, x in zip(chars, found) if c.lower() != x}
    return out


def _translated(pattern: str, classes: dict[str, str]) -> str:
    """The library's pattern as one of ``re``, its classes written out."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if pattern[at] == "\\":
            name = next((k for k in (*classes, "S") if pattern.startswith(k, at + 1)), None)
            if name is None or (name == "S" and inside):
                raise ValueError(f"pattern {pattern}: unknown escape at {at}")
            if name == "S":
                out.append(f"[^{classes['s']}]")
            else:
                out.append(classes[name] if inside else f"[{classes[name]}]")
            at += 1 + len(name)
            continue
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


@dataclass
class Vocabulary:
    """What a tokenizer file says, in a form that can be broadcast."""

    tokens: list[str]
    merges: dict[tuple[int, int], tuple[int, int]]
    suffix: str
    special: dict[str, int]
    pieces: str
    lower: bool
    byte_decoder: bool
    first: list[int]
    last: list[int]
    #: White space as the inside of a class of ``re``, and lower cases that ``str.lower`` doesn't give.
    blanks: str
    lower_of: dict[int, str] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """Read a ``tokenizers`` JSON file holding a byte-level BPE model, with or without a word-end suffix.

        Whatever the file asks for beyond that raises ``ValueError``.
        """
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, classes = spec["model"], library_classes()

        def need(true: bool, what: str) -> None:
            if not true:
                raise ValueError(f"{path}: {what} is not supported")

        need(model["type"] == "BPE", "a model other than BPE")
        for name in ("byte_fallback", "continuing_subword_prefix", "dropout", "ignore_merges", "unk_token"):
            need(not model.get(name), name)
        for token in spec["added_tokens"]:
            for name in ("single_word", "lstrip", "rstrip", "normalized"):
                need(not token.get(name), f"an added token with {name}")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = _steps(spec["normalizer"], "normalizers")
        folding = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        need(steps in ([], folding), "this normalizer")
        cuts = _steps(spec["pre_tokenizer"], "pretokenizers")
        need(bool(cuts) and cuts[-1]["type"] == "ByteLevel" and not cuts[-1]["add_prefix_space"], "this pre-tokenizer")
        if len(cuts) == 1:
            need(cuts[0].get("use_regex", True) and not steps, "a byte-level pre-tokenizer of this kind")
            pattern = _BYTE_PIECES
        else:
            split = cuts[0]
            need(len(cuts) == 2 and not cuts[1].get("use_regex", True) and bool(steps), "a chain of these pre-tokenizers")
            need(split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed" and "Regex" in split["pattern"], "this splitting")
            pattern = split["pattern"]["Regex"]
        decoder = (spec["decoder"] or {}).get("type")
        need(decoder in (None, "ByteLevel"), f"decoder {decoder}")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        chars = _byte_chars()
        return cls(
            tokens,
            merges,
            suffix,
            special,
            _translated(pattern, classes),
            bool(steps),
            decoder == "ByteLevel",
            [vocab[c] for c in chars],
            [vocab[c + suffix] for c in chars],
            classes["s"],
            library_lower() if steps else {},
        )


def _steps(spec: dict | None, parts: str) -> list[dict]:
    """A normalizer's or pre-tokenizer's steps."""
    return [] if spec is None else spec[parts] if spec["type"] == "Sequence" else [spec]


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges in order of rank, leftmost first, to a list of symbol ids."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:  # stale: one side has been merged meanwhile
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := merges.get((new, symbols[k])):
                heapq.heappush(queue, (found[0], i, new, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := merges.get((symbols[h], new))):
            heapq.heappush(queue, (found[0], h, symbols[h], new, found[1]))
    return [s for s in symbols if s >= 0]


class Cache(dict):
    """Bounded memo of a function of short strings, in two generations: what is still in use outlives a full one."""

    def __init__(self, f=None, size: int = CACHE_BYTES) -> None:
        super().__init__()
        # A slot, a string and a small value with their headers come to about 200 bytes.
        self.f, self.before, self.entries = f, {}, size // 2 // 200

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= CACHED_CHARS:
            self._room()
            self[key] = value
        return value

    def keep_all(self, found: dict) -> None:
        """Take in what was found out elsewhere."""
        self._room()
        self.update({k: v for k, v in found.items() if len(k) <= CACHED_CHARS})

    def _room(self) -> None:
        if len(self) >= self.entries:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Cuts texts and encodes pre-tokens in one process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self.pieces = re.compile(v.pieces).findall
        # A blank starts a pre-token unless more white space follows; letters alone are one pre-token.
        self._breaks = re.compile(f" (?=[{v.blanks}])").search
        self._space = re.compile(f" (?=[^{v.blanks}])").split
        self._odd = _odd_search(_ranges(sorted(v.lower_of))) if v.lower else None
        self.special = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        self.hints = sorted({s[:2] for s in v.special})

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        data = piece.encode("utf-8", "replace")
        symbols = [self.v.first[b] for b in data]
        symbols[-1] = self.v.last[data[-1]]
        return merge_symbols(symbols, self.v.merges)

    def normalize(self, text: str) -> str:
        """Composed form and lower case, character by character; white space is left as it is."""
        if not text.isascii():
            odd = self._odd(text)
            if odd or not unicodedata.is_normalized("NFC", text):
                text = _library_nfc()(text)  # its Unicode version decides
            if odd:
                text = text.translate(self.v.lower_of)
            if "Σ" in text:  # a capital sigma's lower case depends on what follows only in str.lower
                return "".join(map(str.lower, text))
        return text.lower()

    def segments(self, text: str) -> list[str]:
        """The text cut at special tokens, which stand at the odd places."""
        if self.special and any(h in text for h in self.hints):
            return self.special.split(text)
        return [text]

    def chunks(self, segment: str) -> list[str]:
        """Cut so that no pre-token spans a cut. The blank before each chunk but the first belongs to that chunk."""
        return self._space(segment) if self._breaks(segment) else segment.split(" ")


@cache
def _library_nfc():
    from tokenizers import normalizers  # few texts need it

    return normalizers.NFC().normalize_str


@cache
def _odd_search(others: str):
    """Finds characters that Python's Unicode tables don't know, those of the class ``others``, and all beyond the first plane."""
    odd = re.compile(f"[{others}]").match if others else (lambda c: None)
    known = [i for block in _blocks() for i in block if i < 0x10000 and unicodedata.category(chr(i)) != "Cn" and not odd(chr(i))]
    return re.compile(f"[^{_ranges(known)}]").search


class IdEncoder(Encoder):
    """Gives a text's ids as packed 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(vocabulary)
        self.of_piece = Cache(lambda p: np.array(self.piece_ids(p), np.int32).tobytes())
        self.of_first = Cache(lambda c: b"".join([self.of_piece[p] for p in self.pieces(c)]))
        self.of_chunk = self.of_first if vocabulary.lower else Cache(lambda c: b"".join([self.of_piece[p] for p in self.pieces(" " + c)]))

    def packed(self, text: str | None) -> bytes:
        out = []
        for k, segment in enumerate(self.segments(text or "")):
            if k % 2:
                out.append(np.int32(self.v.special[segment]).tobytes())
            elif segment:
                chunks = self.chunks(self.normalize(segment) if self.v.lower else segment)
                out.append(self.of_first[chunks[0]])
                out += map(self.of_chunk.__getitem__, chunks[1:])
        return b"".join(out)


def bpe_encode(spark: SparkSession, text: Column, path: str) -> Column:
    """Token ids, ``array<int>``, of each text, as the file's own library gives them without added special tokens.

    Null and empty texts give an empty array. Special tokens written out inside a text become their ids, the library's
    default. Texts of any length are encoded whole.
    """
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = kept_in_worker(shared.value.key, lambda: IdEncoder(shared.value))
        for batch in slices(batches):
            parts = [encoder.packed(t) for t in batch.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
            ids = np.frombuffer(b"".join(parts), np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return encode(text)


def bpe_decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of each array of ids, special tokens included; null for null.

    Without a decoder in the file the vocabulary strings are joined by blanks, as its library does; a byte-level decoder
    concatenates them and reads the bytes as UTF-8 with replacement characters for what is none.
    """
    v = Vocabulary.load(path)
    shared = spark.sparkContext.broadcast((v.tokens, set(v.special.values()), v.byte_decoder))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, special, byte_decoder = shared.value
        if byte_decoder:
            back = {c: b for b, c in enumerate(_byte_chars())}
            raw = [bytes(back[c] for c in t) if i not in special else t.encode() for i, t in enumerate(vocabulary)]
            for batch in slices(batches):
                yield pa.array([None if x is None else b"".join([raw[i] for i in x]).decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())
            return
        tokens = pa.array(vocabulary, pa.large_string())
        for batch in slices(batches):
            joined = pc.binary_join(_lists(batch, tokens), pa.scalar(" ", pa.large_string()))
            yield joined.cast(pa.string())

    return decode(ids)


def _lists(batch: pa.Array, tokens: pa.Array) -> pa.Array:
    """Each list of ids as a list of its vocabulary strings."""
    flat = tokens.take(batch.flatten())
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.cumsum([0, *lengths], dtype=np.int64), pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, mask=batch.is_null() if batch.null_count else None)
