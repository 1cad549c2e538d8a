"""Encoding a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised directly from the vocabulary: each token's bytes are spelled in an
alphabet of 256 visible characters, and a piece's score is its negative rank, so that sentencepiece joins
the pair with the lowest rank first, as byte-level BPE does. Normalisation is the identity. Texts are split
into pre-tokens; each distinct pre-token is encoded once per worker and kept. Decoding goes back through
the inverse of the spelling.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import spread

VOCABULARY = "byte_bpe_50k"

# The contractions and classes of the vocabulary's published splitting pattern. White space is
# that of Unicode's White_Space property; Python's \s would add four control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Distinct pre-tokens that a worker keeps; beyond that it starts over. Only a matter of memory.
KEPT = 400_000
#: Characters that are worked on at once, so that memory doesn't grow with the batch.
CHUNK = 4_000_000


@lru_cache(1)
def _splitters():
    import regex

    ascii_only = re.compile(CONTRACTIONS + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
    anything = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    return ascii_only.findall, anything.findall


def pretokens(text: str) -> list[str]:
    """The pieces that merges never cross; together they are the text."""
    ascii_only, anything = _splitters()
    return ascii_only(text) if text.isascii() else anything(text)


@lru_cache(1)
def alphabet() -> list[str]:
    """A visible character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: int and bool as varint, float as fixed32, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece n spells the token of rank n; the id after the last is unknown."""
    spell = alphabet()
    size = max(ranks.values()) + 1
    by_rank = dict(zip(ranks.values(), ranks.keys()))
    pieces = []
    for n in range(size):
        word = by_rank.get(n)
        text = f"{n}" if word is None else "".join(spell[b] for b in word)  # a rank without a token is never met
        pieces.append(_field(1, _field(1, text.encode()) + _field(2, float(-n)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    # fixed values: field numbers of the public sentencepiece_model.proto (model_type BPE is 2, off ids are -1)
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, f))}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Tokenizer:
    """Encodes and decodes with the vocabulary in the file ``path``."""

    def __init__(self, path: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self._spell = str.maketrans({chr(b): c for b, c in enumerate(alphabet())})
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self._bytes = {c: b for b, c in enumerate(alphabet())}
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the pre-tokens that aren't known yet."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._spell) for w in new]
            self.known.update(zip(new, map(tuple, self._model.encode(spelled, num_threads=1))))

    def encode(self, text: str | None) -> list[int]:
        """The ids; none for an empty and for a null text."""
        words = pretokens(text or "")
        self.learn(set(words))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        spelled = "".join(self._model.id_to_piece(list(ids)))
        return bytes(map(self._bytes.__getitem__, spelled)).decode("utf-8", "surrogatepass")

    def encode_chunk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        split = [pretokens(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.known.__getitem__
        flat = [list(chain.from_iterable(map(get, words))) for words in split]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        return np.fromiter(chain.from_iterable(flat), np.int32, int(sizes.sum())), sizes


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows of about ``most`` characters; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, texts.slice(first, i - first).to_pylist()
            first, total = i, 0
        total += int(n)
    if first < len(texts):
        yield first, texts.slice(first).to_pylist()


def encode_column(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of each row. An empty and a null text have an empty list. One narrow stage: each executor
    encodes what it reads; nothing is shuffled. Repeated and further columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                ids, sizes = encoder.encode_chunk(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[key, "ids"])

    rows = spread(documents.select(key, text))
    out = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, out)


def token_counts(documents: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for first, texts in chunks(batch.column(batch.num_columns - 1)):
                for i, t in enumerate(texts, first):
                    if t:
                        words = pretokens(t)
                        encoder.learn(set(words))
                        counts[i] = sum(map(len, map(encoder.known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*keep, "tokens"])

    rows = spread(documents.select(*keep, text))
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("tokens", T.LongType())]))
