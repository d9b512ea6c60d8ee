"""Byte-level BPE by a sentencepiece model that is serialised directly from a vocabulary of ranks.

Each byte is mapped to a printable character, each token to the piece of its mapped bytes, with its negative rank
as score, so that the model merges the pair of lowest rank first, the leftmost of equals. Normalisation is the identity,
no blanks are added, removed or escaped. Texts are split by the tokenizer's pattern and each pre-token is encoded on
its own; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import ChainMap
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers, and the longest one it does, in characters: 256 bytes each or so.
MEMORY, LONGEST = 150_000, 64
#: Characters of the texts whose new pre-tokens are merged in one call.
GROUP = 400_000


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it has a visible Latin-1 form, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a file of base64 tokens and ranks; the ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))]


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol buffer."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of type BPE: piece 0 stands for the unknown, piece i + 1 for the token of rank i."""
    characters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, b"<unknown>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, "".join(map(characters.__getitem__, t)).encode()) + _field(2, -float(i)) + _field(3, normal) for i, t in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.mapping = dict(enumerate(byte_characters()))
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        raw = [x.encode() for x in new]
        whole = [self.ranks.get(x) for x in raw]  # a pre-token that is a token needs no merges
        parts = [x.decode("latin-1").translate(self.mapping) for x, w in zip(raw, whole, strict=True) if w is None]
        merged = iter(self.model.encode(parts, out_type=int, num_threads=1) if parts else [])
        return {x: (w,) if w is not None else tuple(i - 1 for i in next(merged)) for x, w in zip(new, whole, strict=True)}

    def encode_many(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of whole texts, without special tokens; pre-tokens that are new are merged together for ``GROUP`` characters or so."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.split(text))
            size += len(text)
            if size >= GROUP:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> Iterator[list[int]]:
        needed = set().union(*group)
        learned = self._learn([w for w in needed if w not in self.known])
        if len(self.known) + len(learned) > MEMORY:
            learned |= {w: self.known[w] for w in needed if w in self.known}
            self.known = {}
        look = ChainMap(self.known, learned).__getitem__ if any(len(w) > LONGEST for w in learned) else None
        self.known |= {w: ids for w, ids in learned.items() if len(w) <= LONGEST}
        look = look or self.known.__getitem__
        for words in group:
            yield list(chain.from_iterable(map(look, words)))

    def encode(self, text: str) -> list[int]:
        """Ids of one whole text."""
        return next(self.encode_many([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(packed: bytes, pattern: str) -> Codec:
    return Codec([base64.b64decode(x) for x in packed.split(b"\n")], pattern)


class ByteBpe:
    """Column functions of one vocabulary file; the file is read where the plan is made and its tokens travel with the functions."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.packed = b"\n".join(map(base64.b64encode, read_ranks(path or public_tokenizers.path(VOCABULARY))))
        self.pattern = pattern or public_tokenizers.PATTERN

    def encode(self, text: Column | str) -> Column:
        """Array of ids of a text; null for null."""
        packed, pattern = self.packed, self.pattern

        @F.arrow_udf("array<int>")
        def of(texts: pa.Array) -> pa.Array:
            codec = _codec(packed, pattern)
            known = texts.is_valid().to_pylist()
            found = codec.encode_many(x.as_py() for x in texts if x.is_valid)
            return pa.array([next(found) if k else None for k in known], pa.list_(pa.int32()))

        return of(text)

    def decode(self, ids: Column | str) -> Column:
        """Bytes of an array of ids; null for null."""
        packed, pattern = self.packed, self.pattern

        @F.arrow_udf("binary")
        def of(arrays: pa.Array) -> pa.Array:
            codec = _codec(packed, pattern)
            return pa.array([None if x is None else codec.decode(x) for x in arrays.to_pylist()], pa.binary())

        return of(ids)

    def round_trip(self, text: Column | str, with_ids: bool = False) -> Column:
        """Struct (n_tokens, ids_sha256, decoded_sha256) of a text encoded and decoded again; null counts as empty.

        One pass in the worker, so that the ids don't travel from Python to the JVM and back; with ``with_ids`` they are a
        further field ``ids``.
        """
        packed, pattern = self.packed, self.pattern

        @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
        def of(texts: pa.Array) -> pa.Array:
            codec = _codec(packed, pattern)
            digits = [str(i) for i in range(len(codec.tokens))]
            counts, encoded, decoded, kept = [], [], [], []
            for ids in codec.encode_many(x.as_py() or "" for x in texts):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, dtype=np.int32))
            arrays = [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.StructArray.from_arrays(arrays, names)

        return of(text)


def bpe_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: ByteBpe | None = None) -> DataFrame:
    """Per row: id, number of tokens, and digests of the ids and of the decoded bytes.

    Null texts count as empty (no ids); ids may be null or repeated; an empty table gives no rows; other columns are ignored.
    """
    coded = documents.select(F.col(id_col), (codec or ByteBpe()).round_trip(text_col).alias("_bw_coded"))
    return coded.select(id_col, "_bw_coded.*")
