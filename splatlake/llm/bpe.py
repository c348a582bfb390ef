"""Operator 6: byte-level BPE through sentencepiece, without training.

A sentencepiece model file is serialised straight from a rank vocabulary: every token's bytes become one character each
(byte b is character U+0100 + b, which no normaliser touches), its score is its negative rank, so sentencepiece's merges run in
rank order; the normaliser is the identity. Texts are cut by the pre-token pattern, each pre-token is looked up whole and else
encoded by the model; ids are decoded by the inverse byte map.

Null is the empty text: no ids. Null ids are kept, repeated rows get equal digests, an empty table gives an empty result, and extra columns are not read. Texts of any length are handled pre-token by pre-token. The cache of pre-tokens holds
``CACHE`` entries and is emptied when full, which changes no result.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

CACHE = 1 << 18
BYTE_CHARS = "".join(chr(0x100 + b) for b in range(256))
#: Characters on which the interpreter's own classes and Unicode's letters, numbers and white space agree.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited bytes, or a varint (negative ones as 64 bits)."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value % 2**64)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_piece(token: bytes) -> str:
    return codecs.charmap_decode(token, "strict", BYTE_CHARS)[0]


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the ranks 0..n-1; one unknown piece follows them, as the format wants."""
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _field(1, _field(1, as_piece(token).encode()) + score(-float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2))
    n = len(ranks)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def codec(path: str, pattern: str) -> "Codec":
    return Codec(read_ranks(path), pattern)


class _Words(dict):
    """Packed ids of pre-tokens; what is missing is encoded by the model."""

    def __init__(self, model, ranks: dict[bytes, int]) -> None:
        self.model, self.ranks = model, ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        token = word.encode()
        ids = [self.ranks[token]] if token in self.ranks else self.model.encode(as_piece(token))
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Codec:
    """Encodes texts to packed little-endian ids, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import sentencepiece

        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0..n-1")
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        back = {c: k for k, c in enumerate(BYTE_CHARS)}
        self.tokens = [bytes(back[c] for c in model.id_to_piece(k)) for k in range(len(ranks))]
        self.words = _Words(model, ranks)
        # White space as Unicode has it, which leaves out the separators \x1c-\x1f.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.split_plain = None if r"\p" in plain else re.compile(plain).findall

    def encode(self, text: str) -> bytes:
        split = self.split_plain if self.split_plain and not PLAIN(text) else self.split
        return b"".join(map(self.words.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


def _digests(path: str, pattern: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in utf8(batch.column(text_at)):
                packed = c.encode(text.decode())
                counts.append(len(packed) // 4), ids.append(hashlib.sha256(packed).hexdigest()), texts.append(hashlib.sha256(c.decode(packed)).hexdigest())
            columns = [batch.column(k) for k in range(batch.num_columns) if k != text_at] + [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    return run


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [memoryview(c.encode(t.decode())).cast("I").tolist() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return run


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(struct.pack(f"<{len(x or ())}I", *(x or ()))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "bytes"])

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each text."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    return small_batches(rows).mapInArrow(_ids(path, pattern), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes that the ids stand for; null ids give none."""
    return rows.select(id_col, ids_col).mapInArrow(_texts(path, pattern), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, bytes binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids, and digests both."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    return small_batches(rows).mapInArrow(_digests(path, pattern, 1), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Token digests of every document under the 50k byte-level vocabulary."""
    import public_tokenizers as P

    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
