"""Byte-level BPE on a sentencepiece model serialised from a rank vocabulary.

Every byte is written as one printable character, so a vocabulary of byte
strings becomes a vocabulary of ordinary pieces; a piece of rank r scores -r
and normalisation is the identity. sentencepiece then merges, within one
pre-token, the adjacent pair whose joined piece has the lowest rank, which is
byte-level BPE. Decoding is the inverse mapping of ids to bytes.

Null texts count as empty (no ids, no bytes); repeated rows are kept; other
columns than the two named are dropped; an empty table gives an empty table.
Texts of any length are encoded whole, one at a time, in memory as their tokens
take.
"""
from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .batches import by_bytes

#: Pre-tokens longer than this are encoded anew each time; the memo is emptied at MEMO entries.
MEMO_CHARS, MEMO = 64, 250_000
ROWS = 128


def byte_chars() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next of U+0100 and up."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a ``.tiktoken`` file by rank; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out  # type: ignore[return-value]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is vocabulary[i]; the unknown piece comes last."""
    chars = byte_chars()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))

    pieces = [piece("".join(map(chars.__getitem__, t)), float(-r), 1) for r, t in enumerate(vocabulary)]
    pieces.append(piece("<unk>", 0.0, 2))
    # trainer: model_type (3) BPE = 2, vocab_size (4), unk_id (40)
    trainer = b"\x18\x02" + b"\x20" + _varint(len(pieces)) + _varint(40 << 3) + _varint(len(vocabulary))
    # normalizer: identity, no dummy prefix, no space removal, no space escaping
    normal = _field(1, b"identity") + b"\x18\x00" + b"\x20\x00" + b"\x28\x00"
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class ByteBpe:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.bytes_of = vocabulary
        self.whole = {t: r for r, t in enumerate(vocabulary)}
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.split = regex.compile(pattern).findall
        self.ascii_split = re.compile(ascii_pattern(pattern)).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(vocabulary))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}
        self.back: dict[str, bytes] = {}
        self.names = [str(i) for i in range(len(vocabulary))]

    def find(self, text: str) -> list[str]:
        return self.ascii_split(text) if text.isascii() else self.split(text)

    def _fresh(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens: one call for all, parted by a character that no piece holds, so that nothing merges across."""
        out, ask, mapped = {}, [], []
        for t in tokens:
            raw = t.encode()
            if (r := self.whole.get(raw)) is not None:
                out[t] = (r,)
            else:
                ask.append(t)
                mapped.append(t.replace(" ", self.table[32]) if t.isascii() and t.isprintable() else raw.decode("latin-1").translate(self.table))
        if ask:
            ids, at, unknown = self.model.encode("\n".join(mapped), out_type=int), 0, len(self.bytes_of)
            for t in ask:
                end = ids.index(unknown, at) if t is not ask[-1] else len(ids)
                out[t] = tuple(ids[at:end])
                at = end + 1
        return out

    def encode(self, text: str) -> list[int]:
        tokens = self.find(text)
        memo = self.memo
        extra = None
        if new := [t for t in {*tokens} if t not in memo]:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = [*{*tokens}]
            got = self._fresh(new)
            memo |= {t: i for t, i in got.items() if len(t) <= MEMO_CHARS}
            extra = {t: i for t, i in got.items() if len(t) > MEMO_CHARS}
        if not extra:
            return list(chain.from_iterable(map(memo.__getitem__, tokens)))
        return list(chain.from_iterable(extra[t] if t in extra else memo[t] for t in tokens))

    def written(self, text: str) -> tuple[str, bytes]:
        """The ids as decimals joined by spaces, and the bytes they decode to, both put together from those of the pre-tokens."""
        tokens = self.find(text)
        said, back = self.said, self.back
        long = [t for t in {*tokens} if len(t) > MEMO_CHARS]
        if new := [t for t in {*tokens} if t not in said]:
            if len(said) + len(new) > MEMO:
                said.clear()
                back.clear()
                new = [*{*tokens}]
            for t, ids in self._fresh(new).items():
                said[t] = self.id_text(ids)
                back[t] = self.decode(ids)
        out = " ".join(map(said.__getitem__, tokens)), b"".join(map(back.__getitem__, tokens))
        for t in long:
            del said[t], back[t]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def ascii_pattern(pattern: str) -> str:
    """The pattern for texts of ASCII alone, for the faster standard matcher: classes are written out."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")


_held: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of a vocabulary file, built once per Python worker."""
    if (path, pattern) not in _held:
        _held[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _held[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes each text; returns id, ``ids`` (array<int>) and ``decoded`` (binary).

    With ``digests`` it returns ``n_tokens`` and the SHA-256 digests of the ids
    and of the decoded bytes instead, so that nothing as large as the text
    leaves the worker.
    """

    ship(df.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for part in by_bytes(batch, 1, ROWS):
                keys, counts, first, second = part.column(0), [], [], []
                for text in part.column(1).to_pylist():
                    if digests:
                        said, raw = c.written(text or "")
                        counts.append(said.count(" ") + bool(said))
                        first.append(sha(said.encode()).hexdigest())
                        second.append(sha(raw).hexdigest())
                    else:
                        first.append(c.encode(text or ""))
                        second.append(c.decode(first[-1]))
                if digests:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.binary())], [id_col, "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small acyclic tuples: nothing to collect
        try:
            yield from coded(batches)
        finally:
            gc.enable()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
