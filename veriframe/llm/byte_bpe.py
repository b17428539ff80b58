"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by the vocabulary's pattern; every piece is mapped byte by byte to printable characters and merged by the
tokenizers library, once for each distinct piece that a task meets.  A rank file becomes a merge list by naming every
split of every token into two tokens, in the order of ranks, and pieces that are tokens themselves aren't merged at all.
Decoding looks the bytes of every id up and joins them; a character whose bytes are split over tokens comes back whole,
and in the offsets each of those tokens gets the whole character's place.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded each; an empty table gives an empty
result; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, worker_keeps

#: Distinct pieces that a worker keeps in each of two generations; the older one goes when the newer is full.
CACHE_PIECES = 250_000
#: Pieces that are looked up together.
LEARN_PIECES = 200_000
#: The same cuts as public_tokenizers.PATTERN makes; its letters are tried first, as most pieces are words.
PIECES = r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts within the first 256 characters: fixed values are their letters, numbers and white space.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_LATIN = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+").findall


def latin(text: str) -> bool:
    """Whether all characters are among the first 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary: a tokenizers file (.json) or a rank file (.tiktoken)."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, models, pre_tokenizers

        general = regex.compile(pattern).findall
        # Python's own matcher is twice as fast where the classes are small
        self._split = (lambda t: _LATIN(t) if latin(t) else general(t)) if pattern in (PIECES, public_tokenizers.PATTERN) else general
        shown = byte_characters()
        if path.endswith(".json"):
            self._tokenizer = Tokenizer.from_file(path)
            self._tokenizer.encode_special_tokens = True
            back = {c: b for b, c in enumerate(shown)}
            table = {i: bytes(back[c] for c in t) for t, i in self._tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
            table = {r: t for t, r in ranks.items()}
            text = lambda t: "".join(map(shown.__getitem__, t))
            merges = [(text(t[:k]), text(t[k:])) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
            self._tokenizer = Tokenizer(models.BPE({text(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
        # pieces come cut already; the bytes are still to be mapped
        self._tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self._lengths = np.array([len(b) for b in self._bytes], dtype=np.int64)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Makes all of ``pieces`` known; what the older generation has isn't merged again."""
        if len(self._known) > CACHE_PIECES:
            self._older, self._known = self._known, {}
        missing = pieces.difference(self._known)
        known = self._older.keys() & missing
        self._known.update(zip(known, map(self._older.__getitem__, known), strict=True))
        new = list(missing.difference(known))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            encoding = self._tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(encoding.ids, dtype="<u4")
            # a piece's tokens end where its bytes do
            sizes = np.cumsum(np.fromiter((len(p.encode()) for p in part), dtype=np.int64, count=len(part)))
            cuts = 4 * (np.searchsorted(np.cumsum(self._lengths[ids]), sizes) + 1)
            raw, at = ids.tobytes(), 0
            for p, b in zip(part, cuts.tolist(), strict=True):
                self._known[p] = raw[at:b]
                at = b

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < LEARN_PIECES):
                cut.append(self._split(texts[at]))
                size += len(cut[-1])
                at += 1
            self._learn(set(chain.from_iterable(cut)))
            known = self._known.__getitem__
            for pieces in cut:
                yield b"".join(map(known, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_texts([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token; a token with a part of a character has the whole of it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        number = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character that each byte belongs to
        stop = np.cumsum(self._lengths[np.frombuffer(ids, dtype="<u4")])
        start = stop - self._lengths[np.frombuffer(ids, dtype="<u4")]
        return (number[start], number[stop - 1] + 1) if len(stop) else (stop, stop)


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, until it does something else."""
    return worker_keeps((path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ids array<int>, and starts and ends array<int>: the characters of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                coded = list(c.encode_texts(texts))
                places = [c.offsets(t, i) for t, i in zip(texts, coded, strict=True)]
                whole = lambda arrays: pa.array([np.asarray(a).astype(np.int32) for a in arrays], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), whole([np.frombuffer(i, dtype="<u4") for i in coded]), whole([p[0] for p in places]), whole([p[1] for p in places])], ["id", "ids", "starts", "ends"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(lean(run), f"`{id_column}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column`` and text from ``ids``; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(np.array(i or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(lean(run), f"`{id_column}` {kind}, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, within one task each."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for ids in c.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
