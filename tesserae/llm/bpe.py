"""Byte-level BPE: encoding with a queue of merge ranks over a linked symbol list, and decoding.

A word's symbols form a doubly linked list. Every neighbouring pair that the vocabulary can merge waits in a heap by
(rank, place); popping the lowest merges it, unless one of its symbols has changed since it was queued (a stale entry,
skipped). Decoding concatenates vocabulary strings. Words repeat, so each worker keeps the encodings it has made, up to a
bound that only limits memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tesserae.runtime import ship

#: How a text falls into words before merging (fixed value of the byte-level scheme).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same rule for texts whose letters are ASCII or Latin up to U+024F and that have no other odd character; ``re`` is then faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
ODD = re.compile(rf"[^\t\n\r\x20-\x7E{LATIN}]")
CACHED_WORDS = 1_000_000
CACHED_LENGTH = 64
_TYPES = {"long": LongType(), "string": StringType(), "array<int>": ArrayType(IntegerType())}


def byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable, else the next free character from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class BpeCodec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        to_byte = {c: b for b, c in chars.items()}
        odd = [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and spec.get("normalizer"))]
        if spec.get("normalizer") or odd:
            raise ValueError(f"{path}: normalisers and added tokens that strip, join or stand alone are not supported: {odd}")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.byte_ids = [vocab[chars[b]] for b in range(256)]
        #: left id * size + right id -> rank; rank -> id of the merged symbol.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] * self.size + vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.split = regex.compile(SPLIT)
        names = sorted(added, key=len, reverse=True)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.cache: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of one word's bytes."""
        ids, size, find, merged = [self.byte_ids[b] for b in raw], self.size, self.ranks.get, self.merged
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # One integer per entry, rank above place: the least is the lowest rank, leftmost first.
        queue = [(r << 32) | i for i in range(n - 1) if (r := find(ids[i] * size + ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or find(ids[i] * size + ids[j]) != rank:
                continue
            ids[i], ids[j] = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := find(ids[i] * size + ids[k])) is not None:
                    heappush(queue, (r << 32) | i)
            if (h := before[i]) >= 0 and (r := find(ids[h] * size + ids[i])) is not None:
                heappush(queue, (r << 32) | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        out = np.array(self.merge(word.encode()), dtype="<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = out
        return out

    def _plain(self, text: str, out: list[bytes]) -> None:
        known, make = self.cache.get, self._word
        words = (self.split if ODD.search(text) else PLAIN).findall(text)
        out.extend([known(w) or make(w) for w in words])

    def encode_packed(self, text: str) -> bytes:
        """Ids as consecutive little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self.special is None or not any(s in text for s in self.added):
            self._plain(text, out)
        else:
            for part in self.special.split(text):
                if part in self.added:
                    out.append(np.array([self.added[part]], dtype="<u4").tobytes())
                elif part:
                    self._plain(part, out)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes that are not UTF-8 become replacement characters; an id outside the vocabulary is an error."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def _append(batch: pa.RecordBatch, arrays: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *schema.names])


def _without(df: DataFrame, to: str, source: str) -> DataFrame:
    if to.lower() == source.lower():
        raise ValueError(f"the result needs another name than {source}")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != to.lower()])


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with an int array column of token ids. A null or empty text has no ids; a text of any length is encoded whole.

    Rows stand alone, so repeats agree; an empty table gives an empty result. An existing column ``to`` is replaced.
    """
    ship(docs.sparkSession)
    docs = _without(docs, to, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        schema = pa.schema([(to, pa.list_(pa.int32()))])
        for b in batches:
            packed = [c.encode_packed(t or "") for t in b.column(text).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype("int32")
            values = np.frombuffer(b"".join(packed), dtype="<u4").astype("int32")
            yield _append(b, [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], schema)

    return docs.mapInArrow(run, docs.withColumn(to, F.array().cast("array<int>")).schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of the id array; null ids give a null text, no ids an empty one.

    Rows stand alone; an empty table gives an empty result. An existing column ``to`` is replaced.
    """
    ship(rows.sparkSession)
    rows = _without(rows, to, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        schema = pa.schema([(to, pa.string())])
        for b in batches:
            yield _append(b, [pa.array([None if x is None else c.decode(x) for x in b.column(ids).to_pylist()], pa.string())], schema)

    return rows.mapInArrow(run, rows.withColumn(to, F.lit("x")).schema)


def round_trip(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every whole text in one pass: the columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    A null text counts as empty: no tokens and the digests of nothing. Rows stand alone, so repeats agree; an empty
    table gives an empty result. Columns of ``docs`` that are not in ``keep`` never leave the JVM.
    """
    ship(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("ids", "array<int>")] * ids]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, ids_sha, text_sha, all_packed = [], [], [], []
            for value in batch.column(width):
                packed = c.encode_packed(value.as_py() or "")
                got = np.frombuffer(packed, dtype="<u4").tolist()
                raw = c.decode_bytes(got)
                try:
                    raw.decode("utf-8")
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", errors="replace").encode()
                counts.append(len(got))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(raw).hexdigest())
                if ids:
                    all_packed.append(packed)
            arrays = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
                values = np.frombuffer(b"".join(all_packed), dtype="<u4").astype("int32")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
            names = [*batch.schema.names[:width], *(n for n, _ in made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], names=names)

    schema = StructType([*source.schema.fields[:width], *[StructField(n, _TYPES[t]) for n, t in made]])
    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in made])
