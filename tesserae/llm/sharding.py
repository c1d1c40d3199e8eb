"""Sharding: a Feistel permutation of global row numbers, kept inside [0, n) by cycle walking.

Position p of the permuted order goes to shard p % shards and slot p // shards, so shard counts differ by at most
one and slots have no gaps. The place of any row is computed from its number alone, and ``source_row`` inverts it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import fresh, global_row_number
from tesserae.runtime import ship

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser (fixed public constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Feistel:
    """A keyed permutation of [0, n) and its inverse, over numpy arrays.

    Two halves of equal width cover the smallest power of four that is at least n; a value that lands outside [0, n)
    is sent through again until it lands inside. Both walks follow one cycle of the larger permutation, so they end.
    """

    def __init__(self, n: int, seed: int = 0) -> None:
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed & (2**64 - 1)))

    def _pass(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        h, low = _U(self.half), _U((1 << self.half) - 1)
        a, b = x >> h, x & low
        for k in keys:
            if back:
                a, b = b ^ (_mix(a + k) & low), a
            else:
                a, b = b, a ^ (_mix(b + k) & low)
        return (a << h) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            keys = self.keys[::-1] if back else self.keys
            out = self._pass(np.asarray(x).astype(_U), keys, back)
            while (outside := out >= _U(self.n)).any():
                out[outside] = self._pass(out[outside], keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, back=False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, back=True)


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of each row number in the shuffled order, vectorised over Arrow batches."""

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Feistel(n, seed)
        for b in batches:
            yield pd.Series(p.forward(b.to_numpy()))

    return place(row)


def source_row(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that was dealt to ``slot`` of ``shard``."""
    return int(Feistel(n, seed).inverse(np.array([slot * shards + shard]))[0])


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, size, text_crc32, global_row, shard and slot.

    Global rows number the documents in the order of ``keep``, then checksum and size, so neither files nor
    partitions matter; rows equal in all of these are interchangeable. Size is the text's UTF-8 bytes plus 1;
    a null text has no bytes and checksum 0. Null keys sort first. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    text = F.col("text")
    narrow = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("__size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"),
    )
    row = fresh(narrow, "__row")
    numbered, n = global_row_number(narrow, [*keep, "__crc", "__size"], row, "shard-rows")
    place = fresh(narrow, "__place")
    dealt = numbered.withColumn(place, permuted(F.col(row), n, seed))
    return dealt.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col(row).alias("global_row"),
        (F.col(place) % shards).cast("int").alias("shard"),
        F.floor(F.col(place) / shards).cast("long").alias("slot"),
    )
