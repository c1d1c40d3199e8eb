"""Vectorised word and shingle hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
#: Folded words: ASCII letters in lower case, every other ASCII character but digits counts as a blank.
_FOLD = _AS_IS.copy()
_FOLD[0x41:0x5B] += 0x20
_FOLD_BLANK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = U(pow(int(_P), -1, 1 << 64))
#: Bytes hashed at once; one longer text makes a longer piece of its own.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser (fixed public constants); wraps around by design."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    up = np.ones(1, dtype=U)
    down = np.ones(1, dtype=U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + 1)
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                steps = np.full(size, base, dtype=U)
                steps[0] = U(1)
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def word_hashes(column: pa.Array, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces (first row, word hashes, word count per row) that cover the column in order; a null text has no words.

    A word is a maximal run of bytes other than the six ASCII blanks. Its hash is a polynomial in its bytes modulo
    2 ** 64, taken from prefix sums over the piece, and then mixed with its length. With ``fold``, words are runs of letters
    and digits, ASCII letters in lower case.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        last = min(last, rows)
        begin, end = int(offsets[row]), int(offsets[last])
        text = data[begin:end]
        size = end - begin
        counts = np.zeros(last - row, dtype=np.int64)
        if size == 0:
            yield row, np.zeros(0, dtype=U), counts
            row = last
            continue
        blank = (_FOLD_BLANK if fold else _BLANK)[text]
        if fold:
            text = _FOLD[text]
        starts_row = np.zeros(size + 1, dtype=bool)
        starts_row[offsets[row:last] - begin] = True
        first = ~blank
        first[1:] &= blank[:-1] | starts_row[1:size]
        final = ~blank
        final[:-1] &= blank[1:] | starts_row[1:size]
        a, b = np.flatnonzero(first), np.flatnonzero(final) + 1
        up, down = _Powers.of(size + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, dtype=U)
            np.cumsum((text.astype(U) + U(1)) * up[:size], out=sums[1:])
            hashes = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))
        bounds = np.searchsorted(a, offsets[row : last + 1] - begin)
        counts = np.diff(bounds)
        yield row, hashes, counts
        row = last


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a text with fewer (but some) has one shingle of all its words."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < width:
            out = U(n)
            for w in words:
                out = out * U(0xC2B2AE3D27D4EB4F) + w
            return mix(np.array([out], dtype=U))
        out = words[: n - width + 1].copy()
        for k in range(1, width):
            out = out * U(0xC2B2AE3D27D4EB4F) + words[k : n - width + 1 + k]
        return mix(out)


def per_row(column: pa.Array, fold: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each row in turn."""
    for _, hashes, counts in word_hashes(column, fold):
        at = 0
        for c in counts.tolist():
            yield hashes[at : at + c]
            at += c
