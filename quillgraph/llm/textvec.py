"""Vectorised text primitives over Arrow string columns.

All operators that must look at every byte of a corpus share these: they work on the UTF-8
buffer of an Arrow batch with numpy, so that no Python loop runs per word or per character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text handled at once, so that helper arrays stay small whatever a batch holds.
CHUNK_BYTES = 2 << 20
#: Bytes of a batch on its way between the JVM and Python.
BATCH_BYTES = 4 << 20
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that belong to a word of letters and digits; those of 128 and more belong to letters.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of few bytes, which the JVM and the worker each hold a copy of.

    The session's limit is lowered, never raised.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(name, "64m").lower())
    size = int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] if now else 1 << 30
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def pieces(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by the bytes of their column `at`, as :func:`chunks` cuts documents.

    A batch has a fixed number of rows, whatever their size; what is done to a piece at once (a
    cast, a copy in lower case) then takes little memory beside the batch itself.
    """
    for batch in batches:
        column = batch.column(at)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for lo, hi in chunks(np.concatenate([[0], np.cumsum(size, dtype=np.int64)])):
            yield batch.slice(lo, hi - lo)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `most` bytes together, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes of the class `member` in a document."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = member[data]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[offsets] = True  # a document's first byte follows no other; offsets[-1] == n
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def char_starts(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte (one entry more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        run = np.full(size, base, np.uint64)
        run[0] = 1
        have = np.cumprod(run, dtype=np.uint64)
        if size == CHUNK_BYTES + 1:
            _POWERS[base] = have  # longer ones (a giant document) aren't kept
    return have[:n]


class PrefixHash:
    """Polynomial hash of every substring of a byte buffer, each in constant time.

    ``sums[i]`` is the sum of code(b_j) * BASE**j over j < i modulo 2**64; because BASE is odd
    it has an inverse, so sums differences can be shifted to a common origin.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(BASE_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of `x`."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Of a sorted array of document numbers: where k successive entries are of one document."""
    if len(doc) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
