"""Quality rules by compression bands.

A text's zstandard ratio (bytes over compressed bytes) says how repetitive it is.  Ordinary prose
lies in a band that depends on its length, since a short text can't yet refer back to itself.  The
whole document is held against the band of its length, and every fixed chunk of it against the
band of the chunk's length, so that one repetitive or incompressible stretch in a long document
isn't averaged away.

Defined cases: a null, empty or blank text has no ratio, reason ``empty`` and is rejected; a text
shorter than the first band is too short to judge and is kept; a repeated row gets the same
verdict again; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textvec

SCHEMA = (
    "doc_id bigint, n_bytes bigint, ratio double, n_chunks int, min_chunk_ratio double, max_chunk_ratio double,"
    " bad_chunk_share double, reason string, keep boolean"
)


@dataclass(frozen=True)
class Bands:
    """(least bytes, least ratio, largest ratio) for rising lengths; ratios outside are rejected.

    base64 stays under 1.35 at any length and random bytes near 1; prose lies between about 1.5
    at 1 kB and 4 in long texts.  Short texts get a low floor, as the frame header and an empty
    dictionary weigh on them.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (200, 0.9, 2.3),
        (500, 1.1, 3.0),
        (1_000, 1.25, 4.0),
        (4_000, 1.4, 5.0),
        (16_000, 1.4, 6.0),
        (64_000, 1.4, 6.5),
    )
    chunk_bytes: int = 4096
    level: int = 3
    #: A document whose share of chunks outside their band exceeds this is rejected.
    bad_share: float = 0.3

    def judge(self, n: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """-1 incompressible, 1 repetitive, 0 within the band or too short."""
        least = np.array([x[0] for x in self.limits])
        at = np.searchsorted(least, n, "right") - 1
        low = np.array([x[1] for x in self.limits])[at]
        high = np.array([x[2] for x in self.limits])[at]
        return np.where(at < 0, 0, np.where(ratio < low, -1, np.where(ratio > high, 1, 0)))


def _verdicts(batch: pa.RecordBatch, bands: Bands, squeeze: zstandard.ZstdCompressor) -> pa.RecordBatch:
    data, offsets = textvec.utf8(batch.column(1))
    n_docs, size = len(batch), np.diff(offsets)
    whole, part, part_doc, part_size = np.full(n_docs, np.nan), [], [], []
    view, blank = memoryview(np.ascontiguousarray(data)), np.ones(n_docs, bool)
    for i in range(n_docs):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b or textvec.SPACE[data[a:b]].all():
            continue
        blank[i] = False
        whole[i] = (b - a) / len(squeeze.compress(view[a:b]))
        if b - a <= bands.chunk_bytes:
            part.append(whole[i]), part_doc.append(i), part_size.append(b - a)
            continue
        for c in range(a, b, bands.chunk_bytes):
            d = min(b, c + bands.chunk_bytes)
            part.append((d - c) / len(squeeze.compress(view[c:d]))), part_doc.append(i), part_size.append(d - c)
    ratio, of, sizes = np.array(part), np.array(part_doc, np.int64), np.array(part_size, np.int64)
    n_chunks = np.bincount(of, minlength=n_docs)
    bad = np.bincount(of, bands.judge(sizes, ratio) != 0, n_docs) / np.maximum(n_chunks, 1)
    least, most = np.full(n_docs, np.inf), np.full(n_docs, -np.inf)
    np.minimum.at(least, of, ratio)
    np.maximum.at(most, of, ratio)
    kind = bands.judge(size, np.where(blank, 1.0, whole))
    reason = np.where(blank, "empty", np.where(kind > 0, "repetitive", np.where(kind < 0, "incompressible", np.where(bad > bands.bad_share, "bad_chunks", "ok"))))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).cast(pa.int64()),
            pa.array(size),
            pa.array(whole, mask=blank),
            pa.array(n_chunks.astype(np.int32)),
            pa.array(least, mask=blank),
            pa.array(most, mask=blank),
            pa.array(bad),
            pa.array(reason.tolist(), pa.string()),
            pa.array(reason == "ok"),
        ],
        names=["doc_id", "n_bytes", "ratio", "n_chunks", "min_chunk_ratio", "max_chunk_ratio", "bad_chunk_share", "reason", "keep"],
    )


def compression_quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One verdict per row of `docs` (doc_id, text); a map over partitions, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in textvec.pieces(batches, 1):
            yield _verdicts(batch, bands, squeeze)

    return textvec.arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
