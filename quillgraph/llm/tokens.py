"""Token counts by section, from one encoding of the whole document.

Counting each section by itself gives other tokens than the document has, since merges may reach
over a boundary.  So a document is encoded once, its tokens' byte lengths give their character
spans, and these are interval-joined to the sections' spans.  A token that crosses boundaries is
counted once: in the section that holds most of its characters, of equal ones the earlier.

A section is a paragraph: the text up to and with the next run of line feeds, so that sections
tile the text.  Part of a character (a byte-level token may have that) counts as the character.

Defined cases: a null or empty text is one section, number 0 from 0 to 0, without tokens; a text
of line feeds only is one section; texts of any length and of any run of
white space are encoded whole; strings of special
tokens are ordinary text; repeated rows give their rows again; an empty table gives an empty
result; a null doc_id is carried along, and other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from . import textvec

SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens int, n_crossing int"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space (what the pattern's `\s` means) in a run for which the pattern's lookahead would need too much of its stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a ranks file, and the byte length of each of its tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def encoded(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Tokens of a text of any length.

    A long run of white space is one piece of the pattern but for its last character, which
    belongs to what follows, and it's encoded by itself; at the end of the text the whole run is.
    """
    at, parts = 0, []
    for m in LONG_SPACE.finditer(text):
        cut = m.end() - (m.end() < len(text))
        parts.append(encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[m.start() : cut]), np.uint32))
        at = cut
    if not parts:
        return encoding.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([*parts, encoding.encode_to_numpy(text[at:], disallowed_special=())])


def section_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each section; an empty document has none."""
    full = offsets[:-1][np.diff(offsets) > 0]
    if len(data) == 0:
        return full
    feed = data == 10
    after = np.flatnonzero(feed[:-1] & ~feed[1:]) + 1
    # Line feeds that begin a document belong to its first section.
    doc = np.searchsorted(offsets, after, "right") - 1
    seen = np.concatenate([[0], np.cumsum(~feed)])
    after = after[seen[after] > seen[offsets[doc]]]
    return np.union1d(full, after)


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of each token span; section k lies from bounds[k] up to bounds[k + 1]."""
    lo = np.searchsorted(bounds, starts, "right") - 1
    hi = np.searchsorted(bounds, ends - 1, "right") - 1
    crosses, at = hi > lo, lo.copy()
    two = np.flatnonzero(hi == lo + 1)
    edge = bounds[hi[two]]
    at[two] += edge - starts[two] < ends[two] - edge
    for i in np.flatnonzero(hi > lo + 1):
        inside = bounds[lo[i] : hi[i] + 2].copy()
        inside[0], inside[-1] = starts[i], ends[i]
        at[i] += int(np.argmax(np.diff(inside)))
    return at, crosses


def _counted(batch: pa.RecordBatch, path: str) -> Iterator[pa.RecordBatch]:
    encoding, size = encoder(path)
    all_data, all_offsets = textvec.utf8(batch.column(1))
    texts = batch.column(1)
    for lo, hi in textvec.chunks(all_offsets):
        data, offsets = all_data[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
        n = np.diff(offsets)
        ids = [encoded(encoding, texts[lo + i].as_py()) for i in np.flatnonzero(n)]
        edge = np.concatenate([[0], np.cumsum(size[np.concatenate(ids)] if ids else [])]).astype(np.int64)
        if edge[-1] != len(data):
            raise ValueError("the tokens don't cover the text: the vocabulary lacks single bytes")
        chars = textvec.char_starts(data)
        begin = section_starts(data, offsets)
        bounds = chars[np.concatenate([begin, [len(data)]])]
        at, crosses = attribute(chars[edge[:-1] + 1] - 1, chars[edge[1:]], bounds)
        count = np.bincount(at, minlength=len(begin))
        crossing = np.bincount(at, crosses, len(begin)).astype(np.int64)
        doc = np.searchsorted(offsets, begin, "right") - 1
        number = np.arange(len(begin)) - np.searchsorted(doc, doc)
        origin = chars[offsets[doc]]
        empty = np.flatnonzero(n == 0)
        zero = np.zeros(len(empty), np.int64)
        columns = [np.concatenate([x, zero]) for x in (number, bounds[:-1] - origin, bounds[1:] - origin, count, crossing)]
        take = pa.array(np.concatenate([doc, empty]) + lo)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()).take(take), *[pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
        )


def section_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each section of each row of `docs` (doc_id, text): a map over partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 1):
            yield from _counted(batch, tokenizer)

    return textvec.arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def counted(docs: DataFrame, tokenizer: str = TOKENIZER, column: str = "n_tokens") -> DataFrame:
    """`docs` with its column `text` replaced by the number of the text's tokens; null and empty texts have none."""
    names = docs.columns
    at, others = names.index("text"), [c for c in names if c != "text"]
    schema = StructType([docs.schema[c] for c in others] + [StructField(column, LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = encoder(tokenizer)
        for batch in textvec.pieces(batches, at):
            n = [len(encoded(encoding, text)) if text else 0 for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in others), pa.array(n, pa.int64())], names=[*others, column])

    return textvec.arrow_map(docs, run, schema)
