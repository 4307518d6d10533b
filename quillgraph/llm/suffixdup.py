"""Passages that repeat across documents, found by a hash-compared suffix sort.

Suffixes begin at words and are compared through prefix polynomial hashes: a binary search over
the length finds the common extension of two suffixes, so that a comparison costs the logarithm
of it, and a mergesort orders them.  Successive suffixes that share at least `min_words` words form
a class; a class in two or more documents is a repeated passage.  Bytes are then compared, so
that a collision of hashes can't make two passages equal.

Suffixes of a corpus don't fit in one place, and needn't: two that share `min_words` words share
the same `gram`-word anchor, the one with the least hash among those that begin in the first
``min_words - gram + 1`` words, at the same distance.  So the suffix array is cut into parts by
anchor:

1. each document gives its anchors' hashes, about one for every 13 words;
2. anchors that two documents have are joined back to their documents;
3. these send, for each such anchor, the suffixes that belong to it, as one slice of their text;
4. the slices of an anchor meet in one task, which sorts their suffixes;
5. overlapping repeated windows are joined to the longest spans.

A word is a run of characters other than ASCII white space, which may differ between occurrences.
Of each class the occurrence first by (doc_id, place) has the role ``first``, the others
``repeat``; a document without its ``repeat`` spans has lost nothing that isn't kept elsewhere.

Defined cases: a null or empty text or one under `min_words` words has no spans; a null doc_id is
left out; repeated rows of one doc_id are one document, so what only they share isn't repeated
(of rows of one doc_id with different texts each is searched); a passage repeated within one
document only doesn't count; texts are searched whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import textvec


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    gram: int = 25

    @property
    def reach(self) -> int:
        return self.min_words - self.gram + 1


class Words:
    """The words of a buffer of texts and hashes of any run of them, white space made equal."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.doc = textvec.word_bounds(data, offsets, ~textvec.SPACE)
        space = textvec.SPACE[data]
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        self.plain = np.where(space, np.uint8(32), data)[keep]
        place = np.concatenate([[0], np.cumsum(keep)])
        self.at, self.to = place[self.starts], place[self.ends]
        self.prefix = textvec.PrefixHash(self.plain)

    def hashes(self, first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Unmixed hash of the n words from each of `first`."""
        a, b = self.at[first], self.to[first + n - 1]
        return (self.prefix.sums[b] - self.prefix.sums[a]) * self.prefix.inverse[a]


def anchor_of(words: Words, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, its anchor, the anchor's hash) of each word at which `min_words` words begin."""
    whole = textvec.within(words.doc, settings.min_words)
    if not len(whole):
        return whole, whole, np.zeros(0, np.uint64)
    grams = len(words.doc) - settings.gram + 1
    value = textvec.mixed(words.hashes(np.arange(grams), settings.gram))  # also across documents, where no place looks
    best, width = np.arange(grams), 1
    while width < settings.reach:  # the leftmost least of [i, i + width), for doubling widths
        step = min(width, settings.reach - width)
        a, b = best[: grams - step], best[step:]
        best = np.concatenate([np.where(value[b] < value[a], b, a), best[grams - step :]])
        width += step
    return whole, best[whole], value[best[whole]]


def _anchors(settings: Settings):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 2):
            data, offsets = textvec.utf8(batch.column(2))
            for lo, hi in textvec.chunks(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                place, anchor, value = anchor_of(words, settings)
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[: len(anchor)]
                doc = pa.array(words.doc[place[first]] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(value[first].view(np.int64))], names=["doc_id", "h", "anchor"]
                )

    return run


def _slices(settings: Settings):
    """For each anchor of `shared`, the suffixes that belong to it: their common slice of text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 2):
            data, offsets = textvec.utf8(batch.column("text"))
            lists = batch.column("shared")
            for lo, hi in textvec.chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = Words(part, at)
                place, anchor, value = anchor_of(words, settings)
                head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[: len(anchor)]
                size = np.diff(np.concatenate([head, [len(anchor)]]))
                doc, fp = words.doc[place[head]], value[head].view(np.int64)
                mine = lists.slice(lo, hi - lo)
                owner = np.repeat(np.arange(hi - lo), np.diff(mine.offsets.to_numpy()))
                wanted = mine.flatten().to_numpy(zero_copy_only=False)
                pair = np.concatenate([np.stack([doc, fp], 1), np.stack([owner, wanted], 1)])
                _, code = np.unique(pair, axis=0, return_inverse=True)
                code = code.reshape(-1)
                keep = np.flatnonzero(np.isin(code[: len(doc)], code[len(doc) :]))
                head, size, doc, fp = head[keep], size[keep], doc[keep], fp[keep]
                first = place[head]
                a, b = words.starts[first], words.ends[first + size - 1 + settings.min_words - 1]
                chars = textvec.char_starts(part)
                text = [part[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                base = np.searchsorted(words.doc, doc)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array((first - base).astype(np.int32)),
                        pa.array(chars[a] - chars[at[doc]]), pa.array(size.astype(np.int32)), pa.array((anchor[head] - first).astype(np.int32)), pa.array(text, pa.binary()),
                    ],
                    names=["anchor", "doc_id", "h", "word", "char", "n", "distance", "slice"],
                )

    return run


SLICE_SCHEMA = "anchor bigint, doc_id bigint, h bigint, word int, char bigint, n int, distance int, slice binary"
SPAN_SCHEMA = "doc_id bigint, h bigint, role string, word bigint, word_end bigint, start bigint, end bigint"


class Suffixes:
    """Suffixes of slices: the first word of each and the number of words up to its slice's end."""

    def __init__(self, words: Words, first: np.ndarray, length: np.ndarray):
        self.words, self.first, self.length = words, first, length
        self.word_hash = words.hashes(np.arange(len(words.doc)), 1) if len(words.doc) else np.zeros(0, np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length in words of the common extension of suffixes a and b, by binary search."""
        x, y = self.first[a], self.first[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = np.maximum((lo + hi + 1) // 2, 1)
            same = self.words.hashes(x, mid) == self.words.hashes(y, mid)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b: a prefix before what it begins, equal ones by number."""
        n = self.common(a, b)
        end_a, end_b = n == self.length[a], n == self.length[b]
        last = len(self.word_hash) - 1
        u = self.word_hash[np.minimum(self.first[a] + n, last)]
        v = self.word_hash[np.minimum(self.first[b] + n, last)]
        return np.where(end_a | end_b, np.where(end_a & end_b, a < b, end_a), u < v)


def merge_sort(suffixes: Suffixes, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sort each bucket order[begin : begin + size]; all buckets' merges of a level run together.

    An element's place after a merge is its place in its own half plus its rank in the other
    half, which a binary search finds.
    """
    order, width = order.copy(), 1
    while len(size) and width < size.max():
        live = size > width
        begin, size = begin[live], size[live]
        at = np.repeat(begin, size) + _ramp(size)
        inside = _ramp(size)
        stop = np.repeat(size, size)
        block = inside // width
        other = np.where(block % 2 == 0, block + 1, block - 1) * width
        lo, hi = np.minimum(other, stop), np.minimum(other + width, stop)
        base = at - inside
        start = lo.copy()
        me = order[at]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            them, own = order[base[open_] + mid], me[open_]
            # Ranks count what is less; numbers differ, so less() is strict and total.
            below = suffixes.less(them, own)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        pair = block // 2 * 2 * width
        order[base + pair + (inside - block * width) + (lo - start)] = me
        width *= 2
    return order


def _ramp(size: np.ndarray) -> np.ndarray:
    """0 ... size[0] - 1, 0 ... size[1] - 1, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


def equal_runs(words: Words, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from a and from b are the same bytes."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 20_000):
        x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
        xs, ys = words.at[x], words.at[y]
        size = words.to[x + n - 1] - xs
        fits = size == words.to[y + n - 1] - ys
        size = np.where(fits, size, 0)
        step = _ramp(size)
        same = words.plain[np.repeat(xs, size) + step] == words.plain[np.repeat(ys, size) + step]
        bad = np.bincount(np.repeat(np.arange(len(x)), size), ~same, len(x))
        out[lo : lo + 20_000] = fits & (bad == 0)
    return out


def repeated(table: pa.Table, settings: Settings) -> pa.RecordBatch:
    """Spans of the slices of whole anchors, each row of `table` a slice."""
    col = {name: table.column(name).to_numpy() for name in ("anchor", "doc_id", "h", "word", "char", "n", "distance")}
    data, offsets = textvec.utf8(table.column("slice").cast(pa.string()))
    words = Words(data, offsets)
    first_word = np.searchsorted(words.doc, np.arange(len(table)))
    last_word = np.searchsorted(words.doc, np.arange(len(table)), "right")
    size = col["n"].astype(np.int64)
    slice_of, step = np.repeat(np.arange(len(table)), size), _ramp(size)
    first = first_word[slice_of] + step
    suffixes = Suffixes(words, first, last_word[slice_of] - first)
    _, group = np.unique(col["anchor"], return_inverse=True)
    bucket = group[slice_of] * np.int64(settings.min_words + 1) + (col["distance"][slice_of] - step)
    order = np.argsort(bucket, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))[: len(order)]
    order = merge_sort(suffixes, order, head, np.diff(np.concatenate([head, [len(order)]])))
    a, b = order[:-1], order[1:]
    joined = bucket[a] == bucket[b]
    near = np.flatnonzero(joined)
    joined[near] = suffixes.common(a[near], b[near]) >= settings.min_words
    near = np.flatnonzero(joined)
    joined[near] = _verified(words, suffixes, slice_of, a[near], b[near], settings)
    classes = np.cumsum(np.concatenate([[0], ~joined])) if len(order) else np.zeros(0, np.int64)
    class_head = np.flatnonzero(np.concatenate([[True], ~joined]))[: len(order)]
    doc = col["doc_id"][slice_of[order]]
    least, most = (f.reduceat(doc, class_head) if len(doc) else doc for f in (np.minimum, np.maximum))
    shared = (least < most)[classes] if len(doc) else np.zeros(0, bool)
    # The first occurrence: of the least doc_id the least place.
    place = col["word"][slice_of[order]] + step[order]
    rank = np.where(doc == least[classes], place, np.iinfo(np.int64).max) if len(doc) else place
    is_first = (doc == least[classes]) & (rank == np.minimum.reduceat(rank, class_head)[classes]) if len(doc) else shared
    role = np.zeros(len(order), np.int8)
    role[order] = np.where(shared, np.where(is_first, 1, 2), 0)
    run = np.flatnonzero(np.concatenate([[True], (role[1:] != role[:-1]) | (slice_of[1:] != slice_of[:-1])]))[: len(role)]
    tail = np.concatenate([run[1:], [len(role)]])[: len(run)] - 1
    run, tail = run[role[run] > 0], tail[role[run] > 0]
    of, chars = slice_of[run], textvec.char_starts(data)
    w0, w1 = first[run], first[tail] + settings.min_words
    moved = col["char"][of] - chars[offsets[of]]
    at_word = col["word"][of] + step[run]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(col["doc_id"][of]), pa.array(col["h"][of]), pa.array(np.array(["", "first", "repeat"])[role[run]].tolist(), pa.string()), pa.array(at_word.astype(np.int64)),
            pa.array((at_word + w1 - w0).astype(np.int64)), pa.array(chars[words.starts[w0]] + moved), pa.array(chars[words.ends[w1 - 1]] + moved),
        ],
        names=["doc_id", "h", "role", "word", "word_end", "start", "end"],
    )


def _verified(words: Words, suffixes: Suffixes, slice_of: np.ndarray, a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Whether the first `min_words` words of suffixes a and b are equal bytes.

    Successive suffixes of the same two slices overlap, so each pair of slices is compared once,
    over all the words that its suffixes reach; only where that fails each suffix by itself.
    """
    if not len(a):
        return np.zeros(0, bool)
    x, y = suffixes.first[a], suffixes.first[b]
    order = np.lexsort((x, slice_of[b], slice_of[a]))
    sx, sy = slice_of[a][order], slice_of[b][order]
    fresh = np.concatenate([[True], (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1]) | (np.diff(x[order]) != 1) | (np.diff(y[order]) != 1)])
    head = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([head, [len(order)]])) + settings.min_words - 1
    good = np.zeros(len(head), bool)
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        good[at] = equal_runs(words, x[order[head[at]]], y[order[head[at]]], int(k))
    out = np.zeros(len(a), bool)
    out[order] = good[np.cumsum(fresh) - 1]
    rest = np.flatnonzero(~out)
    out[rest] = equal_runs(words, x[rest], y[rest], settings.min_words)
    return out


def _sorted_parts(settings: Settings, most_rows: int = 4_000):
    """mapInArrow over slices ordered by anchor; slices of one anchor are kept together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for big in batches:
            for lo in range(0, len(big), most_rows):
                batch = big.slice(lo, most_rows)
                key = batch.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if held and cut == 0 and held[-1].column(0)[len(held[-1]) - 1].as_py() == key[0]:
                    held.append(batch)
                    continue
                done = [*held, batch.slice(0, cut)]
                if sum(map(len, done)):
                    yield repeated(pa.Table.from_batches(done), settings)
                held = [batch.slice(cut)]
        if held:
            yield repeated(pa.Table.from_batches(held), settings)

    return run


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, role, word, n_words, start, end) of each span of repeated passages; characters."""
    base = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    anchors = written(textvec.arrow_map(base, _anchors(settings), "doc_id bigint, h bigint, anchor bigint"), "suffix-anchors")
    # More than one document: a least and a greatest doc_id need no list and combine map-side.
    common = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    lists = anchors.join(common, "anchor", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("shared"))
    lists = written(lists, "suffix-shared")
    slices = textvec.arrow_map(base.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "shared"), _slices(settings), SLICE_SCHEMA)
    parts = slices.repartition("anchor").sortWithinPartitions("anchor")
    spans = textvec.arrow_map(parts, _sorted_parts(settings), SPAN_SCHEMA).distinct()
    own = Window.partitionBy("doc_id", "h", "role").orderBy("word", "word_end")
    before = F.max("word_end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("word") > before), 1).otherwise(0)).over(own)
    merged = spans.withColumn("island", island).groupBy("doc_id", "h", "role", "island")
    merged = merged.agg(F.min("word").alias("word"), F.max("word_end").alias("word_end"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("doc_id", "role", "word", (F.col("word_end") - F.col("word")).alias("n_words"), "start", "end")


def passages_sql(settings: Settings) -> str:
    """Every window of `min_words` words as text, grouped; overlapping windows joined."""
    n = settings.min_words
    return rf"""
WITH pieces AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS piece, lead FROM (
  SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*') AS p, length(regexp_extract(text, '^[ \t\n\r\f\x0B]*')) AS lead
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL))),
words AS (SELECT doc_id, k - 1 AS w, regexp_extract(piece, '^[^ \t\n\r\f\x0B]+') AS word,
  lead + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM pieces),
runs AS (SELECT doc_id, w, c, md5(string_agg(word, ' ') OVER s) AS run, last_value(c + length(word)) OVER s AS c_end, count(*) OVER s AS n
  FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
shared AS (SELECT *, (doc_id, w) = min((doc_id, w)) OVER (PARTITION BY run) AS is_first FROM runs WHERE n = {n}
  QUALIFY min(doc_id) OVER (PARTITION BY run) < max(doc_id) OVER (PARTITION BY run)),
marked AS (SELECT *, CASE WHEN w > lag(w) OVER o + {n} OR lag(w) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM shared
  WINDOW o AS (PARTITION BY doc_id, is_first ORDER BY w)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, is_first ORDER BY w) AS island FROM marked)
SELECT doc_id, CASE WHEN is_first THEN 'first' ELSE 'repeat' END AS role, min(w)::BIGINT AS word, (max(w) + {n} - min(w))::BIGINT AS n_words,
  min(c)::BIGINT AS start, max(c_end)::BIGINT AS "end"
FROM islands GROUP BY doc_id, is_first, island"""
