"""Near-duplicate groups by a signature-coordinate inverted join.

A document's signature has `coordinates` minima of hashes of its word shingles.  It is posted
under each (coordinate, value) pair; two documents whose posts collide in at least `matches`
coordinates are near duplicates.  Collisions are counted only where they can matter:

* Documents of equal signature are one entry, and every copy belongs to it.
* A post that no other document has can't collide.  A document with fewer than `matches` other
  posts is skipped altogether.
* Prefix: of its n posts that occur elsewhere, rarest first, a document keeps the first
  ``n - matches + 1``.  Two documents with `matches` common posts have one in both prefixes,
  since all documents order posts alike.
* Skip merging: within one posting list, pairs that are already in one group aren't counted.  A
  search from each document goes on only among the documents that no group has taken yet.  Every
  pair that it counts is counted over all coordinates, and kept from `matches` collisions on.

This finds exactly the connected components of the pairs with at least `matches` collisions, where
two posts of one coordinate collide if 32 bits of their values do; the pairs of :func:`near_pairs`
span them.  Lists may have any length, and no document any limit of partners.

A shingle is `shingle` successive words, letters and digits of the lower-cased text, where each
character of a script that is written without spaces is a word; a document of fewer words is one
shingle, one of no word but other characters is the shingle of these.

Defined cases: a null, empty or blank text is no one's duplicate; a null doc_id is left out of the
groups and stays; repeated rows of one doc_id are one document, listed once, which is near what any
of its texts is near, and of those of equal text :func:`deduplicated` keeps one; of a group the smallest doc_id stays; an empty table gives an
empty result; other columns are ignored by the search and passed through by `deduplicated`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import textvec
from .hashing import fresh


@dataclass(frozen=True)
class Settings:
    """64 coordinates of which 34 match find pairs of Jaccard similarity 0.6 with recall over 0.9."""

    coordinates: int = 64
    matches: int = 34
    shingle: int = 3
    #: Up to so many identifiers (8 bytes each) the documents that go are broadcast; beyond, joined.
    broadcast_ids: int = 1_000_000


#: Blocks of scripts without spaces between words: Thai and Lao, Burmese, Khmer, Tai, Javanese, Kana, Bopomofo, Han, Yi.
UNSPACED = [
    (0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x1A00), (0x1A20, 0x1AB0), (0x1B00, 0x1B80), (0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3040, 0x3130), (0x31A0, 0x31C0),
    (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA980, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000),
]


def _kinds() -> np.ndarray:
    """Of a code point from 128: 0 between words, 1 within words, 2 a word by itself."""
    out = np.ones(0x110000, np.int8)
    for a, b in UNSPACED:
        out[a:b] = 2
    for c in range(0x80, 0x20000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PSZ" or kind == "Cc":
            out[c] = 0
    return out


KINDS = _kinds()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return textvec.word_bounds(data, offsets, textvec.ALNUM)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    a = data[lead].astype(np.int32)
    b, c, d = (padded[lead + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
    code = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d))
    of = KINDS[np.minimum(code, 0x10FFFF)]
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    kind = textvec.ALNUM[padded].astype(np.int8)
    for k in range(4):
        kind[lead[size > k] + k] = of[size > k]
    kind = kind[: len(data)]
    head = np.concatenate([[True], kind[1:] != kind[:-1]])
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    head[lead[of == 2]] = True
    head &= kind > 0
    starts = np.flatnonzero(head)
    ends = np.flatnonzero((kind > 0) & np.concatenate([head[1:] | (kind[1:] == 0), [True]])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the word shingles of lower-cased text, documents in order."""
    n_docs = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    prefix = textvec.PrefixHash(data)
    word = prefix.of(starts, ends)
    at = textvec.within(doc, k)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value = textvec.mixed(value + word[at + j] * np.uint64(2 * j + 1))
    of = doc[at]
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.searchsorted(doc, np.arange(n_docs))
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    span = prefix.of(starts[first[few]], ends[first[few] + n_words[few] - 1])
    none = np.flatnonzero((n_words == 0) & (np.diff(offsets) > 0))
    none = np.array([d for d in none if not textvec.SPACE[data[offsets[d] : offsets[d + 1]]].all()], np.int64)
    value = np.concatenate([value, span, prefix.of(offsets[none], offsets[none + 1])])
    of = np.concatenate([of, few, none])
    order = np.argsort(of, kind="stable")
    return value[order], of[order]


def signatures_of(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have a signature, their signatures): posts, the coordinate in the lowest bits."""
    rng = np.random.Generator(np.random.PCG64(7))
    factor = rng.integers(0, 1 << 63, settings.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.uint64((1 << max(1, (settings.coordinates - 1).bit_length())) - 1)
    data, offsets = textvec.utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    docs, found = [], []
    for lo, hi in textvec.chunks(offsets):
        value, of = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], settings.shingle)
        if len(value) == 0:
            continue
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out = np.empty((len(begin), settings.coordinates), np.uint64)
        for k in range(settings.coordinates):
            x = value * factor[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] = np.minimum.reduceat(x, begin)
        out = textvec.mixed(out) & ~low | np.arange(settings.coordinates, dtype=np.uint64)
        docs.append(of[begin] + lo), found.append(out)
    if not docs:
        return np.zeros(0, np.int64), np.zeros((0, settings.coordinates), np.uint64)
    return np.concatenate(docs), np.concatenate(found)


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, s1, s2, sig) of documents with a signature; (s1, s2) is a 128-bit hash of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(11))
        salt = rng.integers(0, 1 << 63, (2, settings.coordinates), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in textvec.pieces(batches, 1):
            at, sig = signatures_of(batch.column(1), settings)
            s = [textvec.mixed((textvec.mixed(sig) * salt[k]).sum(1, dtype=np.uint64)).view(np.int64) for k in (0, 1)]
            ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * settings.coordinates)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(pa.array(at)), pa.array(s[0]), pa.array(s[1]), pa.ListArray.from_arrays(ends, pa.array(sig.reshape(-1).view(np.int64)))],
                names=["doc_id", "s1", "s2", "sig"],
            )

    return textvec.arrow_map(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), run, "doc_id bigint, s1 bigint, s2 bigint, sig array<bigint>")


def spanning_pairs(ids: np.ndarray, sig: np.ndarray, matches: int) -> list[tuple[int, int, int]]:
    """(i, j, collisions) that span the components of one posting list, found without counting
    pairs of documents that are already in one component."""
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            n = (sig[left] == sig[i]).sum(1)
            hit = n >= matches
            new = left[hit]
            out += zip([int(ids[i])] * len(new), ids[new].tolist(), n[hit].tolist(), strict=True)
            queue += new.tolist()
            left = left[~hit]
    return out


def _merge_lists(settings: Settings):
    """mapInArrow over postings sorted by key: (key, id, sig)."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key = table.column("key").to_numpy()
        ids = table.column("id").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, settings.coordinates)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([head, [len(key)]]))
        two = head[size == 2]
        n = (sig[two] == sig[two + 1]).sum(1)
        two, n = two[n >= settings.matches], n[n >= settings.matches]
        found = list(zip(ids[two].tolist(), ids[two + 1].tolist(), n.tolist(), strict=True))
        for h, s in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += spanning_pairs(ids[h : h + s], sig[h : h + s], settings.matches)
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64)), pa.array(np.array(c, np.int32))], names=["a", "b", "matches"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far, which may go on
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            if held and key[-1] == held[0].column(0)[0].as_py() and key[0] == key[-1]:
                held.append(batch)
                continue
            cut = int(np.searchsorted(key, key[-1]))
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if len(done):
                yield pairs(done)
            held = [batch.slice(cut)]
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def matching_pairs(entries: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, matches): pairs that span the groups of `entries` (id, sig)."""
    posts = entries.select("id", F.explode("sig").alias("key"))
    # A window spills where a list, which may have any length, doesn't fit in memory.
    common = posts.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    t = settings.matches
    ranked = common.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("posts")).where(F.size("posts") >= t)
    prefix = ranked.select("id", F.slice("posts", F.lit(1), F.size("posts") - (t - 1)).alias("posts"))
    short = F.transform("sig", lambda x: F.shiftright(x, 32).cast("int"))
    carried = prefix.join(entries.select("id", short.alias("sig")), "id")
    merged = carried.select(F.explode("posts.key").alias("key"), "id", "sig").repartition("key").sortWithinPartitions("key", "id")
    return textvec.arrow_map(merged, _merge_lists(settings), "a bigint, b bigint, matches int").groupBy("a", "b").agg(F.max("matches").alias("matches"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of the connected components of pairs (a, b); `root` is the smallest id, itself not listed as an id.

    Alternates large-star and small-star steps, which halve paths; each round is written to the
    shared folder, so that a lost executor costs no more than its part of one round.
    """
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def searched(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, s1, s2, sig), (s1, s2, first, id) of each signature, and pairs (a, b, matches) of its ids."""
    sigs = written(signatures(docs, settings), "neardup-signatures")
    same = sigs.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"))
    # An entry is a signature, not a doc_id, of which rows with different texts have several.
    same = written(same.withColumn("id", F.monotonically_increasing_id()), "neardup-same")
    # One row of each signature: that of the smallest doc_id, or of one of its repeated rows.
    entries = sigs.join(same, ["s1", "s2"]).where("doc_id = first").select("id", "sig").dropDuplicates(["id"])
    return sigs, same, matching_pairs(written(entries, "neardup-entries"), settings)


def near_pairs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_a, doc_b, matches) with doc_a < doc_b: near duplicates that span the groups.

    A copy of equal signature is paired with the smallest doc_id of that signature.
    """
    sigs, same, pairs = searched(docs, settings)
    names = same.select("id", "first")
    near = pairs.join(names.select(F.col("id").alias("a"), F.col("first").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("first").alias("y")), "b").select("x", "y", "matches")
    copies = sigs.join(same, ["s1", "s2"]).where("doc_id > first").select(F.col("first").alias("x"), F.col("doc_id").alias("y"), F.lit(settings.coordinates).alias("matches"))
    both = near.where("x <> y").union(copies)
    return both.groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("matches").alias("matches"))


def assignments(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate; group_id is the smallest doc_id."""
    sigs, same, pairs = searched(docs, settings)
    key = ["s1", "s2"]
    member = written(sigs.select("doc_id", *key).join(same.select("id", *key), key).select("doc_id", "id").distinct(), "neardup-member")
    # The entries of one doc_id are one document.
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most").select("doc_id", "a")
    roots = components(pairs.select("a", "b").union(member.join(several, "doc_id").select("a", F.col("id").alias("b"))))
    rooted = member.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")).distinct()
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return rooted.join(groups, "root").select("doc_id", "group_id")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(group_id, doc_ids, n_docs): a row for each group, `doc_ids` sorted; group_id is the one that stays."""
    groups = assignments(docs, settings).groupBy("group_id").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    return groups.select("group_id", "doc_ids", F.size("doc_ids").alias("n_docs")).where("n_docs > 1")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` without those of documents of which a near duplicate of smaller doc_id stays."""
    gone, twice = fresh(docs, "goes", "again")
    goes = written(assignments(docs, settings).where("doc_id <> group_id").select(F.col("doc_id").alias(gone)), "neardup-goes")
    goes_few = goes.count() <= settings.broadcast_ids
    kept = docs.join(F.broadcast(goes) if goes_few else goes, F.col("doc_id") == F.col(gone), "left_anti")
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(twice)), "neardup-repeated")
    if repeated.isEmpty():
        return kept
    again = F.col("doc_id") == F.col(twice)
    return kept.join(repeated, again, "left_anti").union(kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "text"]))
