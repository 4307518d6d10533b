"""Packing into optimal length buckets.

A batch pads each of its sequences to its bucket's bound.  The bounds that minimise the padding
of the whole corpus follow from the global histogram of lengths alone, by dynamic programming:
``f_k(j) = min over i < j of f_(k-1)(i) + cost(i, j)``, where cost is the padding of the lengths
after the i-th up to the j-th when they are padded to the j-th.  The cost is a Monge array, so
the leftmost best i rises with j and divide and conquer finds a layer in O(n log n).

Within a bucket the documents are numbered in the order of their hash, and every
``token_budget div bound`` of them make a batch.  The numbering is distributed: a document's
number is its place within its (bucket, leading hash bits) shard plus the sizes of the shards
before, of which there are a fixed number.

A document's length is its tokens, counted or estimated as in :mod:`.mixing`, and one end-of-text token.

Defined cases: a null or empty text has length 1; a document longer than the token budget is a
batch of its own, neither cut nor dropped; ties of hash are numbered by doc_id, then length, null
first; repeated rows are packed as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hashing import BITS, id_hash, id_hash_sql
from .mixing import DOC_TOKENS_SQL, measured


@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    token_budget: int = 65_536
    #: Leading hash bits that split a bucket for numbering: 2**12 shards in each bucket.
    shard_bits: int = 12
    length: str = "estimate"


def best_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bounds of at most `buckets` buckets with the least padding; of equal ones the leftmost.

    `length` rises strictly.  O(buckets * n log n) for n distinct lengths, whatever their counts.
    """
    n = len(length)
    if n == 0:
        return []
    length = length.astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
    tokens = np.concatenate([[0], np.cumsum(count.astype(np.int64) * length)])
    layers, cuts = min(buckets, n), []
    best = length * upto[1:] - tokens[1:]  # one bucket for the first j+1 lengths
    for k in range(1, layers):
        new, cut = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        todo = [(k, n - 1, k - 1, n - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + length[j] * (upto[j + 1] - upto[i + 1]) - (tokens[j + 1] - tokens[i + 1])
            at = int(np.argmin(cost))
            new[j], cut[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, i[at]), (j + 1, hi, i[at], last)]
        best = new
        cuts.append(cut)
    bounds, j = [int(length[-1])], n - 1
    for cut in reversed(cuts):
        j = int(cut[j])
        bounds.append(int(length[j]))
    return bounds[::-1]


def pack(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_len, batch_id, slot), one row a document.

    What the driver gets is the histogram, one row for each distinct length: its size is bounded
    by the longest document, not by the corpus.
    """
    small = measured(docs, packing.length, F.col("doc_id"), id_hash(F.col("doc_id")).alias("h"))
    small = written(small.select("doc_id", "h", (F.col("tokens") + 1).alias("n_tokens")), "packing-lengths")
    histogram = small.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toPandas()
    bounds = best_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), packing.buckets)
    edge = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array(F.lit(1).cast("bigint"))
    small = small.withColumn("bucket", F.size(F.filter(edge, lambda b: b < F.col("n_tokens")))).withColumn("padded_len", F.element_at(edge, F.col("bucket") + 1))
    small = small.withColumn("shard", F.shiftright("h", BITS - packing.shard_bits))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # At most buckets * 2**shard_bits rows, a constant of the parameters.
    offsets = small.groupBy("bucket", "shard").agg(F.count("*").alias("n")).select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "n_tokens"))
    placed = small.withColumn("place", place).join(F.broadcast(offsets), ["bucket", "shard"])
    rank = F.col("offset") + F.col("place") - 1
    capacity = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(packing.token_budget) / F.col("padded_len")))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "padded_len", F.floor(rank / capacity).cast("bigint").alias("batch_id"), (rank % capacity).cast("int").alias("slot")
    )


def pack_sql(packing: Packing) -> str:
    """The dynamic programme, of estimated lengths, written out, a pair of tables a layer, quadratic in distinct lengths."""
    parts = [
        f"slim AS MATERIALIZED (SELECT doc_id, {DOC_TOKENS_SQL} + 1 AS n_tokens, {id_hash_sql('doc_id')} AS h FROM documents)",
        "hist AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS len, (sum(n) OVER (ORDER BY n_tokens))::BIGINT AS c,"
        " (sum(n * n_tokens) OVER (ORDER BY n_tokens))::BIGINT AS t FROM (SELECT n_tokens, count(*) AS n FROM slim GROUP BY n_tokens))",
        "f1 AS MATERIALIZED (SELECT j, len * c - t AS f, NULL::BIGINT AS i FROM hist)",
    ]
    for k in range(2, packing.buckets + 1):
        parts.append(
            f"f{k} AS MATERIALIZED (SELECT b.j, min(p.f + b.len * (b.c - a.c) - (b.t - a.t)) AS f, arg_min(a.j, (p.f + b.len * (b.c - a.c) - (b.t - a.t), a.j)) AS i"
            f" FROM f{k - 1} p JOIN hist a ON a.j = p.j JOIN hist b ON b.j > a.j GROUP BY b.j)"
        )
    last = packing.buckets
    parts.append("top AS MATERIALIZED (SELECT max(j) AS n FROM hist)")
    parts.append(f"b{last} AS MATERIALIZED (SELECT n AS j FROM top WHERE n >= {last})")
    for k in range(last - 1, 0, -1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT f.i AS j FROM f{k + 1} f JOIN b{k + 1} b ON f.j = b.j UNION ALL SELECT n FROM top WHERE n = {k})")
    parts.append("bounds AS MATERIALIZED (SELECT DISTINCT h.len AS len FROM (" + " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, last + 1)) + ") x JOIN hist h USING (j))")
    parts.append("edges AS (SELECT len, (row_number() OVER (ORDER BY len) - 1)::INT AS bucket FROM bounds)")
    parts.append("placed AS (SELECT s.*, e.bucket, e.len AS padded_len, row_number() OVER (PARTITION BY e.bucket ORDER BY s.h, s.doc_id NULLS FIRST, s.n_tokens) - 1 AS r"
                 " FROM slim s JOIN edges e ON e.len = (SELECT min(len) FROM bounds WHERE len >= s.n_tokens))")  # fmt: skip
    cap = f"greatest(1, {packing.token_budget} // padded_len)"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_tokens::BIGINT AS n_tokens, bucket, padded_len::BIGINT AS padded_len, (r // {cap})::BIGINT AS batch_id, (r % {cap})::INT AS slot FROM placed"
