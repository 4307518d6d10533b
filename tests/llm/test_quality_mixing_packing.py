import base64
import hashlib
import itertools
import random
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest
import zstandard

from quillgraph.llm import mixing, packing, quality, tokens
from quillgraph.llm.queries import MIXTURE, PACKING

from .helpers import docs, empty, prose, rows


def test_quality_verdicts(spark):
    words = ["Ein", "kurzer", "Text", "handelt", "von", "Dingen"]
    rng = random.Random(3)
    junk = bytes(rng.randrange(33, 127) for _ in range(6000)).decode()
    normal = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(1500))
    mixed = normal[:5000] + "spam " * 4000
    some = [(1, "spam " * 400, *[None] * 6), (2, junk, *[None] * 6), (3, normal, *[None] * 6), (4, " ".join(words), *[None] * 6), (5, mixed, *[None] * 6)]
    got = {r.doc_id: r for r in quality.compression_quality(docs(spark, some)).collect()}
    assert [got[k].reason for k in (1, 2, 3, 4)] == ["repetitive", "incompressible", "ok", "ok"]
    assert not got[5].keep
    raw = normal.encode()
    assert got[3].ratio == len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
    parts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    assert got[3].n_chunks == len(parts)
    assert got[3].max_chunk_ratio == max(len(p) / len(zstandard.ZstdCompressor(level=3).compress(p)) for p in parts)


def test_verdicts_by_brute_force(spark):
    """The whole query against each text by itself: bands, chunks and reasons written out."""
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(8)
    some += [None, "", " \n", "ab" * 3000, "x" * 499, "x" * 199, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)), base64.b64encode(rng.randbytes(9000)).decode()]
    some += [some[0][:900] + "ha " * k + some[1] for k in (0, 200, 2000, 9000)]
    bands, squeeze = quality.Bands(), zstandard.ZstdCompressor(level=3)

    def judge(raw):
        ratio, verdict = len(raw) / len(squeeze.compress(raw)), "ok"
        for least, low, high in bands.limits:
            if len(raw) >= least:
                verdict = "incompressible" if ratio < low else "repetitive" if ratio > high else "ok"
        return ratio, verdict

    got = {r.doc_id: r for r in quality.compression_quality(docs(spark, [(k, t, *[None] * 6) for k, t in enumerate(some)])).collect()}
    for k, text in enumerate(some):
        r, raw = got[k], (text or "").encode()
        assert r.n_bytes == len(raw)
        if not (text or "").strip(" \t\n\r\v\f"):
            assert (r.reason, r.keep, r.ratio, r.n_chunks) == ("empty", False, None, 0)
            continue
        ratio, verdict = judge(raw)
        parts = [judge(raw[i : i + 4096]) for i in range(0, len(raw), 4096)]
        bad = sum(v != "ok" for _, v in parts) / len(parts)
        reason = verdict if verdict != "ok" else "bad_chunks" if bad > bands.bad_share else "ok"
        assert (r.reason, r.keep, r.n_chunks) == (reason, reason == "ok", len(parts)) and r.ratio == ratio and r.bad_chunk_share == pytest.approx(bad)
        assert (r.min_chunk_ratio, r.max_chunk_ratio) == (min(x for x, _ in parts), max(x for x, _ in parts))
    assert {r.reason for r in got.values()} == {"ok", "empty", "incompressible", "repetitive", "bad_chunks"}


def test_quality_cases(spark):
    got = quality.compression_quality(docs(spark)).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: r.reason for r in got if r.doc_id in (3, 4, 5)} == {3: "empty", 4: "empty", 5: "empty"}
    assert sum(r.doc_id == 8 for r in got) == 2
    assert quality.compression_quality(empty(spark)).count() == 0


def _oracle(sql, some):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint, bucket varchar, h varchar, keep varchar)")
    if some:
        c.executemany("insert into documents values (?, ?, ?, ?, ?, ?, ?, ?)", some)
    return Counter(c.sql(sql).fetchall())


ESTIMATED = replace(MIXTURE, length="estimate")


@pytest.mark.parametrize("mixture", [mixing.Mixture(), mixing.Mixture(weights={"a": 2.0, "b": 0.0}, tiers=(0.3, 1.0), level_bits=7), ESTIMATED, mixing.Mixture(weights={"b": 9.0, "c": 0.0}, share=0.9), mixing.Mixture(share=1.0)])
def test_mixing_equals_running_sum(spark, mixture):
    rng = random.Random(1)
    some = rows() + [(k, "x" * rng.randrange(400), "en", rng.choice("aaaabc"), None, None, None, None) for k in range(100, 400)]
    got = Counter(tuple(r) for r in mixing.mix(docs(spark, some), mixture).select("doc_id", "source", "tokens", "tier").collect())
    assert got == _oracle(mixing.mix_sql(mixture), some)
    kept = mixing.mixed(docs(spark, some), mixture)
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in got.elements())


def test_counted_mixture_by_brute_force(spark):
    """The query's own parameters: sorted hashes and a bisected level, tokens by the encoder."""
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang", "if(doc_id % 9 < 3, 'src0', source) AS source", "n_chars", "'' AS bucket", "'' AS h", "'' AS keep")
    some = [tuple(r) for r in read.collect()] + rows() + [(k, "tiny", "en", "stray", 4, None, None, None) for k in (901, 902)]
    encoding, _ = tokens.encoder(tokens.TOKENIZER)
    size = [len(encoding.encode_ordinary(r[1] or "")) for r in some]
    hashed = [int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for r in some]
    totals = Counter()
    for r, n in zip(some, size):
        totals[r[3]] += n
    weight = {s: MIXTURE.weights.get(s, MIXTURE.default_weight) for s in totals}
    want = Counter()
    budgets = []
    for part in MIXTURE.tiers:
        budget, low, high = int(sum(totals.values()) * (MIXTURE.share * part)), 0.0, 1e9
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(totals[s], level * w) for s, w in weight.items()) < budget else (low, level)
        budgets.append({s: min(totals[s], int(high * w + 1e-6)) for s, w in weight.items()})
    for s in totals:
        own = sorted((h, k) for k, h in enumerate(hashed) if some[k][3] == s)
        upto = 0
        for h, group in itertools.groupby(own, key=lambda x: x[0]):
            group = [k for _, k in group]
            upto += sum(size[k] for k in group)
            for tier, budget in enumerate(budgets):
                if upto <= budget[s]:
                    want.update((some[k][0], s, size[k], tier) for k in group)
                    break
    read = docs(spark, some)
    assert Counter(tuple(r) for r in mixing.mix(read, MIXTURE).select("doc_id", "source", "tokens", "tier").collect()) == want
    kept = sum(n for (_, _, n, _), k in want.items() for _ in range(k))
    assert 0.6 < kept / sum(size) <= 0.7  # what whole documents leave of the budget
    assert {k[0] for k in want} >= {901, 902}  # a stray source gives all, and takes nothing


def test_counted_packing_by_brute_force(spark):
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'' AS bucket", "'' AS h", "'' AS keep")
    some = [tuple(r) for r in read.limit(120).collect()] + rows()
    encoding, _ = tokens.encoder(tokens.TOKENIZER)
    plan = replace(PACKING, buckets=3, token_budget=4000)
    got = packing.pack(docs(spark, some), plan).collect()
    length = Counter((r[0], len(encoding.encode_ordinary(r[1] or "")) + 1) for r in some)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == length
    sizes = sorted({n for _, n in length})
    best = min(sum(n * (next(c for c in [*cut, sizes[-1]] if c >= x[1]) - x[1]) for x, n in length.items()) for cut in itertools.combinations(sizes[:-1], 2))
    assert sum(r.padded_len - r.n_tokens for r in got) == best
    batch = Counter((r.bucket, r.batch_id) for r in got)
    widths = {(r.bucket, r.batch_id): r.padded_len for r in got}
    assert all(n == 1 or n * widths[b] <= 4000 for b, n in batch.items())
    assert len({(r.bucket, r.batch_id, r.slot) for r in got}) == len(some)
    for bucket in {b for b, _ in batch}:  # all but the last batch of a bucket are full
        full = [n for (b, i), n in sorted(batch.items()) if b == bucket]
        assert set(full[:-1]) <= {max(1, 4000 // widths[(bucket, 0)])}


def test_mixing_cases(spark):
    assert mixing.mix(empty(spark), MIXTURE).count() == 0
    assert mixing.mixed(empty(spark), MIXTURE).count() == 0
    with pytest.raises(ValueError):
        mixing.Mixture(weights={"a": -1})
    only_empty = [(1, None, None, "a", None, None, None, None), (2, "", None, None, None, None, None, None)]
    assert mixing.mix(docs(spark, only_empty), mixing.Mixture()).count() == 2


def test_mixing_keeps_columns_of_any_name(spark):
    extra = "_h cut0 _cut0 cut1 mix_source _mix_source tier _tier threshold weight tokens total".split()
    read = docs(spark).selectExpr("*", *[f"doc_id AS `{c}`" for c in extra])
    kept = mixing.mixed(read, mixing.Mixture())
    assert kept.columns == read.columns
    assert Counter(map(tuple, kept.select(docs(spark).columns).collect())) == Counter(map(tuple, mixing.mixed(docs(spark), mixing.Mixture()).collect()))


def test_bounds_are_optimal():
    rng = np.random.default_rng(5)
    for n in range(1, 9):
        for _ in range(20):
            length = np.sort(rng.choice(60, n, replace=False) + 1)
            count = rng.integers(1, 9, n)

            def cost(cut, length=length, count=count):
                return sum(count[i] * (next(c for c in cut if c >= x) - x) for i, x in enumerate(length.tolist()))

            for buckets in (1, 2, 3, 5):
                best = min(cost(sorted({*c, int(length[-1])})) for k in range(min(buckets, n)) for c in itertools.combinations(length.tolist(), k))
                found = packing.best_bounds(length, count, buckets)
                assert len(found) <= buckets and cost(found) == best


def test_packing_equals_sql(spark):
    rng = random.Random(2)
    some = rows() + [(k, None, None, "a", rng.randrange(3000), None, None, None) for k in range(100, 300)]
    for plan in (packing.Packing(buckets=3, token_budget=2000, shard_bits=2), replace(PACKING, length="estimate")):
        got = Counter(tuple(r) for r in packing.pack(docs(spark, some), plan).collect())
        assert got == _oracle(packing.pack_sql(plan), some)
    got = packing.pack(docs(spark, some), packing.Packing(buckets=3, token_budget=2000)).collect()
    assert len(got) == len(some)
    by = Counter((r.bucket, r.batch_id) for r in got)
    width = {(r.bucket, r.batch_id): r.padded_len for r in got}
    assert all(n == 1 or n * width[b] <= 2000 for b, n in by.items())
    assert packing.pack(empty(spark), PACKING).count() == 0
    assert prose(1, 3) == prose(1, 3)
