import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quillgraph.llm import neardup, suffixdup
from quillgraph.llm.queries import PASSAGES

from .helpers import docs, empty, prose, rows
from .test_quality_mixing_packing import _oracle


def _groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for x in root:
        out[find(x)].append(x)
    return sorted(sorted(g) for g in out.values())


def edited(text, n, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def corpus():
    some = []
    for k in range(40):
        some.append((k, prose(k + 200, 90), *[None] * 6))
    for k in range(30):  # copies of a few, with more and more changes
        some.append((100 + k, edited(prose(200 + k % 5, 90), k % 9, k), *[None] * 6))
    passage = prose(999, 20)  # what many share doesn't make them near copies
    some += [(200 + k, passage + " " + prose(k + 500, 100), *[None] * 6) for k in range(20)]
    return some


def test_neardup_equals_all_pairs(spark):
    some = corpus()
    for settings in (neardup.Settings(), neardup.Settings(coordinates=16, matches=5, shingle=2)):
        at, sig = neardup.signatures_of(pa.array([r[1] for r in some]), settings)
        assert len(at) == len(some)
        same = (sig[:, None, :] == sig[None, :, :]).sum(2) >= settings.matches
        want = _groups((some[i][0], some[j][0]) for i, j in zip(*np.nonzero(np.triu(same, 1))))
        got = neardup.near_duplicates(docs(spark, some), settings).collect()
        assert sorted(r.doc_ids for r in got) == want
        assert all(r.group_id == r.doc_ids[0] and r.n_docs == len(r.doc_ids) for r in got)


def test_near_pairs_span_the_groups(spark):
    some = corpus() + [(300 + k, prose(203, 90), *[None] * 6) for k in range(3)]
    at, sig = neardup.signatures_of(pa.array([r[1] for r in some]), neardup.Settings())
    of = {r[0]: s for r, s in zip(some, sig)}
    pairs = neardup.near_pairs(docs(spark, some)).collect()
    assert all(r.doc_a < r.doc_b and r.matches == (of[r.doc_a] == of[r.doc_b]).sum() >= 34 for r in pairs)
    groups = neardup.near_duplicates(docs(spark, some)).collect()
    assert _groups((r.doc_a, r.doc_b) for r in pairs) == sorted(r.doc_ids for r in groups)
    assert len({(r.doc_a, r.doc_b) for r in pairs}) == len(pairs) and neardup.near_pairs(empty(spark)).count() == 0


def test_each_text_of_a_doc_id_is_compared(spark):
    one, two, three = prose(701, 90), prose(702, 90), prose(703, 90)
    texts = [(1, one), (1, two), (1, three), (5, edited(one, 1, 1)), (6, edited(two, 1, 2)), (7, edited(three, 1, 3)), (8, three), (9, prose(704, 90)), (10, prose(704, 90)), (11, prose(705, 90))]
    some = [(k, t, *[None] * 6) for k, t in texts]
    got = neardup.near_duplicates(docs(spark, some)).collect()
    assert sorted(r.doc_ids for r in got) == [[1, 5, 6, 7, 8], [9, 10]] and all(r.group_id == r.doc_ids[0] for r in got)
    kept = neardup.deduplicated(docs(spark, some)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (1, two), (1, three), (9, prose(704, 90)), (11, prose(705, 90))])


def test_near_copies_without_spaces(spark):
    rng = random.Random(3)
    for low, high, stop in ((0x4E00, 0x9000, "。"), (0x3041, 0x3090, "、"), (0xE01, 0xE2F, "")):
        text = stop.join("".join(chr(rng.randrange(low, high)) for _ in range(20)) for _ in range(8))
        other = "".join(chr(rng.randrange(low, high)) for _ in range(160))
        some = [(1, text, *[None] * 6), (2, text[:50] + chr(low + 1) + text[51:], *[None] * 6), (3, other, *[None] * 6)]
        assert [r.doc_ids for r in neardup.near_duplicates(docs(spark, some)).collect()] == [[1, 2]]


def test_words_of_mixed_scripts():
    texts = ["", "été — naïve“x”", "abc漢字def。かな 3", "한국어 문장", "ไทย", "a", "，。", "𠀀𠀁 x", "é"]
    data, offsets = neardup.textvec.utf8(pa.array(texts))
    starts, ends, doc = neardup.words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b, d in zip(starts, ends, doc) if d == k] for k in range(len(texts))]
    assert got == [[], ["été", "naïve", "x"], ["abc", "漢", "字", "def", "か", "な", "3"], ["한국어", "문장"], ["ไ", "ท", "ย"], ["a"], [], ["𠀀", "𠀁", "x"], ["é"]]


def test_recall_against_jaccard():
    settings = neardup.Settings()
    texts = [r[1] for r in corpus()]
    _, sig = neardup.signatures_of(pa.array(texts), settings)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = [shingles(t) for t in texts]
    found = wanted = wrong = 0
    for i in range(len(texts)):
        for j in range(i):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            hit = (sig[i] == sig[j]).sum() >= settings.matches
            wanted += jaccard >= 0.6
            found += bool(hit and jaccard >= 0.6)
            wrong += bool(hit and jaccard < 0.3)
    assert wanted > 50 and found / wanted >= 0.9 and wrong == 0


def test_spanning_pairs_join_all(spark):
    rng = np.random.default_rng(4)
    for _ in range(20):
        sig = rng.integers(0, 3, (30, 12))
        ids = np.arange(30) * 2
        same = (sig[:, None] == sig[None]).sum(2) >= 7
        want = _groups((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(same, 1))))
        assert _groups((a, b) for a, b, _ in neardup.spanning_pairs(ids, sig, 7)) == want


def test_components_of_a_long_path(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100, 102: 100}


def test_neardup_cases(spark):
    got = [r.doc_ids for r in neardup.near_duplicates(docs(spark)).collect()]
    assert got == [[1, 2, 9]]
    kept = neardup.deduplicated(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None, 10])
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.deduplicated(empty(spark)).count() == 0
    joined = neardup.deduplicated(docs(spark), neardup.Settings(broadcast_ids=0))
    assert Counter(r.doc_id for r in joined.collect()) == Counter(r.doc_id for r in kept.collect())


def test_neardup_keeps_columns_of_any_name(spark):
    extra = "goes _goes again _again count n group_id id root".split()
    read = docs(spark).selectExpr("*", *[f"doc_id AS `{c}`" for c in extra])
    for settings in (neardup.Settings(), neardup.Settings(broadcast_ids=0)):
        kept = neardup.deduplicated(read, settings)
        assert kept.columns == read.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None, 10])


def passages(spark, some, settings):
    got = suffixdup.repeated_passages(docs(spark, some), settings)
    return Counter(tuple(r) for r in got.select("doc_id", "role", "word", "n_words", "start", "end").collect())


def test_passages_equal_sql(spark):
    rng, shared, some = random.Random(6), [prose(k, 55 + 7 * k) for k in range(6)], []
    for k in range(40):
        parts = [prose(k + 50, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(shared)
            cut = text.split()[rng.randrange(10) : rng.randrange(45, 100)]
            parts += [rng.choice([" ", "\n", "  "]).join(cut), prose(rng.randrange(10_000), rng.randrange(1, 40))]
        some.append((k % 35, " ".join(parts), *[None] * 6))
    some[36] = some[1]  # a repeated row
    for k in (35, 37, 38, 39):
        some[k] = (k, *some[k][1:])
    for settings in (PASSAGES, suffixdup.Settings(min_words=12, gram=5)):
        want = _oracle(suffixdup.passages_sql(settings), some)
        assert want and passages(spark, some, settings) == want


def test_passages_cases(spark):
    assert passages(spark, rows(), PASSAGES) == _oracle(suffixdup.passages_sql(PASSAGES), rows())
    assert suffixdup.repeated_passages(empty(spark)).count() == 0
    once = [(1, prose(1, 60) + " " + prose(1, 60), *[None] * 6), (2, prose(3, 49), *[None] * 6), (3, prose(3, 49), *[None] * 6)]
    assert passages(spark, once, PASSAGES) == Counter()


def test_passages_of_one_doc_id_with_several_texts(spark):
    shared = prose(31, 70)
    some = [(1, prose(1, 40) + " " + shared, *[None] * 6), (1, shared + " " + prose(2, 40), *[None] * 6), (2, prose(3, 20) + " " + shared, *[None] * 6)]
    # The SQL has one text a doc_id.
    assert sorted(k[:4] for k in passages(spark, some, PASSAGES).elements()) == [(1, "first", 0, 70), (1, "repeat", 40, 70), (2, "repeat", 20, 70)]


def test_suffix_order_is_that_of_the_words():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    data, offsets = suffixdup.textvec.utf8(pa.array(texts))
    words = suffixdup.Words(data, offsets)
    last = np.searchsorted(words.doc, words.doc, "right")
    first = np.arange(len(words.doc))
    s = suffixdup.Suffixes(words, first, last - first)
    order = suffixdup.merge_sort(s, first, np.array([0]), np.array([len(first)]))
    code = s.word_hash
    want = sorted(first.tolist(), key=lambda i: (code[i : last[i]].tolist(), i))
    assert order.tolist() == want
    a, b = order[:-1], order[1:]
    for x, y, n in zip(a, b, s.common(a, b)):
        u, v = code[x : last[x]].tolist(), code[y : last[y]].tolist()
        assert n == next((k for k in range(min(len(u), len(v))) if u[k] != v[k]), min(len(u), len(v)))


def test_collision_is_not_a_match():
    data, offsets = suffixdup.textvec.utf8(pa.array(["a b c", "a b d"]))
    words = suffixdup.Words(data, offsets)
    assert suffixdup.equal_runs(words, np.array([0, 0]), np.array([3, 3]), 2).all()
    assert not suffixdup.equal_runs(words, np.array([0]), np.array([3]), 3).any()
