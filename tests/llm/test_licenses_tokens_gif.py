import textwrap

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import gif, licenses, tokens

from .helpers import docs, empty, prose, rows


@pytest.fixture(scope="module")
def model():
    return licenses.fit([prose(k, 30) for k in range(60)])


def test_notices_among_prose(spark, model):
    rng = np.random.default_rng(8)
    some, want = [], {}
    for family, templates in licenses.NOTICES.items():
        for t in templates:
            k = len(some) + 1
            before = [prose(int(rng.integers(10_000)), 12)]
            some.append((k, "\n".join([*before, t.upper() if k % 3 == 0 else t, prose(k, 8)]), *[None] * 6))
            want[k] = family
    got = licenses.find(docs(spark, some), model).collect()
    assert all(r.paragraph == 1 for r in got) and len(got) == len({r.doc_id for r in got})
    right = sum(want[r.doc_id] == r.family and r.confirmed for r in got)
    assert right >= 0.95 * len(want)
    text = {r[0]: r[1] for r in some}
    assert all(text[r.doc_id][r.start : r.end] == text[r.doc_id].split("\n")[1] for r in got)


#: Texts that aren't in the training set: other wording, wrapping and decoration.
UNSEEN = [
    ("mit", "The code in this directory is released under the terms of the MIT license, like all the rest."),
    ("apache", "This module is made available under the Apache License, version 2.0."),
    ("gpl", "You may use this work under the GNU General Public License, either version 3 or any later one."),
    ("mpl", "All source files here are subject to the Mozilla Public License, version 2.0."),
    ("lgpl", "The library may be used under the terms of the GNU Lesser General Public License."),
    ("cc-by-sa", "Photographs are available under the Creative Commons Attribution-ShareAlike License 4.0."),
    ("bsd", "It is released under the BSD 3-Clause License by its contributors."),
]
OUTSIDE = [
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v2.0 which accompanies this distribution.", "Licensed under the Eclipse Public License 2.0.",
    "Licensed under the Academic Free License version 3.0", "Released under the PHP License 3.01.", "Licensed under the Open Software License 3.0", "His licence to sell beer was granted by the county.",
]


def test_unseen_wording_and_licences_outside(spark, model):
    some = [(k, "\n".join([prose(k, 9) + ".", t, prose(k + 50, 8)]), *[None] * 6) for k, (_, t) in enumerate(UNSEEN)] + [(100 + k, t, *[None] * 6) for k, t in enumerate(OUTSIDE)]
    got = licenses.find(docs(spark, some), model).collect()
    assert not [r for r in got if r.doc_id >= 100 and r.confirmed]
    assert sum(r.doc_id < 100 and r.family == UNSEEN[r.doc_id][0] for r in got) >= len(UNSEEN) - 1


@pytest.mark.parametrize("width, mark", [(60, ""), (78, "# "), (95, " * ")])
def test_wrapped_bodies(spark, model, width, mark):
    """Each paragraph of each text, wrapped: one row that covers it."""
    some, want = [], {}
    for family, texts in licenses.TEXTS.items():
        wrapped = ["\n".join(textwrap.wrap(t, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False)) for t in texts]
        k = len(some)
        text = prose(k, 40) + ".\n\n" + f"\n{mark.rstrip()}\n".join(wrapped) + "\n\n" + prose(k + 9, 30)
        some.append((k, text, *[None] * 6))
        want |= {(k, text.index(w)): (family, text.index(w) + len(w)) for w in wrapped}
    got = {(r.doc_id, r.start): (r.family, r.end) for r in licenses.find(docs(spark, some), model).collect() if r.confirmed}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.85 * len(want)  # a line that happens to end in a full stop ends a paragraph


def slow_find(text, model):
    """(paragraph, start, end, family) line by line, with n-grams of words in dictionaries."""
    number = {h: i for i, h in enumerate(model.grams.tolist())}

    def judge(paragraph):
        hashes, _ = licenses._grams_of([paragraph])
        known = {number[h] for h in hashes.tolist() if h in number}
        logit = (model.bias + sum((model.weights[i] for i in known), np.zeros(len(model.bias)))) / model.temperature
        p = np.exp(logit - logit.max())
        p /= p.sum()
        k = int(p.argmax())
        return model.families[k] if known and k != model.unknown and p[k] >= model.least_probability else None

    lines = (text or "").split("\n")
    full = [any(c.isalnum() for c in x) for x in lines]
    groups, out = [], []
    for k, line in enumerate(lines):
        if k and full[k] and full[k - 1] and lines[k - 1].rstrip()[-1] not in ".!?:;":
            groups[-1].append(k)
        else:
            groups.append([k])
    for group in groups:
        joined = lambda ks: "\n".join(lines[k] for k in ks)
        if len(group) > 1 and (family := judge(joined(group))):
            at, most = licenses.compare(joined(group), family)
            while len(group) > 1 and licenses.compare(joined(group[1:]), family, at)[1] >= most:
                group = group[1:]
            while len(group) > 1 and licenses.compare(joined(group[:-1]), family, at)[1] >= most:
                group = group[:-1]
            out.append((group[0], group[-1], family))
        else:
            out += [(k, k, family) for k in group if (family := judge(lines[k]))]
    merged = []
    for a, b, family in out:
        if merged and merged[-1][1] + 1 == a and merged[-1][2] == family:
            merged[-1] = (merged[-1][0], b, family)
        else:
            merged.append((a, b, family))
    start = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    return [(a, start[a], start[b] + len(lines[b]), family) for a, b, family in merged]


def test_find_equals_slow_version(spark, model):
    bodies = ["\n".join(textwrap.wrap(" ".join(ts), 70)) for ts in licenses.TEXTS.values()]
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text ilike '%licen%' or text ilike '%rights%' or doc_id < 40").collect()]
    some += [*bodies, *OUTSIDE, "é Licensed under CC BY 4.0.\n\u3000\nAll rights reserved", "", None, "\n\n", *("\n".join([prose(k, 5), t, "", t.upper(), t]) for k, (_, t) in enumerate(UNSEEN))]
    got = {}
    for r in licenses.find(docs(spark, [(k, t, *[None] * 6) for k, t in enumerate(some)]), model).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.start, r.end, r.family))
        assert (r.template, r.similarity) == licenses.compare(some[r.doc_id][r.start : r.end], r.family)
    assert len(got) > 25
    for k, text in enumerate(some):
        assert sorted(got.get(k, [])) == slow_find(text, model), text


def test_other_uses_of_the_words(spark, model):
    some = [(k, t, *[None] * 6) for k, t in enumerate([*licenses.OTHER, *licenses.FOREIGN, "We drove to the general store.", "Her license expired in May.", prose(4, 50)])]
    assert [r for r in licenses.find(docs(spark, some), model).collect() if r.confirmed] == []


def test_probabilities_against_plain_sums(model):
    texts = ["Released under the MIT License.", "nothing known", "All rights reserved"]
    hashes, para = licenses._grams_of(texts)
    p = licenses.probabilities(licenses._features(hashes, model.grams), para, 3, model)
    for k in range(3):
        own = {int(np.searchsorted(model.grams, h)) for h in hashes[para == k] if h in set(model.grams.tolist())}
        logit = (model.bias + sum((model.weights[i] for i in own), np.zeros(len(model.bias)))) / model.temperature
        e = np.exp(logit - logit.max())
        assert np.allclose(p[k], e / e.sum())
    assert model.families[int(p[1].argmax())] == licenses.UNKNOWN


def test_license_cases(spark, model):
    assert licenses.find(docs(spark), model).count() == 0
    twice = [(8, "Released under the MIT License.\n\nAll rights reserved.", *[None] * 6)] * 2 + [(None, "All rights reserved.", *[None] * 6)]
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in licenses.find(docs(spark, twice), model).collect())
    assert got == [(0, 0, "proprietary"), (8, 0, "mit"), (8, 0, "mit"), (8, 2, "proprietary"), (8, 2, "proprietary")]
    assert licenses.find(empty(spark), licenses.train(empty(spark))).count() == 0


def test_tokens_against_one_by_one(spark):
    text = "Title é\n\nBody　text 漢字漢字 🙂\n   indented\n\n\nlast  line  "
    some = [(1, text, *[None] * 6), (2, "\n\nx", *[None] * 6), (3, "\n\n", *[None] * 6)]
    encoding, _ = tokens.encoder(tokens.TOKENIZER)
    for _, text, *_ in some:
        got = sorted((r for r in tokens.section_tokens(docs(spark, some)).collect() if text == dict((s[0], s[1]) for s in some)[r.doc_id]), key=lambda r: r.section)
        assert "".join(text[r.start : r.end] for r in got) == text
        ids = encoding.encode_ordinary(text)
        assert sum(r.n_tokens for r in got) == len(ids)
        # Each character's tokens, by the bytes of the tokens so far.
        want, crossing, at = [0] * len(got), 0, 0
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        for i in ids:
            n = len(encoding.decode_single_token_bytes(i))
            a, b = owner[at], owner[at + n - 1] + 1
            at += n
            share = [min(b, r.end) - max(a, r.start) for r in got]
            want[int(np.argmax(share))] += 1
            crossing += sum(s > 0 for s in share) > 1
        assert [r.n_tokens for r in got] == want and sum(r.n_crossing for r in got) == crossing


def test_long_white_space(spark, monkeypatch):
    encoding, _ = tokens.encoder(tokens.TOKENIZER)
    for text in (" " * 1_200_000, "\n" * 1_200_000 + "x", "a " + " \n" * 600_000 + " b\u3000c"):
        got = tokens.section_tokens(docs(spark, [(1, text, *[None] * 6)])).collect()
        assert sum(r.n_tokens for r in got) == len(tokens.encoded(encoding, text)) and max(r.end for r in got) == len(text)
    monkeypatch.setattr(tokens, "LONG_SPACE", tokens.re.compile(tokens.LONG_SPACE.pattern.replace("65536", "3")))
    for text in ("a   b", "a    ", "   ", "x\n\n\n\n  y   1   !   's", "a\u3000\u3000  \u3000b", "\x1c\x1c\x1c\x1c a", "    漢字\t\t\t\tend"):
        assert tokens.encoded(encoding, text).tolist() == encoding.encode_ordinary(text)


def test_boundary_rule():
    bounds = np.array([0, 4, 5, 9])
    at, crosses = tokens.attribute(np.array([0, 2, 3, 3, 1, 4]), np.array([4, 6, 5, 8, 9, 5]), bounds)
    assert at.tolist() == [0, 0, 0, 2, 2, 1] and crosses.tolist() == [False, True, True, True, True, False]


def test_token_cases(spark):
    got = tokens.section_tokens(docs(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id in (3, 4)}
    assert all((by[k].section, by[k].start, by[k].end, by[k].n_tokens) == (0, 0, 0, 0) for k in (3, 4))
    assert len(got) == len(rows()) + 1  # the blank one has a line feed
    assert tokens.section_tokens(empty(spark)).count() == 0


SAMPLE = bytes.fromhex(  # two colours in blocks, from the published description of the format
    "4749463839610a000a00910000ffffffff00000000ff00000021f9040000000000" "2c000000000a000a00000216" "8c2d99872a1cdc33a00275ec95faa8de608c04914c01003b"
)


def draw_slowly(width, height, palette, images):
    """Screens of the frames, pixel by pixel."""
    screen, out = {}, []
    for x in images:
        before = dict(screen)
        p = x.palette or palette
        for (r, c), v in np.ndenumerate(x.pixels):
            at = (r + x.top, c + x.left)
            if v != x.transparent and at[0] < height and at[1] < width:
                screen[at] = (*p[3 * v : 3 * v + 3], 255)
        out.append([screen.get((r, c), (0, 0, 0, 0)) for r in range(height) for c in range(width)])
        if x.disposal == 2:
            for r in range(x.pixels.shape[0]):
                for c in range(x.pixels.shape[1]):
                    screen.pop((r + x.top, c + x.left), None)
        elif x.disposal == 3:
            screen = before
    return out


def test_gif_sample():
    frames, loops, size, error = gif.decode(SAMPLE)
    assert error is None and size == (10, 10) and len(frames) == 1
    rows = frames[0].screen[..., :3]
    assert rows[0, 0].tolist() == [255, 0, 0] and rows[0, 9].tolist() == [0, 0, 255] and rows[4, 4].tolist() == [255, 255, 255]


def test_gif_round_trip():
    rng = np.random.default_rng(3)
    for trial in range(30):
        width, height = (int(x) for x in rng.integers(1, 40, 2))
        n = int(2 ** rng.integers(1, 9))
        palette, own = (rng.integers(0, 256, 3 * n).astype(np.uint8).tobytes() for _ in range(2))
        images = []
        for _ in range(int(rng.integers(1, 5))):
            left, top = int(rng.integers(width)), int(rng.integers(height))
            w, h = int(rng.integers(1, width + 3)), int(rng.integers(1, height + 3))
            clear = int(rng.integers(n)) if rng.random() < 0.5 else None
            images.append(gif.Image(rng.integers(0, n, (h, w)), left, top, 10 * int(rng.integers(20)), int(rng.integers(4)), clear, bool(rng.random() < 0.5), own if rng.random() < 0.3 else None))
        frames, loops, size, error = gif.decode(gif.encode(width, height, palette, images, loops=trial))
        assert error is None and loops == trial and size == (width, height)
        want = draw_slowly(width, height, palette, images)
        assert [f.screen.reshape(-1, 4).tolist() for f in frames] == [[list(p) for p in s] for s in want]
        assert [f.delay_ms for f in frames] == [x.delay_ms for x in images]
        assert [f.start_ms for f in frames] == np.concatenate([[0], np.cumsum([x.delay_ms for x in images])])[:-1].tolist()


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for least in (2, 4, 8):
        for n in (0, 1, 7, 300, 20_000):
            for most in (1, 2**least):
                p = rng.integers(0, most, n).astype(np.uint8).tobytes()
                assert gif.lzw_decode(gif.lzw_encode(p, least), least, n + 5) == p


def lzw_slowly(data, least, most):
    """Code by code, with a table of strings."""
    clear, table, width, before, out, at = 1 << least, [], 0, b"", b"", 0
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    width = least + 1
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    while at + width <= len(bits) and len(out) < most:
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == clear:
            table, width, before = table[: clear + 2], least + 1, b""
            continue
        if code == clear + 1:
            break
        if code < len(table):
            run = table[code]
        elif code == len(table) and before:
            run = before + before[:1]
        else:
            return None
        out += run
        if before and len(table) < 4096:
            table.append(before + run[:1])
        width += len(table) >= 1 << width and width < 12
        before = run
    return out[:most]


def test_lzw_equals_slow_decoder():
    rng = np.random.default_rng(11)
    for trial in range(150):
        least = int(rng.integers(1, 9))
        if trial % 3 == 0:  # any bits: bad codes, clear and stop codes anywhere
            data = rng.integers(0, 256, int(rng.integers(0, 60))).astype(np.uint8).tobytes()
        else:
            n = int(rng.choice([3, 500, 30_000]))
            data = gif.lzw_encode(np.minimum(rng.geometric(0.3, n), 2**least - 1).astype(np.uint8).tobytes(), least)
            data = data[: int(rng.integers(len(data) + 1))] if trial % 3 == 1 else data
        most = int(rng.choice([10, 400, 100_000]))
        want = lzw_slowly(data, least, most)
        if want is None:
            with pytest.raises(gif.GifError):
                gif.lzw_decode(data, least, most)
        else:
            assert gif.lzw_decode(data, least, most) == want
    codes = np.concatenate([np.random.default_rng(2).integers(0, 128, 3000), np.random.default_rng(3).integers(130, 3000, 7000)]).tolist()  # a full table without a clear code
    bits = "".join(f"{c:0{min(12, (129 + k).bit_length())}b}"[::-1] for k, c in enumerate(codes))
    late = bytes(int(bits[k : k + 8].ljust(8, "0")[::-1], 2) for k in range(0, len(bits), 8))
    want = lzw_slowly(late, 7, 10**7)
    assert len(want) > 15_000 and gif.lzw_decode(late, 7, 10**7) == want


def test_bands_and_many_frames():
    rng = np.random.default_rng(5)
    palette = rng.integers(0, 256, 48).astype(np.uint8).tobytes()
    images = [gif.Image(rng.integers(0, 16, (int(rng.integers(1, 40)), int(rng.integers(1, 30)))), int(rng.integers(0, 20)), int(rng.integers(0, 40)), 10 * k, k % 4, 3, k % 2 == 0) for k in range(12)]
    data = gif.encode(25, 50, palette, images)
    whole = list(gif.rows_of(1, data, 1 << 22))
    assert [r[13:16] for r in whole] == [(0, 0, 50)] * 12
    for pixels in (1, 25, 26 * 7, 25 * 49):
        rows = list(gif.rows_of(1, data, pixels))
        for k, r in enumerate(whole):
            own = [x for x in rows if x[1] == k]
            assert b"".join(x[16] for x in own) == r[16] and np.sum([x[17] for x in own], 0).tolist() == r[17] and sum(x[18] for x in own) == r[18]
            assert max(x[15] for x in own) * 25 <= max(pixels, 25) and [x[2:13] for x in own] == [r[2:13]] * len(own)
    broken = data[: len(data) // 2]
    assert [r[-1] for r in gif.rows_of(1, broken, 100) if r[-1]] == ["breaks off"]
    many = gif.rows_of(1, gif.encode(2000, 1500, palette, [gif.Image(np.full((1, 1), 2), k, k) for k in range(400)]), 1 << 22)
    assert sum(1 for _ in many) == 400  # 4.8 GB of screens, one at a time
    tall = gif.encode(30_000, 30_000, palette, [gif.Image(np.full((2, 2), 5), 29_998, 29_998)])  # 3.6 GB of screen
    first = next(gif.rows_of(1, tall, 1 << 20))
    assert first[12:16] == (0, 0, 0, (1 << 20) // 30_000) and first[18] == first[15] * 30_000


def test_stand_in_shows_the_markup():
    html = bytes(range(1, 120)) * 900
    frames, _, (width, height), error = gif.decode(gif.page_animation(7, html))
    assert error is None and len(frames) == 4 and width == gif.WIDTH and height >= len(html) // 4 // 4 // width
    sums = np.frombuffer(html, np.uint8).reshape(-1, 4).sum(1, dtype=np.uint8)[: len(html) // 16]
    colours = np.frombuffer(gif.PALETTE, np.uint8).reshape(-1, 3)
    assert (frames[0].screen[: frames[0].height].reshape(-1, 4)[: len(sums), :3] == colours[sums]).all()


def test_gif_cases(spark):
    whole = gif.page_animation(5, b"some markup" * 30)
    some = [(1, whole), (1, whole), (2, None), (3, b""), (4, b"PNG and more"), (5, whole[: len(whole) // 2]), (None, SAMPLE), (6, whole[:40] + b"\x00" + whole[41:])]
    got = gif.frames(spark.createDataFrame([(k, bytearray(b) if b is not None else None, "x") for k, b in some], "page_id bigint, gif binary, frame string")).collect()
    by = {k: [r for r in got if r.page_id == k] for k in (1, 2, 3, 4, 5, None)}
    assert len(by[1]) == 8 and all(r.error is None for r in by[1])
    assert [r.error for k in (2, 3, 4) for r in by[k]] == ["null", "breaks off", "not a GIF"]
    assert by[5][-1].error and all(r.rgba is not None for r in by[5][:-1])
    assert by[None][0].histogram[0b111111] + by[None][0].histogram[0b110000] + by[None][0].histogram[0b000011] == 100
    assert sum(by[1][0].histogram) + by[1][0].n_transparent == by[1][0].width * by[1][0].height
    assert gif.frames(spark.createDataFrame([], "page_id bigint, gif binary")).count() == 0
    pages = spark.createDataFrame([(1, None), (None, ""), (2, "<p>x")], "page_id bigint, html string")
    assert sorted(r.error or "" for r in gif.frames(gif.page_media(pages)).select("error").distinct().collect()) == ["", "null"]
