"""Licence notices and licence texts, found by a trained paragraph classifier and confirmed against templates.

A paragraph is a line, or lines joined where one is wrapped: neither line is blank, and the first
doesn't end in a full stop or another mark that ends a sentence.  It's a sparse vector of the word 1-
to 3-grams that the training set knows.  Multinomial logistic regression gives it a probability for
each licence family and for ``unknown``; a temperature fitted on held-out paragraphs calibrates them,
and a paragraph counts as licence text only if its family's probability reaches the level at which at
most ``false_positives`` of the held-out negatives would pass.  The family's templates are then
compared: `similarity` is the largest share of a template's word pairs that the paragraph has, in
whatever order, and `confirmed` says whether it reaches ``least_similarity``.

Of a joined paragraph the lines at its ends without which it's as similar are left out; where it isn't
licence text as a whole, its lines are taken by themselves.  Neighbouring paragraphs of one family,
without a blank line between them, are one.

Templates are one-line notices, and the headers and operative paragraphs of the families' texts.
Training paragraphs are these with seeded variations (words lost, parts of long ones, prose before and
after, other case), notices of licences of no family here and sentences that use a licence's words for
something else, both ``unknown``, and the paragraphs of at most ``train_rows`` documents, those whose
doc_id hashes lowest, that share no word triple with a notice and no six words with a longer template.

Defined cases: a null or empty text, and a paragraph without a known n-gram, gives no row (its
family is unknown); paragraphs of any length are scored whole; `paragraph` is the number of its first
line; of equal probabilities the family first in alphabetical order wins, of equal templates the longer,
then the first; repeated rows give their rows again; an empty table gives an empty result, and the model
is then fitted without prose; a null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textvec
from .hashing import lowest_hashed

SCHEMA = "doc_id bigint, paragraph int, start bigint, end bigint, family string, probability double, template int, similarity double, confirmed boolean"
UNKNOWN = "unknown"
#: One-line notices.
NOTICES: dict[str, list[str]] = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "This work is licensed under the AGPL v3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0", "This project is available under the terms of the Apache License 2.0.", "Apache License Version 2.0, January 2004"],
    "bsd": ["Redistribution and use in source and binary forms are permitted.", "Released under the BSD 3-Clause License.", "Licensed under the two-clause BSD license.", "SPDX-License-Identifier: BSD-2-Clause", "BSD 3-Clause License"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License.", "Published under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "This work is licensed under CC BY-SA 3.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPL v2 or later.", "This program is free software under the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GNU General Public License."],
    "isc": ["Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is licensed under the LGPL v3.", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "This software is distributed under the terms of the MIT License.", "The MIT License (MIT)"],
    "mpl": ["Licensed under the Mozilla Public License, version 2.0.", "Subject to the terms of the Mozilla Public License.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without permission.", "Confidential and proprietary. Do not distribute."],
    "public-domain": ["This work is dedicated to the public domain.", "Released under the Unlicense.", "Licensed under CC0 1.0 Universal.", "No rights reserved. Public domain."],
}
_AS_IS = "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."


def _gnu(name: str, what: str, version: str) -> list[str]:
    """The three paragraphs of a file header under one of the GNU licences."""
    return [
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.",
        f"You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>.",
    ]


#: Headers and operative paragraphs of the families' texts.
TEXTS: dict[str, list[str]] = {
    "agpl": [*_gnu("Affero General Public License", "program", "3"), "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."],
    "cc-by-nc": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."],
    "cc-by-sa": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."],
    "gpl": [
        *_gnu("General Public License", "program", "3"),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "lgpl": [
        *_gnu("Lesser General Public License", "library", "2.1"),
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        f'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
    ],
    "proprietary": ["No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ],
}
TEMPLATES = {family: notices + TEXTS[family] for family, notices in NOTICES.items()}
#: Notices of licences of none of the families.
FOREIGN = [
    "Licensed under the Common Development and Distribution License, version 1.0.", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "Licensed under the EUPL, Version 1.2 or later.", "This work is made available under the terms of the European Union Public Licence.", "This library is free software under the terms of the Artistic License 2.0.",
    "Released under the zlib license.", "This software is provided as-is, without any express or implied warranty, and may be altered and redistributed freely if the origin is not misrepresented.",
    "Distributed under the Boost Software License, Version 1.0.", "Released under the WTFPL.", "Licensed under the Microsoft Public License.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: CDDL-1.0", "Subject to the terms of the Common Public License.", "This program is made available under the terms of the Sun Public License v1.0.",
    "Licensed under the Business Source License 1.1.", "This work is licensed under the Open Data Commons Open Database License.", "This project is available under the terms of the Server Side Public License, version 1.",
    "Published under the Free Art License 1.3.", "Licensed under the Ruby license.", "Permission to use this file is granted under the PostgreSQL License.", "This document may be distributed under the Open Publication License.",
]
#: Sentences that use a licence's words for something else.
OTHER = [
    "Her driving license was renewed last week.", "The license plate of the car was read by the camera.", "A fishing license costs ten dollars.", "All of us have rights and duties.",
    "The public library is open to the general public.", "He studied at MIT before moving to London.", "The Apache people lived in the Southwest.", "The seats are reserved for guests.",
    "The new version 3 was released on Monday.", "Version 2.0 of the program is free.", "Under the terms of the contract they paid.", "The work is published every year.",
    "This work was finished under the general's command.", "The domain of the function is the real line.", "Copyright law is taught in the second year.", "The software was distributed to all schools.",
    "Released in 1999, the film was a success.", "Permission was granted by the mayor.", "They reserved all rooms for the meeting.", "The commons is open to the public.",
]


@dataclass(frozen=True)
class Settings:
    train_rows: int = 400
    variants: int = 14
    rounds: int = 120
    ridge: float = 1e-3
    false_positives: float = 1e-3
    least_similarity: float = 0.7
    seed: int = 5


@dataclass
class Model:
    families: list[str]  # in alphabetical order, with unknown among them
    grams: np.ndarray  # sorted hashes of the known n-grams
    weights: np.ndarray  # n-gram by family
    bias: np.ndarray
    temperature: float
    least_probability: float
    settings: Settings

    @property
    def unknown(self) -> int:
        return self.families.index(UNKNOWN)


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each line, whether it goes on with the line before); a line of no word is blank."""
    begin = np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data[:-1] == 10) + 1 if len(data) else np.zeros(0, np.int64)])
    begin = np.unique(begin)
    if not len(begin):
        return begin, np.zeros(0, bool)
    end = np.append(begin[1:], len(data))
    words = np.concatenate([[0], np.cumsum(textvec.ALNUM[data])])
    full = words[end] > words[begin]
    seen = np.flatnonzero(~textvec.SPACE[data])
    last = data[seen[np.maximum(np.searchsorted(seen, end) - 1, 0)]] if len(seen) else np.zeros(len(begin), np.uint8)
    goes_on = np.zeros(len(begin), bool)
    goes_on[1:] = full[1:] & full[:-1] & ~np.isin(last[:-1], list(b".!?:;")) & ~np.isin(begin[1:], offsets)
    return begin, goes_on


def paragraph_grams(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hash, number of its paragraph) of lower-cased text; `begin`: first byte of each paragraph."""
    starts, ends, doc = textvec.word_bounds(data, offsets, textvec.ALNUM)
    para = np.searchsorted(begin, starts, "right") - 1
    word = textvec.PrefixHash(data).of(starts, ends)
    grams, of, value = [word], [para], word
    for k in (2, 3):
        at = textvec.within(para, k)
        value = textvec.mixed(value[: len(word) - k + 1] * np.uint64(3) + word[k - 1 :]) if len(word) >= k else value[:0]
        grams.append(value[at]), of.append(para[at])
    return np.concatenate(grams), np.concatenate(of)


def _features(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of each n-gram among the known ones, or -1; a bit table turns most others away."""
    if len(known) == 0:
        return np.full(len(grams), -1)
    table = np.zeros(1 << 20, bool)
    table[(known >> np.uint64(44)).astype(np.int64)] = True
    out = np.full(len(grams), -1)
    maybe = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
    hit = known[at] == grams[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = [t.replace("\n", " ").lower() or " " for t in texts]
    data, offsets = textvec.utf8(pa.array(flat, pa.string()))
    return paragraph_grams(data, offsets, line_starts(data, offsets)[0])


def probabilities(feature: np.ndarray, row: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Calibrated probabilities of n paragraphs from pairs (feature, paragraph), each counted once."""
    pair = np.unique(row[feature >= 0] * np.int64(len(model.grams) + 1) + feature[feature >= 0])
    row, feature = np.divmod(pair, len(model.grams) + 1)
    logit = _sums(row, feature, n, model.weights) + model.bias
    return _softmax(logit / model.temperature)


def _variations(rng: random.Random, settings: Settings, prose: list[str]) -> tuple[list[str], list[str]]:
    filler = [w for t in [*prose, *OTHER] for w in t.split()] or ["text"]
    texts, labels = [], []

    def vary(template: str, family: str, n: int) -> None:
        for k in range(n):
            words = template.split()
            if k and len(words) > 24 and rng.random() < 0.5:  # a part of a long one, as a wrapped line has
                size = rng.randrange(12, len(words))
                at = rng.randrange(len(words) - size)
                words = words[at : at + size]
            if k and len(words) > 4 and rng.random() < 0.5:
                words.pop(rng.randrange(len(words)))
            if k and rng.random() < 0.4:
                words = rng.choices(filler, k=rng.randrange(1, 12)) + words
            if k and rng.random() < 0.4:
                words += rng.choices(filler, k=rng.randrange(1, 12))
            texts.append(" ".join(words)), labels.append(family)

    for family, templates in TEMPLATES.items():
        for template in templates:
            vary(template, family, settings.variants)
    for sentence in [*OTHER, *FOREIGN]:
        vary(sentence, UNKNOWN, settings.variants)
    return texts, labels


def fit(prose: list[str], settings: Settings = Settings()) -> Model:
    """Fit on the templates and on paragraphs of ordinary text."""
    rng = random.Random(settings.seed)
    triples = {x for ts in NOTICES.values() for t in ts for x in _word_runs(t, 3)}
    longer = {x for ts in TEXTS.values() for t in ts for x in _word_runs(t, 6)}
    prose = [t for t in prose if t.strip() and not triples & set(_word_runs(t, 3)) and not longer & set(_word_runs(t, 6))]
    texts, labels = _variations(rng, settings, prose)
    own, _ = _grams_of([t for ts in TEMPLATES.values() for t in ts] + OTHER + FOREIGN)
    grams = np.unique(own)
    texts, labels = texts + prose, labels + [UNKNOWN] * len(prose)
    families = sorted({*TEMPLATES, UNKNOWN})
    y = np.array([families.index(x) for x in labels])
    hashes, para = _grams_of(texts)
    feature = _features(hashes, grams)
    held = np.array([rng.random() < 0.25 for _ in texts])
    model = Model(families, grams, np.zeros((len(grams), len(families))), np.zeros(len(families)), 1.0, 0.5, settings)
    pair = np.unique(para[feature >= 0] * np.int64(len(grams)) + feature[feature >= 0])
    row, col = np.divmod(pair, len(grams))
    train = ~held[row]
    target = np.eye(len(families))[y]
    weight = np.where(held, 0, 1.0) / max(1, (~held).sum())
    r, c = row[train], col[train]
    by_gram = np.argsort(c, kind="stable")
    step = [np.zeros_like(model.weights), np.zeros_like(model.bias)]
    for _ in range(settings.rounds):  # Adagrad
        p = _softmax(_sums(r, c, len(texts), model.weights) + model.bias)
        error = (p - target) * weight[:, None]
        gradient = _sums(c[by_gram], r[by_gram], len(grams), error) + settings.ridge * model.weights / 10
        for x, g, s in ((model.weights, gradient, step[0]), (model.bias, error.sum(0), step[1])):
            s += g * g
            x -= 0.5 * g / np.sqrt(s + 1e-12)
    test = np.flatnonzero(held)
    best = None
    for temperature in np.geomspace(0.3, 5, 25):
        model.temperature = float(temperature)
        p = probabilities(feature, para, len(texts), model)[test, y[test]]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, model.temperature)
    model.temperature = best[1]
    p = probabilities(feature, para, len(texts), model)
    negative = held & (y == model.unknown)
    wrong = np.sort(np.delete(p[negative], model.unknown, 1).max(1)) if negative.any() else np.zeros(1)
    model.least_probability = max(0.5, float(wrong[min(len(wrong) - 1, int(np.ceil(len(wrong) * (1 - settings.false_positives))))]) + 1e-9)
    return model


def _sums(row: np.ndarray, col: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """For each of n rows the sum of the `values` of its columns; `row` rises."""
    out = np.zeros((n, values.shape[1]))
    if len(row):
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[head]] = np.add.reduceat(values[col], head, axis=0)
    return out


def _softmax(logit: np.ndarray) -> np.ndarray:
    p = np.exp(logit - logit.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _word_runs(text: str, k: int) -> list[tuple[str, ...]]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


_PAIRS = {family: [set(_word_runs(t, 2)) or set(_word_runs(t, 1)) for t in templates] for family, templates in TEMPLATES.items()}


def compare(paragraph: str, family: str, template: int | None = None) -> tuple[int, float]:
    """(number, similarity) of the family's template that the paragraph covers best, or of the given one."""
    have = {*_word_runs(paragraph, 2), *_word_runs(paragraph, 1)}
    if template is not None:
        return template, len(_PAIRS[family][template] & have) / len(_PAIRS[family][template])
    share = [len(pairs & have) / len(pairs) for pairs in _PAIRS[family]]
    best = max(range(len(share)), key=lambda k: (share[k], len(_PAIRS[family][k]), -k))
    return best, share[best]


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    some = lowest_hashed(rows, "doc_id", settings.train_rows, docs.count())
    return fit([p for t in some.column("text").to_pylist() for p in t.split("\n")], settings)


def _hits(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, model: Model) -> dict[int, tuple[int, float]]:
    """Family and probability of the paragraphs that are licence text."""
    grams, para = paragraph_grams(data, offsets, begin)
    feature = _features(grams, model.grams)
    some, row = np.unique(para[feature >= 0], return_inverse=True)
    if not len(some):
        return {}
    p = probabilities(feature[feature >= 0], row, len(some), model)
    top, best = p.argmax(1), p.max(1)
    return {int(some[h]): (int(top[h]), float(best[h])) for h in np.flatnonzero((top != model.unknown) & (best >= model.least_probability))}


def _found(lines: list[str], whole: dict[tuple[int, int], tuple[str, float]], single: dict[int, tuple[str, float]]) -> list[tuple[int, int, str, float, int, float]]:
    """(first line, last line, family, probability, template, similarity) of a document's licence paragraphs.

    `whole` has the joined paragraphs that are licence text, `single` the lines.
    """
    runs = []
    for (a, b), (family, p) in whole.items():
        at, most = compare("\n".join(lines[a : b + 1]), family)
        while a < b and compare("\n".join(lines[a + 1 : b + 1]), family, at)[1] >= most:
            a += 1
        while a < b and compare("\n".join(lines[a:b]), family, at)[1] >= most:
            b -= 1
        runs.append((a, b, family, p))
    inside = {k for a, b in whole for k in range(a, b + 1)}
    runs += [(k, k, family, p) for k, (family, p) in single.items() if k not in inside]
    merged: list[tuple[int, int, str, float]] = []
    for a, b, family, p in sorted(runs):
        if merged and merged[-1][1] + 1 == a and merged[-1][2] == family:
            merged[-1] = (merged[-1][0], b, family, max(p, merged[-1][3]))
        else:
            merged.append((a, b, family, p))
    return [(a, b, family, p, *compare("\n".join(lines[a : b + 1]), family)) for a, b, family, p in merged]


def _notices(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    plain, plain_at = textvec.utf8(batch.column(1))
    lower, lower_at = textvec.utf8(pc.utf8_lower(batch.column(1).cast(pa.large_string()).fill_null("")))
    rows: list[tuple] = []
    for lo, hi in textvec.chunks(lower_at):
        data, offsets = lower[lower_at[lo] : lower_at[hi]], lower_at[lo : hi + 1] - lower_at[lo]
        begin, goes_on = line_starts(data, offsets)
        single = _hits(data, offsets, begin, model)
        whole = {}
        if goes_on.any():
            head = np.flatnonzero(~goes_on)
            last = np.append(head[1:], len(begin)) - 1
            for k, hit in _hits(data, offsets, begin[head], model).items():
                whole[int(head[k]), int(last[k])] = hit
        doc = np.searchsorted(offsets, begin, "right") - 1
        by: dict[int, tuple[dict, dict]] = {}
        for k, (family, p) in single.items():
            by.setdefault(int(doc[k]), ({}, {}))[1][k] = (model.families[family], p)
        for (a, b), (family, p) in whole.items():
            by.setdefault(int(doc[a]), ({}, {}))[0][a, b] = (model.families[family], p)
        for d in sorted(by):
            first, i = int(np.searchsorted(doc, d)), d + lo
            lines = plain[plain_at[i] : plain_at[i + 1]].tobytes().decode().split("\n")
            start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
            joined = {(a - first, b - first): x for (a, b), x in by[d][0].items()}
            for a, b, family, p, template, similarity in _found(lines, joined, {k - first: x for k, x in by[d][1].items()}):
                rows.append((batch.column(0)[i].as_py(), a, start[a], start[b] + len(lines[b]), family, p, template, similarity, similarity >= model.settings.least_similarity))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.bool_())
    names = ["doc_id", "paragraph", "start", "end", "family", "probability", "template", "similarity", "confirmed"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each licence paragraph of `docs` (doc_id, text): a map over partitions, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 1):
            yield from _notices(batch, model)

    return textvec.arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
