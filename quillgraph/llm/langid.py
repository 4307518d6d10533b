"""Language identification of mixed-language text.

A word's letters name its script, and the script narrows the candidates: a language is a candidate
for a script in which the training rows of that language have letters, and a script without any
trained language stands for its one default language (``mis`` where that has none of its own).  A word's score for a candidate is the sum
over its byte trigrams (the word's ends included) of the trained log-likelihood ratio of that
language against the mean of all, bounded so that no single word decides.  Viterbi over the words
of a document, with a fixed penalty for a change of language, labels spans; a word without letters
scores nothing and takes its neighbours' language.

Training is a count of trigrams by the `lang` label over at most ``train_rows`` rows, those whose
identifier hashes lowest, so that the sample is the same on every run.  Where no label has Latin
letters, a sample of the rows without a label is the language ``und`` of Latin words.

A document is rejected (``keep`` false) when it has no letters at all, or when ``mean_score`` is
below ``least_score``: the text then is like none of the languages.  ``mean_score`` is the mean over
the words with letters of the log-likelihood ratio of their label against letters drawn at random
with the frequencies of all training text, bounded like the other, so that it has the same meaning
with one trained language as with many.

Defined cases: a null, empty or letterless text has lang ``und``, no spans and is rejected; a text
of any length is labelled as a whole; equal scores go to the language first in alphabetical order
and to no change of language; repeated rows get equal results; an empty table gives an empty
result, and a training table without text a model that knows scripts only; other columns are ignored
by :func:`identify` and passed through by :func:`accepted`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .hashing import lowest_hashed

SCHEMA = (
    "doc_id bigint, lang string, lang_share double, n_words int, mean_score double, n_spans int, keep boolean,"
    " spans array<struct<lang: string, start: bigint, end: bigint>>"
)
TRIGRAM_BITS = 16
#: Script numbers: 0 none, 1 Latin; each further one with the words that begin its letters' names and a default language.
SCRIPTS = {
    2: ("GREEK COPTIC", "el"), 3: ("CYRILLIC", "ru"), 4: ("HEBREW", "he"), 5: ("ARABIC", "ar"), 6: ("DEVANAGARI", "hi"), 7: ("THAI", "th"), 8: ("CJK IDEOGRAPHIC BOPOMOFO", "zh"),
    9: ("HIRAGANA KATAKANA KATAKANA-HIRAGANA HALFWIDTH-KATAKANA", "ja"), 10: ("HANGUL HALFWIDTH-HANGUL", "ko"), 11: ("ARMENIAN", "hy"), 12: ("GEORGIAN", "ka"), 13: ("BENGALI", "bn"),
    14: ("GURMUKHI", "pa"), 15: ("GUJARATI", "gu"), 16: ("ORIYA", "or"), 17: ("TAMIL", "ta"), 18: ("TELUGU", "te"), 19: ("KANNADA", "kn"), 20: ("MALAYALAM", "ml"), 21: ("SINHALA", "si"),
    22: ("LAO", "lo"), 23: ("TIBETAN", "bo"), 24: ("MYANMAR", "my"), 25: ("KHMER", "km"), 26: ("MONGOLIAN", "mn"), 27: ("ETHIOPIC", "am"), 28: ("CHEROKEE", "chr"), 29: ("CANADIAN", "iu"),
    30: ("YI", "ii"), 31: ("SYRIAC", "syr"), 32: ("THAANA", "dv"), 33: ("NKO", "nqo"), 34: ("OL", "sat"), 35: ("TIFINAGH", "zgh"), 36: ("BALINESE", "ban"), 37: ("JAVANESE", "jv"),
    38: ("SUNDANESE", "su"), 39: ("ADLAM", "ff"),
    40: ("", "mis"),  # all other scripts: a language without a code
}
#: A default language may also write in these scripts: Japanese uses Han beside Kana.
ALSO = {"ja": [8]}
NEVER = -60.0
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    train_rows: int = 4000
    switch_penalty: float = 9.0
    word_bound: float = 8.0
    smoothing: float = 0.5
    least_score: float = 0.25
    #: A language is a candidate for a script with at least this share of its training letters.
    script_share: float = 0.02


@dataclass
class Model:
    langs: list[str]  # trained ones, then default ones of scripts without any
    table: np.ndarray  # score by trained language and trigram
    neutral: np.ndarray  # the same against the language-neutral background
    scripts: np.ndarray  # script -> score added by language: 0, NEVER, or a default language's constant
    settings: Settings


def _letter_codes() -> np.ndarray:
    """Script of each code point: of letters and marks, by the first word of their names."""
    of = {word: k for k, (words, _) in SCRIPTS.items() for word in words.split()} | dict.fromkeys(("LATIN", "FULLWIDTH", "MATHEMATICAL", "MICRO", "KELVIN", "ANGSTROM", "FEMININE", "MASCULINE"), 1)
    out = np.zeros(0x110000, np.int8)
    for c in range(0x41, 0x20000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L" or kind[0] == "M":
            name = unicodedata.name(chr(c), "").split()
            if name and name[0] == "HALFWIDTH":
                name[0] = f"HALFWIDTH-{name[1]}"
            if name and name[0] not in ("COMBINING", "MODIFIER", "VARIATION"):
                out[c] = of.get(name[0], max(SCRIPTS))
    out[0x20000:0x32000] = 8
    return out


CODES = _letter_codes()
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def letter_scripts(data: np.ndarray) -> np.ndarray:
    """For each byte, the script of the letter of which it is the first byte; 0 elsewhere."""
    out = ASCII_LETTER[data].astype(np.int8)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a = data[lead].astype(np.int32)
        b, c, d = (padded[lead + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
        code = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d))
        out[lead] = CODES[np.minimum(code, 0x10FFFF)]
    return out


def trigrams(data: np.ndarray, script: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Trigram number around each byte of a letter, 0 at other bytes.  A word's ends count as a space."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = data
    x = padded[:-2] << np.uint32(8)
    x[starts] = 32 << 8
    x |= padded[1:-1]
    x <<= np.uint32(8)
    padded[2:][ends - 1] = 32
    x |= padded[2:]
    x *= np.uint32(2654435761)
    x >>= np.uint32(32 - TRIGRAM_BITS)
    letter = (script > 0) | (data >= 0x80)
    np.maximum(x, 1, out=x)
    x *= letter
    return x.astype(np.int32)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most `train_rows` labelled rows of `docs` (doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = lowest_hashed(labelled, "doc_id", settings.train_rows, docs.where(F.col("lang").isNotNull()).count())
    texts, labels = sample.column("text").to_pylist(), sample.column("lang").to_pylist()
    model = fit(texts, labels, settings)
    if (model.scripts[1, : len(model.table)] == 0).any():
        return model
    others = docs.where(F.col("lang").isNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sample = lowest_hashed(others, "doc_id", settings.train_rows, docs.where(F.col("lang").isNull()).count())
    more = sample.column("text").to_pylist()
    return fit(texts + more, labels + [UNKNOWN] * len(more), settings) if more else model


def background(sides: np.ndarray) -> np.ndarray:
    """Share of each trigram number where bytes are independent; `sides`: counts of the left, own and right byte."""
    a, b, c = (np.flatnonzero(x) for x in sides)
    p, q, r = (x[k] / max(1, x.sum()) for x, k in zip(sides, (a, b, c), strict=True))
    out = np.zeros(1 << TRIGRAM_BITS)
    for i, share in zip(a, p, strict=True):
        code = np.uint32(i << 16) | (b.astype(np.uint32) << np.uint32(8))[:, None] | c.astype(np.uint32)
        at = np.maximum((code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS), 1)
        out += np.bincount(at.ravel().astype(np.int64), (share * q[:, None] * r).ravel(), 1 << TRIGRAM_BITS)
    return out


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    trained = sorted(set(labels))
    counts = np.zeros((max(1, len(trained)), 1 << TRIGRAM_BITS))
    letters = np.zeros((max(1, len(trained)), max(SCRIPTS) + 1))
    sides = np.zeros((3, 256))
    for k, lang in enumerate(trained):
        data, offsets = textvec.utf8(pc.utf8_lower(pa.array([t for t, x in zip(texts, labels, strict=True) if x == lang], pa.string())))
        starts, ends, _ = textvec.word_bounds(data, offsets, ~textvec.SPACE)
        script = letter_scripts(data)
        at = trigrams(data, script, starts, ends)
        counts[k] = np.bincount(at, minlength=1 << TRIGRAM_BITS)
        centre, left, right = np.flatnonzero(at), np.full(len(data), 32, np.uint8), np.full(len(data), 32, np.uint8)
        left[1:], right[:-1] = data[:-1], data[1:]
        left[starts], right[ends - 1] = 32, 32
        for side, x in zip(sides, (left, data, right), strict=True):
            side += np.bincount(x[centre], minlength=256) / max(1, len(centre))  # each language weighs the same
        letters[k] = np.bincount(script, minlength=letters.shape[1])
    counts[:, 0] = 0
    rate = np.log((counts + settings.smoothing) / (counts.sum(1, keepdims=True) + settings.smoothing * (1 << TRIGRAM_BITS)))
    table = rate - rate.mean(0)
    table[:, counts.sum(0) < 2] = 0  # what was hardly seen says nothing
    table[:, 0] = 0
    table = table[: len(trained)]
    neutral = np.log((counts + settings.smoothing) / (counts.sum(1, keepdims=True) * background(sides) + settings.smoothing))[: len(trained)]
    neutral[:, 0] = 0
    letters[:, 0] = 0
    share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    for i in [i for i, lang in enumerate(trained) if lang == UNKNOWN]:
        share[i, 2:] = 0  # other scripts have default languages
    extra = [lang for k, (_, lang) in SCRIPTS.items() if not any(share[i, k] >= settings.script_share for i in range(len(trained))) and lang not in trained]
    langs = trained + extra
    scripts = np.full((letters.shape[1], len(langs)), NEVER, np.float32)
    scripts[0] = 0
    for i in range(len(trained)):
        scripts[1:, i][share[i, 1:] >= settings.script_share] = 0
    for k, (_, lang) in SCRIPTS.items():
        if (scripts[k] == NEVER).all():  # no trained language has letters of it
            scripts[k, langs.index(lang)] = 4.0
            if lang in extra:
                scripts[ALSO.get(lang, []), langs.index(lang)] = 3.0
    return Model(langs, table.astype(np.float32), neutral.astype(np.float32), scripts, settings)


def candidates(script: np.ndarray, model: Model) -> np.ndarray:
    """Numbers of the languages that words of these scripts can have: the trained ones, which come first, and default ones."""
    n = len(model.table)
    own = np.flatnonzero(np.bincount(script, minlength=len(model.scripts))[1:]) + 1
    if not n and not len(own):
        return np.arange(len(model.langs))
    return np.concatenate([np.arange(n), np.flatnonzero((model.scripts[own, n:] > NEVER).any(0)) + n])


def word_scores(data: np.ndarray, offsets: np.ndarray, model: Model):
    """(starts, ends, document, script, trigrams, score by candidate) of the words of lower-cased text."""
    starts, ends, doc = textvec.word_bounds(data, offsets, ~textvec.SPACE)
    script = letter_scripts(data)
    at = trigrams(data, script, starts, ends)
    n_trained, n = len(model.table), len(starts)
    if n == 0:
        return starts, ends, doc, np.zeros(0, np.int8), at, np.zeros((0, len(model.langs)), np.float32)
    # Trigram 0 scores nothing, so what follows a word may be summed with it.
    most = np.maximum.reduceat(script, starts)  # the word's script; of several the last, so that one of Han and Kana is Japanese
    langs = candidates(most, model)
    score = np.zeros((n, len(langs)), np.float32)
    for i in range(n_trained):
        score[:, i] = np.add.reduceat(np.take(model.table[i], at), starts)
    np.clip(score[:, :n_trained], -model.settings.word_bound, model.settings.word_bound, out=score[:, :n_trained])
    score += model.scripts[:, langs][most]
    score[most == 0] = 0
    return starts, ends, doc, most, at, score


def neutral_scores(starts: np.ndarray, script: np.ndarray, at: np.ndarray, label: np.ndarray, model: Model) -> np.ndarray:
    """Score of each word for its label against the neutral background; 0 without letters."""
    out = np.zeros(len(starts), np.float32)
    for i, table in enumerate(model.neutral):
        own = np.flatnonzero(label == i)
        if len(own) == len(label):
            out = np.add.reduceat(np.take(table, at), starts)
        elif len(own):
            size = np.diff(starts, append=len(at))
            inside = np.repeat(label == i, size)
            begin = np.cumsum(size[own]) - size[own]
            out[own] = np.add.reduceat(np.take(table, at[starts[0] :][inside]), begin)
    out = np.clip(out, -model.settings.word_bound, model.settings.word_bound) + model.scripts[script, label]
    return np.where(script > 0, out, 0)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word.  `first` has each document's first word, and the end.

    Documents advance together, the longest first, so that the step at word t is one array
    operation over the documents that have a word t.
    """
    n_words = np.diff(first)
    order = np.argsort(-n_words, kind="stable")
    counts = n_words[order]
    label = np.zeros(len(score), np.int16)
    if len(score) == 0:
        return label
    base, longest = first[:-1][order], int(counts[0])
    active = np.searchsorted(-counts, -np.arange(longest), "left")  # documents with more than t words
    stay = np.ones(score.shape, bool)
    best = np.zeros(len(score), np.int16)  # the best label of the word before
    v = score[base[: active[0]]].copy()
    last = [None] * longest
    for t in range(1, longest):
        k = active[t]
        if k < len(v):
            last[t - 1] = v[k:].argmax(1).astype(np.int16)
            v = v[:k]
        rows = base[:k] + t
        top = v.argmax(1)
        reach = v[np.arange(k), top] - penalty
        keep = v >= reach[:, None]
        stay[rows] = keep
        best[rows] = top
        v = np.where(keep, v, reach[:, None]) + score[rows]
    last[longest - 1] = v.argmax(1).astype(np.int16)
    now = np.zeros(0, np.int16)
    for t in range(longest - 1, -1, -1):
        if last[t] is not None:
            now = np.concatenate([now, last[t]])
        rows = base[: active[t]] + t
        label[rows] = now
        now = np.where(stay[rows, now], now, best[rows]) if t else now
    return label


def _labelled(batch: pa.RecordBatch, model: Model) -> Iterator[pa.RecordBatch]:
    column = pc.utf8_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
    data, offsets = textvec.utf8(column)
    plain, plain_offsets = textvec.utf8(batch.column(1))
    names = np.array([*model.langs, UNKNOWN])
    n_langs = len(model.langs)
    for lo, hi in textvec.chunks(offsets):
        n_docs = hi - lo
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, doc, script, trigram, score = word_scores(part, at, model)
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        label = candidates(script, model)[viterbi(score, first, model.settings.switch_penalty)]
        weight = (script > 0).astype(float)
        n_lettered = np.bincount(doc, weight, n_docs)
        gained = np.bincount(doc, neutral_scores(starts, script, trigram, label, model) if len(doc) and n_langs else np.zeros(len(doc)), n_docs)
        mean = gained / np.maximum(n_lettered, 1)
        votes = np.bincount(doc * max(1, n_langs) + label, weight, n_docs * max(1, n_langs)).reshape(n_docs, -1)
        top = np.where(n_lettered > 0, votes.argmax(1), n_langs)
        share = np.where(n_lettered > 0, votes.max(1) / np.maximum(n_lettered, 1), 0.0)
        # Spans: runs of one label within a document that has letters.
        live = n_lettered[doc] > 0
        head = live & np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])[: len(doc)]
        tail = live & np.concatenate([(doc[1:] != doc[:-1]) | (label[1:] != label[:-1]), [True]])[: len(doc)]
        own, own_at = plain[plain_offsets[lo] : plain_offsets[hi]], plain_offsets[lo : hi + 1] - plain_offsets[lo]
        if not np.array_equal(own_at, at):  # lower-casing changed a length: the words' order is the same
            starts, ends, again = textvec.word_bounds(own, own_at, ~textvec.SPACE)
        chars = textvec.char_starts(own)
        of = doc[head]
        origin = chars[own_at[of]]
        span = pa.StructArray.from_arrays(
            [pa.array(names[label[head]].tolist(), pa.string()), pa.array(chars[starts[head]] - origin), pa.array(chars[ends[tail]] - origin)], names=["lang", "start", "end"]
        )
        n_spans = np.bincount(of, minlength=n_docs)
        keep = (n_lettered > 0) & (mean >= model.settings.least_score)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0)[lo:hi].cast(pa.int64()),
                pa.array(names[top].tolist(), pa.string()),
                pa.array(share),
                pa.array(np.diff(first).astype(np.int32)),
                pa.array(mean),
                pa.array(n_spans.astype(np.int32)),
                pa.array(keep),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), span),
            ],
            names=["doc_id", "lang", "lang_share", "n_words", "mean_score", "n_spans", "keep", "spans"],
        )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): a map over partitions, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 1):
            yield from _labelled(batch, model)

    return textvec.arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, unchanged, whose text isn't rejected; filtered as they stream by."""
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, text_at):
            pair = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(text_at)], names=["doc_id", "text"])
            keep = pa.concat_arrays([x.column("keep") for x in _labelled(pair, model)]) if len(batch) else pa.array([], pa.bool_())
            yield batch.filter(keep)

    return textvec.arrow_map(docs, run, docs.schema)
