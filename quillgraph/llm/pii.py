"""Personal identifiers in plain and disguised form, with offsets into the source.

Two transducers rewrite a text and record each edit as (source start, source end, replacement):
the first folds characters (homoglyphs of Latin letters and digits, full-width and mathematical
forms, other dashes and spaces; invisible characters vanish), the second rewrites spelled digits
("five five five") and the at and dot of a disguised address ("name [at] host dot org").
Detectors run on the normalised text, and a span they find is mapped back through both lists of
edits, so that start and end count characters of the original text and cover the whole disguise.

Identifiers: email, phone, ipv4, card (13 to 19 digits, issuer's first digit, Luhn), ssn, iban
(mod 97), secret (named tokens and keys, known key formats).  Overlapping findings are settled in
the order of ``PRIORITY``, then the earlier, then the longer.

Most texts have no disguise and no identifier: regular expressions that run over the whole Arrow
column decide exactly which texts can have any, and only those are looked at one by one.

Local parts and hosts may have any number of names, and every search takes time linear in the text.

Defined cases: a null or empty text has no findings and stays as it is; texts are searched whole;
a repeated identifier is found each time, a repeated row again; an empty table gives an empty
result; a null doc_id is carried along; other columns are ignored by :func:`find` and passed
through by :func:`redacted`, which sets n_chars to the new length of each text that it changes.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textvec

SCHEMA = "doc_id bigint, kind string, start bigint, end bigint, source_text string, normalised string"
PRIORITY = ("secret", "email", "iban", "card", "ssn", "ipv4", "phone")

# --- transducer 1: characters -------------------------------------------------------------------

_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "г": "r", "п": "n", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ⅼ": "l",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "․": ".", "。": ".", "。": ".", "∙": ".", "・": ".", "‧": ".", "⸱": ".", "﹒": ".", "﹫": "@",
    "∕": "/", "⁄": "/", "＿": "_", "‚": ",", "：": ":", "∶": ":",
}


def _fold() -> dict[int, str]:
    out = {ord(a): b for a, b in _ALIKE.items()}
    out |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFE58, 0xFE63)}
    out |= {c: " " for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    out |= {c: "" for c in (0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, 0x180E)}
    out |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    wide = (range(0x1D400, 0x1D800), range(0x2460, 0x2500), range(0x2070, 0x209D), range(0x1F100, 0x1F170), (0xB2, 0xB3, 0xB9))
    for c in (c for block in wide for c in block):
        plain = unicodedata.normalize("NFKC", chr(c)).strip("()., ")
        if plain and plain.isascii() and c not in out:
            out[c] = plain
    for c in range(0x80, 0x20000):
        digit = unicodedata.decimal(chr(c), None)
        if digit is not None and c not in out:
            out[c] = str(digit)
    return out


FOLD = _fold()


def _ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


_CLASS = _ranges(FOLD)
FOLDABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _CLASS) + "]")
FOLDABLE_RE2 = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _CLASS) + "]"

# --- transducer 2: words ------------------------------------------------------------------------

DIGIT_WORDS = {
    w: str(k)
    for names in (
        "zero one two three four five six seven eight nine",
        "oh", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(names.split())
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_STEP = rf"(?:(?:double|triple)[\s-]+)?{_WORD}"
#: Three digit words at least; between them white space, hyphens or commas.
SPELLED = re.compile(rf"(?<!\w){_STEP}(?:[\s,-]+{_STEP}){{2,}}(?!\w)", re.IGNORECASE)
#: Python's white space, of which RE2's `\s` has a part; and letters that Python takes for i, s and k when it ignores case.
_SPACES_RE2 = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CASED_RE2 = r"[\x{130}\x{17F}\x{212A}]"
SPELLED_RE2 = rf"(?i)\b{_STEP}(?:[\s,-]+{_STEP}){{2}}".replace(r"[\s", f"[{_SPACES_RE2}")
_OPEN, _SHUT = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT_SURE = rf"(?:{_OPEN}(?:at|@|arroba|chez){_SHUT}|_at_|-at-|\s*@\s*)"
_AT = rf"(?:{_AT_SURE}|\s+(?:at|arroba)\s+)"
_DOT_SURE = rf"(?:{_OPEN}(?:dot|\.|punkt|point|punto){_SHUT}|\s+(?:dot|punkt|punto|\.)\s+|_dot_|-dot-)"
_DOT = rf"(?:{_DOT_SURE}|\.)"
_HOST = rf"(?:(?>[a-z0-9]+(?:-[a-z0-9]+)*?{_DOT}))+[a-z]{{2,24}}(?!\w)"
#: A disguised address; :func:`disguised` finds the same in time linear in the text's length.
DISGUISED = re.compile(rf"(?<![\w.%+])([a-z0-9%+]+(?:(?>{_DOT}|[_-])[a-z0-9%+]+)*?)({_AT})({_HOST})", re.IGNORECASE)
#: Each at, white space before it from its first character on.
AT_PART = re.compile(rf"(?:(?<!\s)\s++)?+(?:[\[({{<]\s*+(?:at|@|arroba|chez){_SHUT}|@\s*+)|_at_|-at-|(?<!\s)\s++(?:at|arroba)\s++", re.IGNORECASE)
HOST = re.compile(_HOST, re.IGNORECASE)
#: How far labels, hyphens and dots go on, whether or not they end as a host does.
HOST_RUN = re.compile(rf"(?:[a-z0-9]++(?:-[a-z0-9]++)*+(?>{_DOT})?+)*+", re.IGNORECASE)
#: The local part in reversed text.
LOCAL_BACK = re.compile(
    r"[a-z0-9%+]++(?:(?>\s*[\])}>]\s*(?:tod|\.|tknup|tniop|otnup)\s*[\[({<]\s*|\s+(?:tod|tknup|otnup|\.)\s+|_tod_|-tod-|\.|[_-])[a-z0-9%+]++)*(?![\w.%+])", re.IGNORECASE
)
DOT_PART = re.compile(_DOT, re.IGNORECASE)
DOT_SURE, AT_SURE = re.compile(_DOT_SURE, re.IGNORECASE), re.compile(_AT_SURE, re.IGNORECASE)
#: A part of every match of DISGUISED: its at, the host's first name and dot, and what begins after it.
_HINT = rf"{_AT}[a-z0-9]+(?:-[a-z0-9]+)*?{_DOT}[a-z0-9]"
DISGUISED_RE2 = f"(?i:{_HINT.replace(r'\s', f'[{_SPACES_RE2}]')})|{_CASED_RE2}"
HINT = re.compile(_HINT, re.IGNORECASE)

Edit = tuple[int, int, str]


class Offsets:
    """Maps spans of an edited text back to the text before the edits."""

    def __init__(self, edits: list[Edit]):
        self.src, self.out, self.spans, shift = [], [], [], 0
        for a, b, new in edits:
            self.spans.append((a + shift, a + shift + len(new), a, b))
            shift += len(new) - (b - a)
        self.starts = [s[0] for s in self.spans]

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._edge(start, True), self._edge(end, False)

    def _edge(self, at: int, is_start: bool) -> int:
        """Source position of an edge; within a replacement it's that of the whole edit."""
        # The last edit that begins before the edge, or for a start at the edge.
        k = bisect_right(self.starts, at if is_start else at - 1) - 1
        if k < 0:
            return at
        lo, hi, a, b = self.spans[k]
        if is_start:
            return a if lo <= at < hi else b + (at - hi)
        return b if lo < at <= hi else b + (at - hi)


def applied(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for a, b, new in edits:
        out += (text[at:a], new)
        at = b
    return "".join([*out, text[at:]])


def fold_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), FOLD[ord(m[0])]) for m in FOLDABLE.finditer(text)]


def spelled(run: str) -> str:
    out, times = [], 1
    for w in re.split(r"[\s,-]+", run.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out.append(DIGIT_WORDS[w] * times)
            times = 1
    return "".join(out)


def disguised(text: str) -> list[tuple[int, int, int, int]]:
    """(start, start of its at, end of its at, end) of each disguised address.

    From each at the host is read forwards and the local part backwards.  An at within a run of
    labels that ended as no host does can't have a host either, so no run is read twice.
    """
    out, back, floor, dead = [], text[::-1], 0, 0
    for m in AT_PART.finditer(text):
        if m.start() < floor or m.end() <= dead:
            continue
        host = HOST.match(text, m.end())
        if not host:
            dead = HOST_RUN.match(text, m.end()).end()
            continue
        local = LOCAL_BACK.match(back, len(text) - m.start(), len(text) - floor)
        if local:
            floor = host.end()
            out.append((len(text) - local.end(), m.start(), m.end(), floor))
    return out


def word_edits(text: str) -> list[Edit]:
    edits = [(m.start(), m.end(), spelled(m[0])) for m in SPELLED.finditer(text)]
    for a, b, c, d in disguised(text):
        local, at, host = text[a:b], text[b:c], text[c:d]
        if not AT_SURE.fullmatch(at) and not DOT_SURE.search(host) and not re.search(r"[\d._]", local):
            continue  # "look at example.org" is a sentence
        own = [(x.start() + c, x.end() + c, ".") for x in DOT_PART.finditer(host)]
        own += [(x.start() + a, x.end() + a, ".") for x in DOT_PART.finditer(local)]
        own.append((b, c, "@"))
        edits += [e for e in own if text[e[0] : e[1]] != e[2]]
    edits.sort()
    out: list[Edit] = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


# --- detectors ----------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL_LOCAL = re.compile(r"[\w%+-]++(?:\.[\w%+-]++)*+")  # reads the same backwards
EMAIL_HOST = re.compile(r"(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)+[A-Za-z]{2,24}")
IPV4 = re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d)(?!\.\d)", re.ASCII)
CARD = re.compile(r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)", re.ASCII)
SSN = re.compile(r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])", re.ASCII)
PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:\d[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\w])(?!\.\d)",
    re.ASCII,
)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAMED_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key)\b\W{1,8}([A-Za-z0-9_/+=-]{16,})")
SECRET = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
DIGITS = re.compile(r"(?<!\d)\d{7,15}(?!\d)", re.ASCII)
TRIGGER_RE2 = (
    r"@|[0-9][ .()/-]{0,2}[0-9][ .()/-]{0,2}[0-9][ .()/-]{0,2}[0-9][ .()/-]{0,2}[0-9][ .()/-]{0,2}[0-9][ .()/-]{0,2}[0-9]|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"
    r"|(?i:token|secret|passw|api[_-]?key|access[_-]?key)|AKIA|gh[pousr]_|sk-|xox[abprs]-|-----BEGIN|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _plain(m: re.Match) -> str:
    return re.sub(r"\D", "", m[0])


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of plain addresses: from each @ the host forwards and the local part backwards."""
    out, back, floor, at = [], text[::-1], 0, text.find("@")
    while at >= 0:
        host = EMAIL_HOST.match(text, at + 1)
        local = EMAIL_LOCAL.match(back, len(text) - at, len(text) - floor) if host else None
        if local:
            start = len(text) - local.end()
            if start == floor > 0 and (text[floor - 1].isalnum() or text[floor - 1] in "_%+-"):
                start = text.find(".", start, at) + 1  # the first name is the end of the address before
            if start:
                out.append((start, host.end()))
                floor = host.end()
            elif not floor:
                out.append((0, host.end()))
                floor = host.end()
        at = text.find("@", at + 1)
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of named secrets and known key formats; a private key goes on to its end mark."""
    out = [m.span(1) for m in NAMED_SECRET.finditer(text) if re.search(r"\d", m[1])]
    ends, k, at = [m.end() for m in KEY_END.finditer(text)] if "-----END" in text else [], 0, 0
    for m in SECRET.finditer(text):
        if m.start() < at:
            continue
        at = m.end()
        if m[0].startswith("-"):
            while k < len(ends) and ends[k] <= m.end():
                k += 1
            at = ends[k] if k < len(ends) else at
        out.append((m.start(), at))
    return out


def settled(kinds: Iterable[tuple[str, list[tuple[int, int]]]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of an earlier kind, nor one of their own that begins before or is longer."""
    taken: list[tuple[int, int, str]] = []
    for kind, spans in kinds:
        k, end, new = 0, 0, []
        for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a >= end and (k == len(taken) or b <= taken[k][0]):
                new.append((a, b, kind))
                end = b
        taken = sorted(taken + new)
    return [(kind, a, b) for a, b, kind in taken]


def detect(text: str, edited: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers in normalised text; `edited`: spans that were spelled digits."""
    phones = [m.span() for m in PHONE.finditer(text) if 7 <= len(_plain(m)) <= 15]
    if edited:  # a bare number is a phone number only where it was spelled out
        first = [a for a, _ in edited]
        for m in DIGITS.finditer(text):
            k = bisect_right(first, m.end() - 1) - 1
            if k >= 0 and m.start() < edited[k][1]:
                phones.append(m.span())
    return settled(
        zip(
            PRIORITY,
            (
                secrets(text),
                emails(text),
                [m.span() for m in IBAN.finditer(text) if _iban_ok(m[0].replace(" ", ""))],
                [m.span() for m in CARD.finditer(text) if m[0][0] in "23456" and luhn(x := _plain(m)) and len(set(x)) > 1],
                [m.span() for m in SSN.finditer(text)],
                [m.span() for m in IPV4.finditer(text)],
                phones,
            ),
            strict=True,
        )
    )


def _iban_ok(x: str) -> bool:
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised) with offsets into `text` itself."""
    if not text:
        return []
    folds = [] if text.isascii() else fold_edits(text)
    folded = applied(text, folds) if folds else text
    words = word_edits(folded)
    plain = applied(folded, words) if words else folded
    outer, inner = Offsets(folds), Offsets(words)
    digits = [s[:2] for s, e in zip(inner.spans, words, strict=True) if e[2].isdigit()]
    return [(kind, *outer.back(*inner.back(a, b)), plain[a:b]) for kind, a, b in detect(plain, digits)]


def suspects(texts: pa.Array) -> list[int]:
    """Places of the texts that can have a finding."""
    flags = None
    for pattern in (TRIGGER_RE2, FOLDABLE_RE2, DISGUISED_RE2, SPELLED_RE2):
        hit = pc.match_substring_regex(texts, pattern)
        flags = hit if flags is None else pc.or_(flags, hit)
    return pc.indices_nonzero(flags.fill_null(False)).to_pylist()


def find(docs: DataFrame) -> DataFrame:
    """One row for each identifier in `docs` (doc_id, text): a map over partitions, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 1):
            texts, rows = batch.column(1), []
            ids = batch.column(0)
            for i in suspects(texts):
                text = texts[i].as_py()
                rows += [(ids[i].as_py(), kind, a, b, text[a:b], norm) for kind, a, b, norm in scan(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "kind", "start", "end", "source_text", "normalised"])

    return textvec.arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


def masked(text: str) -> str:
    return applied(text, [(a, b, f"[{kind.upper()}]") for kind, a, b, _ in scan(text)])


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each finding in `text` replaced by its kind in brackets."""
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, text_at):
            texts = batch.column(text_at)
            changed = {i: new for i in suspects(texts) if (new := masked(old := texts[i].as_py())) != old}
            if changed:
                new = texts.to_pylist()
                for i, text in changed.items():
                    new[i] = text
                batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(new, texts.type))
                if chars_at is not None:
                    n = batch.column(chars_at).to_pylist()
                    for i, text in changed.items():
                        n[i] = len(text)
                    batch = batch.set_column(chars_at, batch.schema.field(chars_at), pa.array(n, batch.column(chars_at).type))
            yield batch

    return textvec.arrow_map(docs, run, docs.schema)
