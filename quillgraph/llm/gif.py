"""GIF columns: animations decoded to timed frames with colour histograms.

A file's blocks are read in order: the logical screen and palettes, graphic control blocks (delay,
disposal, transparent colour), and images, whose LZW code streams are decoded to colour numbers.
Each image is drawn on the screen as it was left by the disposal of the one before: kept, its area
cleared, or what was there before it restored.  A transparent or missing pixel leaves the screen as
it is.  Cleared and never drawn pixels are transparent.

One row a frame: its time, the whole screen as RGBA bytes, and a histogram of its opaque pixels
over 4 x 4 x 4 cubes of red, green and blue (red most significant).  A screen of more than
``band_pixels`` pixels is decoded in bands of whole rows, the file once for each, and has a row for
each frame and band; histogram and transparent pixels are then the band's.  Frames are returned as they
are drawn, so that memory holds one band of the screen however many frames and pixels a file has.

Defined cases: a null gives one row without frame and the error ``null``; bytes that aren't a GIF,
or have no image, one row without frame and the error; a file that breaks off or has an undecodable
image gives the frames before it, then a row without frame and the error; an image's surplus
pixels are dropped and those outside the screen not drawn; a screen without pixels has frames of no
bytes; repeated rows give their rows again; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec

SCHEMA = (
    "{key} bigint, frame int, start_ms bigint, delay_ms int, width int, height int, image_left int, image_top int, image_width int, image_height int,"
    " disposal int, interlaced boolean, loops int, band int, band_top int, band_height int, rgba binary, histogram array<int>, n_transparent int, error string"
)
BAND_PIXELS = 1 << 22
#: Codes that are decoded together once the table is full.
LATER = 512


class GifError(ValueError):
    pass


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    interlaced: bool
    screen: np.ndarray  # height x width x 4, of the band's rows


@lru_cache(maxsize=16)
def code_widths(least: int) -> np.ndarray:
    """Bits of the i-th code after a clear code, for the first 4096; all further ones have 12."""
    return np.minimum(12, np.maximum(least + 1, np.floor(np.log2((1 << least) + 1 + np.arange(4096))).astype(np.int64) + 1))


def lzw_runs(data: bytes, least: int, most: int) -> Iterator[bytes]:
    """Colour numbers of a code stream, at most `most`, piece by piece; `least` is the code size of the image.

    Without a loop over codes: the widths of all codes up to the next clear code are known, so that
    these are cut from the stream together.  The entry that is made after the k-th code is what the
    code stands for and the pixel after it, so an entry's pixels are those that begin at the k-th
    code's place; each pixel points to an earlier one, and doubling these steps finds the literal.
    """
    if not 1 <= least <= 8:
        raise GifError("bad code size")
    clear, stop, width = 1 << least, (1 << least) + 1, code_widths(least)
    padded = np.frombuffer(data + bytes(4), np.uint8)
    at, since = 0, 0
    seen = seen_at = seen_size = None  # pixels, places and sizes of the codes that filled the table
    while most > 0:
        if since == 0:
            first = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (2 * clear - 1)
            if first == clear and at + least < 8 * len(data):
                at += least + 1
                continue
        bits = width[: (8 * len(data) - at) // (least + 1)] if since == 0 else np.full(LATER, 12)
        end = at + np.cumsum(bits)
        n = int(np.searchsorted(end, 8 * len(data), "right"))
        if n == 0:
            return
        start = end[:n] - bits[:n]
        byte = start >> 3
        code = padded[byte].astype(np.int64) | padded[byte + 1].astype(np.int64) << 8 | padded[byte + 2].astype(np.int64) << 16
        code = code >> (start & 7) & ((1 << bits[:n]) - 1)
        special = np.flatnonzero((code == clear) | (code == stop))
        upto = int(special[0]) if len(special) else n
        c = code[:upto]
        literal = c < clear
        entry = np.where(literal, 0, c - stop - 1)
        bad = False
        if since == 0:
            wrong = np.flatnonzero(~literal & (entry >= np.arange(upto)))
            if bad := len(wrong) > 0:
                c, literal, entry = (x[: wrong[0]] for x in (c, literal, entry))
            # An entry is one pixel longer than its code, which may be an entry itself.
            size, step = np.append(np.ones(len(c), np.int64), 0), np.append(np.where(literal, len(c), entry), len(c))
            while (step[:-1] < len(c)).any():
                size += size[step]
                step = step[step]
            size = size[:-1]
        else:
            size = np.where(literal, 1, seen_size[entry] + 1)
        ends = np.cumsum(size)
        place = ends - size
        total = int(ends[-1]) if len(c) else 0
        origin = place if since == 0 else seen_at
        shift = np.where(literal, 0, origin[entry] - place) if len(c) else size
        source = np.repeat(shift, size) + np.arange(total)
        if since == 0:
            pixels = np.zeros(total, np.uint8)
            pixels[place[literal]] = c[literal]
            while len(source):
                further = source[source]
                if (further == source).all():
                    break
                source = further
            pixels = pixels[source]
            seen, seen_at, seen_size = pixels, place, size
        else:
            pixels = seen[np.minimum(source, len(seen) - 1)]
            pixels[place[literal]] = c[literal]
        yield pixels[:most].tobytes()
        most -= total
        if most <= 0:
            return
        if bad:
            raise GifError("bad code")
        if upto < n:
            if code[upto] == stop:
                return
            since, at = 0, int(end[upto])
        else:
            since, at = since + n, int(end[n - 1])


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    return b"".join(lzw_runs(data, least, most))


def lzw_encode(pixels: bytes, least: int) -> bytes:
    """A code stream for colour numbers below 2**least."""
    clear, stop = 1 << least, (1 << least) + 1
    codes, width, table = [clear], [np.array([least + 1])], {}
    code, following, begun = -1, stop + 1, 1
    for pixel in pixels:
        if code < 0:
            code = pixel
            continue
        known = table.get(key := code << 8 | pixel)
        if known is not None:
            code = known
            continue
        codes.append(code)
        table[key] = following
        following += 1
        code = pixel
        if following > 4095:
            codes.append(clear)
            width.append(code_widths(least)[: len(codes) - begun])
            table, following, begun = {}, stop + 1, len(codes)
    if code >= 0:
        codes.append(code)
    codes.append(stop)
    width.append(code_widths(least)[: len(codes) - begun])
    bits = np.concatenate(width)
    place = np.arange(12)
    cells = (np.array(codes)[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(cells[place < bits[:, None]], bitorder="little").tobytes()


def interlaced_rows(height: int) -> np.ndarray:
    """Screen row of each stored row of an interlaced image."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise GifError("breaks off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def short(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def blocks(self) -> bytes:
        out = []
        while n := self.byte():
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        return np.frombuffer(self.take(3 * n), np.uint8).reshape(n, 3)


    def skip_blocks(self) -> None:
        while n := self.byte():
            self.take(n)


def outline(data: bytes) -> tuple[int | None, int | None, int]:
    """(width, height, loops) from the file's blocks, as far as they can be read; no image is decoded."""
    width = height = None
    loops = 1
    try:
        r = Reader(data)
        if r.take(6) not in (b"GIF87a", b"GIF89a"):
            raise GifError("not a GIF")
        width, height, flags = r.short(), r.short(), r.byte()
        r.take(2)
        r.palette(flags)
        while (kind := r.byte()) in (0x21, 0x2C):
            if kind == 0x2C:
                r.take(8)
                r.palette(r.byte())
                r.byte()
                r.skip_blocks()
            elif r.byte() == 0xFF:
                body = r.blocks()
                if body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    loops = int.from_bytes(body[12:14], "little")
            else:
                r.skip_blocks()
    except GifError:
        pass
    return width, height, loops


def band_of_image(codes: bytes, least: int, w: int, h: int, interlaced: bool, first: int, last: int, most: int, clear: int | None) -> np.ndarray:
    """Colour numbers of the image's rows `first` up to `last`, -1 where the stream has none.

    A number from `most` on that isn't `clear` is an error, whichever row has it.
    """
    out = np.full((max(0, last - first), w), -1, np.int16)
    order = interlaced_rows(h) if interlaced else np.arange(h)
    row, rest = 0, b""
    for run in lzw_runs(codes, least, w * h):
        rest = rest + run if rest else run
        n = len(rest) // w if w else 0
        whole = np.frombuffer(rest, np.uint8, n * w).reshape(n, w)
        at = order[row : row + n]
        inside = (at >= first) & (at < last)
        out[at[inside] - first] = whole[inside]
        if len(whole) and whole.max() >= most and (whole[whole >= most] != clear).any():
            raise GifError("colour outside the palette")
        row, rest = row + n, rest[n * w :]
    if rest and row < h and first <= order[row] < last:
        out[order[row] - first, : len(rest)] = np.frombuffer(rest, np.uint8)
    if any(c >= most and c != clear for c in rest):
        raise GifError("colour outside the palette")
    return out


def replay(data: bytes, top: int = 0, bottom: int = 1 << 16) -> Iterator[Frame]:
    """The frames, rows `top` up to `bottom` of the screen, each as soon as it's drawn; raises at the error if there is one."""
    r = Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    width, height, flags = r.short(), r.short(), r.byte()
    r.take(2)
    bottom = min(bottom, height)
    shared = r.palette(flags)
    screen = np.zeros((max(0, bottom - top), width, 4), np.uint8)
    control, clock, found = (0, 0, None), 0, False
    while True:
        kind = r.byte()
        if kind == 0x3B:
            break
        if kind == 0x21:
            label, body = r.byte(), r.blocks()
            if label == 0xF9 and len(body) >= 4:
                control = ((body[0] >> 2) & 7, 10 * int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None)
            continue
        if kind != 0x2C:
            raise GifError("unknown block")
        left, above, w, h, flags = r.short(), r.short(), r.short(), r.short(), r.byte()
        palette = r.palette(flags)
        palette = shared if palette is None else palette
        if palette is None:
            raise GifError("no palette")
        least = r.byte()
        disposal, delay, clear = control
        control = (0, 0, None)
        first, last = min(h, max(0, top - above)), min(h, max(0, bottom - above))
        image = band_of_image(r.blocks(), least, w, h, bool(flags & 0x40), first, last, len(palette), clear)[:, : max(0, width - left)]
        held = screen.copy() if disposal == 3 else None
        drawn = image >= 0
        if clear is not None:
            drawn &= image != clear
        colour = image[drawn]
        area = screen[above + first - top :][: image.shape[0], left : left + image.shape[1]] if image.shape[0] else screen[:0, left : left + image.shape[1]]
        area[drawn, :3] = palette[colour]
        area[drawn, 3] = 255
        found = True
        yield Frame(clock, delay, left, above, w, h, disposal, bool(flags & 0x40), screen)
        clock += delay
        if disposal == 2:
            area[:] = 0
        elif held is not None:
            screen = held
    if not found:
        raise GifError("no image")


def decode(data: bytes) -> tuple[list[Frame], int, tuple[int, int], str | None]:
    """(frames, loops, screen size, error): all frames up to the error, if there is one, with whole screens."""
    width, height, loops = outline(data)
    out: list[Frame] = []
    try:
        for frame in replay(data):
            out.append(replace(frame, screen=frame.screen.copy()))
    except GifError as e:
        return out, loops, (width or 0, height or 0), str(e)
    return out, loops, (width, height), None


def histogram(screen: np.ndarray) -> np.ndarray:
    opaque = screen[screen[..., 3] > 0].astype(np.int64) >> 6
    return np.bincount(opaque[:, 0] * 16 + opaque[:, 1] * 4 + opaque[:, 2], minlength=64)


def rows_of(owner, data: bytes | None, band_pixels: int) -> Iterator[tuple]:
    """The rows of one file."""
    nothing = (None,) * 10
    if data is None:
        yield (owner, None, None, None, None, None, *nothing[:7], *nothing[:6], "null")
        return
    width, height, loops = outline(data)
    rows = max(1, band_pixels // max(1, width or 0))
    for band, top in enumerate(range(0, max(1, height or 0), rows)):
        try:
            for k, f in enumerate(replay(data, top, top + rows)):
                counts = histogram(f.screen)
                n = f.screen.shape[0] * f.screen.shape[1]
                where = (f.start_ms, f.delay_ms, width, height, f.left, f.top, f.width, f.height, f.disposal, f.interlaced, loops, band, top, f.screen.shape[0])
                yield (owner, k, *where, f.screen.tobytes(), counts.tolist(), int(n - counts.sum()), None)
        except GifError as e:
            if band == 0:  # it's the same in each
                yield (owner, None, None, None, width, height, *nothing[:6], loops if width is not None else None, *nothing[:6], str(e))


def frames(media: DataFrame, key: str = "page_id", column: str = "gif", band_pixels: int = BAND_PIXELS) -> DataFrame:
    """One row for each frame (and band) of each GIF of `media`, in order; a map over partitions."""
    schema = SCHEMA.format(key=f"`{key}`")
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 8, pa.bool_(), *[pa.int32()] * 4, pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.string()]
    names = [key, *[x.split()[0] for x in SCHEMA.split(", ")[1:]]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in textvec.pieces(batches, 1):
            rows, held = [], 0
            for owner, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows_of(owner.as_py(), data.as_py(), band_pixels):
                    rows.append(row)
                    held += len(row[-4] or b"")
                    if held > 4 << 20:  # frames are larger than files: return them as they come
                        yield packed(rows)
                        rows, held = [], 0
            yield packed(rows)

    return textvec.arrow_map(media.select(key, column), run, schema)


# --- encoding -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Image:
    """An image to encode: colour numbers by row, and how it's shown."""

    pixels: np.ndarray  # height x width
    left: int = 0
    top: int = 0
    delay_ms: int = 100
    disposal: int = 1
    transparent: int | None = None
    interlaced: bool = False
    palette: bytes | None = None


def encode(width: int, height: int, palette: bytes, images: Iterable[Image], loops: int = 0) -> bytes:
    """A GIF89a file; a palette has 3 bytes for each of 2, 4, ... 256 colours."""

    def flag(p: bytes) -> int:
        return (len(p) // 3).bit_length() - 2

    def short(n: int) -> bytes:
        return n.to_bytes(2, "little")

    out = bytearray(b"GIF89a" + short(width) + short(height) + bytes([0x80 | flag(palette), 0, 0]) + palette)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + short(loops) + b"\x00"
    for x in images:
        h, w = x.pixels.shape
        own = x.palette or b""
        out += b"\x21\xf9\x04" + bytes([x.disposal << 2 | (x.transparent is not None)]) + short(x.delay_ms // 10) + bytes([x.transparent or 0, 0])
        out += b"\x2c" + short(x.left) + short(x.top) + short(w) + short(h) + bytes([(0x80 | flag(own) if own else 0) | 0x40 * x.interlaced])
        out += own
        least = max(2, flag(own or palette) + 1)
        rows = x.pixels[interlaced_rows(h)] if x.interlaced else x.pixels
        codes = lzw_encode(rows.astype(np.uint8).tobytes(), least)
        out.append(least)
        for k in range(0, len(codes), 255):
            block = codes[k : k + 255]
            out += bytes([len(block)]) + block
        out.append(0)
    return bytes(out + b"\x3b")


#: A colour for each byte value, and the same in another order.
PALETTE = bytes(c for k in range(256) for c in (k & 0xE0, k << 3 & 0xE0, k << 6 & 0xC0))
WIDTH, FRAMES = 32, 4


def page_animation(page_id: int, html: bytes) -> bytes:
    """A stand-in for a page's media, in which every four bytes of its markup make a pixel, their sum being its colour number.

    Each frame shows its quarter of the markup, so that images and code streams grow with it, in
    sub-images, local palettes, interlacing, transparency (colour 0, which fills the last row) and
    each disposal.
    """
    data, images = np.frombuffer(html + bytes(-len(html) % 4), np.uint8).reshape(-1, 4).sum(1, dtype=np.uint8), []
    for k in range(FRAMES):
        part = data[len(data) * k // FRAMES : len(data) * (k + 1) // FRAMES]
        left, top = (0, 0) if k == 0 else ((page_id + 3 * k) % (WIDTH // 2), (page_id + 5 * k) % 8)
        w = WIDTH - left
        pixels = np.zeros((max(1, -(-len(part) // w)), w), np.uint8)
        pixels.ravel()[: len(part)] = part
        images.append(Image(pixels, left, top, 40 + 10 * (page_id % 7) + 10 * k, (1, 2, 3, 0)[k], 0 if k else None, (page_id + k) % 3 == 0, PALETTE[::-1] if k == 2 else None))
    return encode(WIDTH, max(x.top + len(x.pixels) for x in images), PALETTE, images)


def page_media(pages: DataFrame) -> DataFrame:
    """(page_id, gif): the test tables have no media, so each page gets :func:`page_animation`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.pieces(batches, 1):
            made = [None if h is None else page_animation(int(p or 0), h.encode()) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.binary())], names=["page_id", "gif"])

    return textvec.arrow_map(pages.select("page_id", "html"), run, "page_id bigint, gif binary")
