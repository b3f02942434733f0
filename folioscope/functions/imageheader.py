"""Size and channel mode of images from their headers; no pixel is decoded."""

from __future__ import annotations

import struct

UNKNOWN = "cannot identify image file"


class TooShort(Exception):
    """The header goes on beyond the bytes at hand."""


def _at(data: bytes, form: str, at: int) -> tuple:
    part = data[at : at + struct.calcsize(form)]
    if len(part) < struct.calcsize(form):
        raise TooShort
    return struct.unpack(form, part)


def _png(data: bytes) -> tuple[int, int, str]:
    length, kind, width, height, bits, colour = _at(data, ">I4sIIBB", 8)
    if kind != b"IHDR" or length != 13:
        raise ValueError(UNKNOWN)
    grey = {1: "1", 16: "I;16"}.get(bits, "L")
    return width, height, {0: grey, 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]


def _bmp(data: bytes) -> tuple[int, int, str]:
    (size,) = _at(data, "<I", 14)
    width, height, _, bits = _at(data, "<HHHH", 18) if size == 12 else _at(data, "<iiHH", 18)
    return width, abs(height), {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}[bits]


def _gif(data: bytes) -> tuple[int, int, str]:
    return (*_at(data, "<HH", 6), "P")


def _jpeg(data: bytes) -> tuple[int, int, str]:
    at = 2
    while True:
        mark, kind = _at(data, "BB", at)
        if mark != 0xFF:
            raise ValueError(UNKNOWN)
        if kind == 0xFF:  # fill byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a length
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # start of frame
            _, _, height, width, parts = _at(data, ">HBHHB", at + 2)
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}[parts]
        elif kind in (0xD9, 0xDA):
            raise ValueError(UNKNOWN)
        else:
            at += 2 + _at(data, ">H", at + 2)[0]


def _tiff(data: bytes) -> tuple[int, int, str]:
    order = "<" if data[:2] == b"II" else ">"
    (start,) = _at(data, f"{order}I", 4)
    (count,) = _at(data, f"{order}H", start)
    tags = {}
    for i in range(count):
        tag, kind, n = _at(data, f"{order}HHI", start + 2 + 12 * i)
        if kind in (3, 4) and n:
            size, form = (2, "H") if kind == 3 else (4, "I")
            at = start + 10 + 12 * i if n * size <= 4 else _at(data, f"{order}I", start + 10 + 12 * i)[0]
            if tag in (256, 257, 258, 262, 277):
                (tags[tag],) = _at(data, f"{order}{form}", at)
    bits, photo, parts = tags.get(258, 1), tags.get(262, 1), tags.get(277, 1)
    if parts == 1:
        mode = "P" if photo == 3 else {1: "1", 16: "I;16"}.get(bits, "L")
    else:
        mode = {2: "LA", 3: "RGB", 4: "CMYK" if photo == 5 else "RGBA"}[parts]
    return tags[256], tags[257], mode


_READERS = (
    (b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"\xff\xd8", _jpeg), (b"II*\x00", _tiff), (b"MM\x00*", _tiff),
)


def image_header(data: bytes) -> tuple[int, int, str]:
    """(width, height, mode) of a PNG, BMP, GIF, JPEG or TIFF file; TooShort where the header goes on, ValueError for other bytes.

    ``data`` is the bytes, or a view of a file that can be cut like bytes.
    """
    for magic, read in _READERS:
        if data.startswith(magic):
            try:
                width, height, mode = read(data)
            except KeyError:
                raise ValueError(UNKNOWN) from None
            if width <= 0 or height <= 0:
                raise ValueError(UNKNOWN)
            return width, height, mode
    raise ValueError(UNKNOWN)
