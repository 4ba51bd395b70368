"""Sizes of images and page counts of PDF files, read from their first bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of the formats, as hexadecimal digits.
PNG, BMP, JPEG = "89504E470D0A1A0A", "424D", "FFD8"
RIFF, WEBP, VP8, VP8L, VP8X = "52494646", "57454250", "56503820", "5650384C", "56503858"
#: A JPEG header of more segments than this counts as damaged.
JPEG_SEGMENTS = 1000


def _part(content: Column, start: Column | int, size: int) -> Column:
    """Hexadecimal digits of ``size`` bytes from ``start``, counted from 1."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.hex(F.substr(content, start, F.lit(size)))


def _big(content: Column, start: Column | int, size: int) -> Column:
    """A number whose first byte counts most; null behind the end."""
    digits = _part(content, start, size)
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))


def _little(content: Column, start: int, size: int) -> Column:
    total = _big(content, start, 1)
    for k in range(1, size):
        total = total + F.shiftleft(_big(content, start + k, 1), 8 * k)
    return total


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _signed(number: Column) -> Column:
    return F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number)


def _jpeg(content: Column) -> Column:
    """Goes from segment to segment up to the frame header."""
    none = F.lit(None).cast("long")

    def state(at: Column, width: Column = none, height: Column = none, done: bool = False) -> Column:
        return F.struct(at.cast("long").alias("at"), width.cast("long").alias("width"), height.cast("long").alias("height"), F.lit(done).alias("done"))

    def step(s: Column, _: Column) -> Column:
        at, code = s["at"], _big(content, s["at"] + 1, 1)
        frame = code.between(0xC0, 0xCF) & ~code.isin(0xC4, 0xC8, 0xCC)
        return (
            F.when(s["done"], s)
            .when(F.coalesce(_big(content, at, 1) != 0xFF, F.lit(True)) | code.isNull() | code.isin(0xD9, 0xDA), state(at, done=True))
            .when(code == 0xFF, state(at + 1))
            .when(code.between(0xD0, 0xD8) | (code == 1), state(at + 2))
            .when(frame, state(at, _big(content, at + 7, 2), _big(content, at + 5, 2), done=True))
            .otherwise(state(at + 2 + F.coalesce(_big(content, at + 2, 2), F.lit(0)))))

    turns = F.sequence(F.lit(1), F.least(F.lit(JPEG_SEGMENTS), F.length(content) + 1))
    return F.aggregate(turns, state(F.lit(3)), step, lambda s: _size(s["width"], s["height"]))


def image_size(content: Column) -> Column:
    """``width, height`` of a PNG, BMP, JPEG or WebP image; null for anything else or a broken header."""
    starts = lambda mark, at=1: _part(content, at, len(mark) // 2) == mark
    bmp_core = _little(content, 15, 4) == 12
    bits = [_big(content, 22 + k, 1) for k in range(4)]
    lossless = _size(
        1 + F.shiftleft(bits[1].bitwiseAND(F.lit(0x3F)), 8) + bits[0],
        1 + F.shiftleft(bits[3].bitwiseAND(F.lit(0x0F)), 10) + F.shiftleft(bits[2], 2) + F.shiftright(bits[1], 6))
    size = (
        F.when(starts(PNG), _size(_big(content, 17, 4), _big(content, 21, 4)))
        .when(starts(BMP) & bmp_core, _size(_little(content, 19, 2), _little(content, 21, 2)))
        .when(starts(BMP), _size(_signed(_little(content, 19, 4)), F.abs(_signed(_little(content, 23, 4)))))
        .when(starts(JPEG), _jpeg(content))
        .when(starts(RIFF) & starts(WEBP, 9) & starts(VP8X, 13), _size(1 + _little(content, 25, 3), 1 + _little(content, 28, 3)))
        .when(starts(RIFF) & starts(WEBP, 9) & starts(VP8L, 13), lossless)
        .when(starts(RIFF) & starts(WEBP, 9) & starts(VP8, 13), _size(
            _little(content, 27, 2).bitwiseAND(F.lit(0x3FFF)), _little(content, 29, 2).bitwiseAND(F.lit(0x3FFF)))))
    return F.when(size["width"].isNotNull() & size["height"].isNotNull(), size)


def is_pdf(content: Column) -> Column:
    """Whether the mark of a PDF file stands in the first kilobyte."""
    return F.coalesce(F.contains(F.decode(F.substr(content, F.lit(1), F.lit(1024)), "ISO-8859-1"), F.lit("%PDF-")), F.lit(False))


def pdf_pages(content: Column) -> Column:
    """Page objects of a PDF file; null if it keeps objects in compressed streams, where none can be seen."""
    latin = F.decode(content, "ISO-8859-1")
    seen = F.regexp_count(latin, F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return F.when((seen > 0) | ~F.contains(latin, F.lit("/ObjStm")), seen)
