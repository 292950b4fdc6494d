"""Width and height from the head of an image file, without decoding it: PNG, GIF, JPEG and WebP.

Sizes at fixed places are read by built-in functions. In a JPEG they stand in its frame segment, behind any number of others, so its segments are walked in batches of Arrow rows; the walk hops from segment to segment.
Cut, damaged and unknown files give null, as do null and empty ones and WebP's lossy form, which isn't read; nothing is raised for any bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SIZE = StructType([StructField("width", LongType()), StructField("height", LongType())])
#: A frame segment's marker is one of C0 to CF but for these, which hold tables.
TABLES = (0xC4, 0xC8, 0xCC)


def frame_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG's first frame segment; bytes between segments and filling ones are passed over."""
    at = 2
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 9 >= len(data):
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:  # markers that stand alone
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in TABLES:
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            if length < 2:
                return None
            at += 2 + length


@F.pandas_udf(SIZE)
def _jpeg(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(frame_size(bytes(d)) if d is not None else None) or (None, None) for d in data], columns=["width", "height"], dtype="Int64")


def _number(data: Column, start: int, size: int, little: bool = False) -> Column:
    """A whole number in `size` bytes from place `start`, counted from 0."""
    places = range(start + size - 1, start - 1, -1) if little else range(start, start + size)
    return F.conv(F.concat(*(F.hex(F.substring(data, p + 1, 1)) for p in places)), 16, 10).cast("long")


def kind(data: Column) -> Column:
    """png, gif, jpeg, webp, or null."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(head.rlike("^474946383[79]61"), "gif").when(F.startswith(head, F.lit("FFD8")), "jpeg").when(head.rlike("^52494646.{8}57454250$"), "webp")


def dimensions(data: Column) -> Column:
    """Struct of width and height; null if the file doesn't tell. Only JPEGs leave the JVM."""
    n, what = F.octet_length(data), kind(data)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    form = F.hex(F.substring(data, 13, 4))
    bits = _number(data, 21, 4, little=True)
    walked = _jpeg(F.when(what == "jpeg", data))
    found = (
        F.when((what == "png") & (n >= 24), size(_number(data, 16, 4), _number(data, 20, 4)))
        .when((what == "gif") & (n >= 10), size(_number(data, 6, 2, little=True), _number(data, 8, 2, little=True)))
        .when((what == "webp") & (n >= 30) & (form == "56503858"), size(_number(data, 24, 3, little=True) + 1, _number(data, 27, 3, little=True) + 1))
        .when((what == "webp") & (n >= 30) & (form == "5650384C"), size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1))
        .when(what == "jpeg", walked)
    )
    return F.when(found.width.isNotNull(), found)
