"""Sizes from the heads of image files: each format, every way to cut one, and random bytes."""

import random
import struct

from pyspark.sql import functions as F

from tidewire.functions import images


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0\0\0"


def jpeg(w, h, *segments, frame=0xC0):
    inside = b"".join(b"\xff" + bytes([k]) + struct.pack(">H", len(body) + 2) + body for k, body in segments)
    return b"\xff\xd8" + inside + b"\xff" + bytes([frame]) + struct.pack(">HBHH", 17, 8, h, w) + b"\x03" + bytes(9)


def webp(form, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + form + struct.pack("<I", len(body)) + body


FILES = {
    png(640, 480): (640, 480), gif(300, 65535): (300, 65535), jpeg(800, 600): (800, 600), jpeg(1, 2, (0xE0, b"JFIF\0"), (0xE1, b"\xff\xc0" * 30000), (0xC4, b"x" * 20), frame=0xC2): (1, 2),
    b"\xff\xd8\xff\xd0\x00\x00\xff\xff" + jpeg(7, 9)[2:]: (7, 9), webp(b"VP8X", b"\x10\0\0\0" + (1919).to_bytes(3, "little") + (1079).to_bytes(3, "little") + b"more"): (1920, 1080),
    webp(b"VP8L", b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little") + bytes(10)): (100, 50), webp(b"VP8 ", bytes(30)): None, b"": None, b"BM" + bytes(60): None, b"\xff\xd8\xff\xe0\x00\x01" + bytes(20): None, b"\xff\xd8" + bytes(5_000_000): None,
}


def read(spark, files):
    rows = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "k long, f binary")
    return [None if r.d is None else tuple(r.d) for r in rows.select("k", images.dimensions(F.col("f")).alias("d")).orderBy("k").collect()]


def test_sizes(spark):
    assert read(spark, [*FILES, None]) == [*FILES.values(), None]


def test_cut_and_random_files(spark):
    whole = [f for f in FILES if len(f) < 200]
    cut = [(f[:n], FILES[f]) for f in whole for n in range(len(f))]
    got = read(spark, [f for f, _ in cut])
    assert all(g in (None, w) for g, (_, w) in zip(got, cut, strict=True))
    rng = random.Random(2)
    starts = [b"", b"\xff\xd8", b"\xff\xd8\xff", b"GIF87a", b"RIFF\0\0\0\0WEBPVP8X", b"\x89PNG\r\n\x1a\n"]
    assert len(read(spark, [rng.choice(starts) + rng.randbytes(rng.randint(0, 60)) for _ in range(800)])) == 800
    assert spark.createDataFrame([], "f binary").select(images.dimensions(F.col("f"))).count() == 0
