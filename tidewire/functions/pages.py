"""Paragraphs, pictures and videos of a web page, as arrays; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

UNWANTED = r"(?i)(logo|icon|avatar|sprite|pixel|badge|placeholder|advert)"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's quoted value; empty if it isn't there."""
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)""", 1)


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute http(s) address, seen from the page; null for other schemes, empty links and unusable pages."""
    root, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^?#]+/)", 1)
    link = F.trim(link)
    out = F.when(link.rlike(r"(?i)^https?://"), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link)).when((link == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
    out = out.when(root == "", None).when(F.startswith(link, F.lit("/")), F.concat(root, link))
    return out.otherwise(F.concat(F.when(F.length(folder) > F.length(root) + 1, folder).otherwise(F.concat(root, F.lit("/"))), link))


def paragraphs(html: Column) -> Column:
    """Array of the paragraphs' whole texts without tags; each goes to its end tag, or to the next paragraph or the article's end where that is missing."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p(?=[\s>])[^>]*>(.*?)(?=</p\s*>|<p[\s>]|</article\s*>|</body\s*>|\z)"), F.lit(1))
    return F.transform(found, clean)


def media(html: Column, base: Column) -> Column:
    """Array of (kind, origin, url, width, height): what the page names in its head, its pictures, its videos; null page: null."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b[^>]*>)"), F.lit(1))
    size = lambda tag, name: F.regexp_extract(attribute(tag, name), r"^(\d{1,6})(px)?$", 1).try_cast("int")

    def row(kind: str, origin: str, name: str):  # noqa: ANN202
        return lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), resolve(attribute(t, name), base).alias("url"), size(t, "width").alias("width"), size(t, "height").alias("height"))

    named = lambda pattern: F.filter(tags("meta"), lambda t: F.concat(attribute(t, "property"), F.lit(" "), attribute(t, "name")).rlike(pattern))
    found = F.concat(
        F.transform(named(r"(?i)\b(og|twitter):image\b"), row("image", "meta", "content")), F.transform(tags("img"), row("image", "img", "src")),
        F.transform(named(r"(?i)\bog:video\b"), row("video", "meta", "content")), F.transform(F.concat(tags("video"), tags("source")), row("video", "tag", "src")),
    )
    return F.filter(found, lambda c: c.url.isNotNull())


def best_media(candidates: Column, width: int = 300, height: int = 200) -> Column:
    """The first that suits: pictures of the head in order, then others by area, then videos. Known sizes below the least and unwanted addresses don't suit."""
    fits = F.filter(candidates, lambda c: ~c.url.rlike(UNWANTED) & F.coalesce(c.width >= width, F.lit(True)) & F.coalesce(c.height >= height, F.lit(True)))
    area = lambda c: F.when(c.origin == "img", F.coalesce(c.width * c.height, F.lit(0))).otherwise(0)
    keyed = F.transform(fits, lambda c, i: F.struct(F.when(c.kind == "video", 2).when(c.origin == "img", 1).otherwise(0).alias("class"), (-area(c)).alias("area"), i.alias("pos"), c.alias("c")))
    return F.array_min(F.transform(keyed, lambda k: F.struct(k["class"], k.area, k.pos, k.c.url.alias("url")))).url
