"""Image arithmetic: token grids, size limits, media types, sources. Native expressions over width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patch side, grid reduction, token budget, least area; quotas.
PATCH, REDUCE, BUDGET, LEAST_AREA = 14, 3, 1024, 544 * 544
MAX_IMAGES, MAX_BYTES, MAX_TOTAL = 600, 32 << 20, 64 << 20
MANY_IMAGES, SIDE_MANY, SIDE_FEW, SIDE_LOW = 15, 4096, 8192, 512
MEDIA_TYPES = ("image/jpeg", "image/png", "image/gif", "image/webp")


def _up(x: Column, by: int) -> Column:
    return F.floor((x + (by - 1)) / F.lit(by)).cast("bigint")


def _cut(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def _grid(w: Column, h: Column) -> Column:
    gw, gh = _up(_cut(w / F.lit(PATCH)), REDUCE), _up(_cut(h / F.lit(PATCH)), REDUCE)
    return F.struct((gh * (gw + 1) + 2).alias("num_tokens"), w.alias("best_width"), h.alias("best_height"), gh.alias("n_llm_h"), gw.alias("n_llm_w"))


def resize(width: Column, height: Column) -> Column:
    """One step: least area, whole patches, token budget. `resized` repeats it until it changes nothing.

    Local values are bound by one-element transforms, so no expression is spelled out twice."""

    def bind(value: Column, body) -> Column:  # noqa: ANN001
        return F.transform(F.array(value), body)[0]

    def scaled(x: Column) -> Column:
        small = (x["w"] * x["h"] < LEAST_AREA) & (x["w"] * x["h"] > 0)
        r = F.sqrt(F.lit(float(LEAST_AREA)) / (x["w"] * x["h"]).cast("double"))
        return F.struct(F.when(small, _cut(x["w"].cast("double") * r)).otherwise(x["w"]).alias("w"), F.when(small, _cut(x["h"].cast("double") * r)).otherwise(x["h"]).alias("h"))

    def solved(s: Column) -> Column:
        ratio = s["h"].cast("double") / s["w"].cast("double")
        mw = F.sqrt(F.lit(BUDGET - 2.0) / ratio + 0.25) - 0.5

        def choose(m: Column) -> Column:
            side = PATCH * REDUCE
            w, h = s["w"].cast("double"), s["h"].cast("double")
            beta = F.least((_cut(m["w"]) * side).cast("double") / w, (_cut(m["h"]) * side).cast("double") / h)
            bw = F.when(m["w"] < 1, F.lit(side)).when(m["h"] < 1, F.lit((BUDGET - 3) * side)).otherwise(_cut(w * beta / F.lit(float(PATCH))) * PATCH)
            bh = F.when(m["w"] < 1, F.lit((BUDGET - 2) // 2 * side)).when(m["h"] < 1, F.lit(side)).otherwise(_cut(h * beta / F.lit(float(PATCH))) * PATCH)
            return _grid(bw.cast("bigint"), bh.cast("bigint"))

        return bind(F.struct(mw.alias("w"), (mw * ratio).alias("h")), choose)

    def fitted(s: Column) -> Column:
        first = _grid(_up(s["w"], PATCH) * PATCH, _up(s["h"], PATCH) * PATCH)
        return bind(first, lambda g: F.when(g["num_tokens"] > BUDGET, solved(s)).otherwise(g))

    return bind(F.struct(width.cast("bigint").alias("w"), height.cast("bigint").alias("h")), lambda x: bind(scaled(x), fitted))


def resized(width: Column, height: Column, most_steps: int = 10) -> Column:
    """The size and tokens of an image: steps until one changes nothing; raises where that takes too many."""
    start = F.struct(resize(width, height).alias("r"), F.lit(False).alias("done"))

    def step(a: Column, _: Column) -> Column:
        after = F.transform(F.array(resize(a["r"]["best_width"], a["r"]["best_height"])), lambda n: F.struct(n.alias("r"), (n == a["r"]).alias("done")))[0]
        return F.when(a["done"], a).otherwise(after)

    kind = "struct<num_tokens:bigint,best_width:bigint,best_height:bigint,n_llm_h:bigint,n_llm_w:bigint>"
    return F.aggregate(F.sequence(F.lit(2), F.lit(most_steps)), start, step, lambda a: F.when(a["done"], a["r"]).otherwise(F.raise_error(F.lit("image size does not converge")).cast(kind)))


def max_side(n_images: Column) -> Column:
    return F.when(n_images >= MANY_IMAGES, SIDE_MANY).otherwise(SIDE_FEW)


def low_detail(width: Column, height: Column) -> Column:
    """Sides scaled so that the longer one is at most SIDE_LOW."""
    longer = F.greatest(width, height)
    scaled = lambda x: F.greatest(F.round(x * F.lit(float(SIDE_LOW)) / longer).cast("bigint"), F.lit(1))
    return F.struct(F.when(longer > SIDE_LOW, scaled(width)).otherwise(width).alias("width"), F.when(longer > SIDE_LOW, scaled(height)).otherwise(height).alias("height"))


def media_type(name: Column) -> Column:
    """A MIME name without parameters and case, with the usual alias; null if it isn't accepted."""
    m = F.lower(F.trim(F.substring_index(name, ";", 1)))
    m = F.when(m == "image/jpg", "image/jpeg").otherwise(m)
    return F.when(m.isin(*MEDIA_TYPES), m)


#: First bytes, in hexadecimal, of image files and their media types; brands of files that begin with a box.
MAGIC = {
    "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "00000100": "image/vnd.microsoft.icon",
    "00000200": "image/vnd.microsoft.icon", "716F6966": "image/qoi", "44445320": "image/vnd-ms.dds", "38425053": "image/vnd.adobe.photoshop", "6661726266656C64": "image/x-farbfeld", "762F3101": "image/x-exr",
    "233F52414449414E4345": "image/vnd.radiance", "233F52474245": "image/vnd.radiance", "FF0A": "image/jxl",
}
AVIF, HEIF = ("avif", "avis"), ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1")
TGA_TAIL = "TRUEVISION-XFILE."


def sniff_any(data: Column) -> Column:
    """The media type that the bytes of a BINARY column show, accepted or not; null if they show none."""
    head, brand = F.hex(F.substring(data, 1, 16)), F.decode(F.substring(data, 9, 4), "ISO-8859-1")
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for first, kind in MAGIC.items():
        out = out.when(head.startswith(first), kind)
    box = F.substring(head, 9, 8) == "66747970"
    tail = F.decode(F.substring(data, -26, 26), "ISO-8859-1")
    return out.when(box & brand.isin(*AVIF), "image/avif").when(box & brand.isin(*HEIF), "image/heif").when((F.length(data) >= 26) & tail.contains(TGA_TAIL), "image/x-tga")


def sniff(data: Column) -> Column:
    """The media type that the bytes of a BINARY column show; null if it isn't accepted."""
    kind = sniff_any(data)
    return F.when(kind.isin(*MEDIA_TYPES), kind)


def is_valid(width: Column, height: Column, n_images: Column) -> Column:
    """Whether an image has an area and no side beyond what a request of so many images may show."""
    return (width > 0) & (height > 0) & (F.greatest(width, height) <= max_side(n_images))


def source_kind(url: Column) -> Column:
    """url, data_url or null."""
    http = (F.lower(F.substring(url, 1, 4)) == "http") & (F.octet_length(url) <= 8192)
    return F.when(http, "url").when((F.lower(F.substring(url, 1, 4)) != "http") & F.contains(url, F.lit("base64,")), "data_url")
