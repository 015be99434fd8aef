"""Image sources: data URLs, raw bytes, an injectable fetcher; header dimensions without a pixel decoder."""

from __future__ import annotations

import base64
import re
import struct
import time
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.images import MAX_BYTES, MEDIA_TYPES

#: Seconds before each further try of a fetch.
DELAYS = (0.3, 0.6, 1.0)
_SPACE = re.compile(rb"[\t\n\x0c\r ]")


class ImageError(ValueError):
    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class FetchError(ImageError):
    """A failed fetch; worth another try without a status, or with one from 500 on."""

    def __init__(self, status: int | None = None) -> None:
        super().__init__("fetch", str(status or ""))
        self.retry = status is None or status >= 500


def forgiving_base64(data: bytes) -> bytes:
    """Base64 as web pages may write it: white space ignored, padding optional, nothing else let through."""
    data = _SPACE.sub(b"", data)
    if len(data) % 4 == 0:
        data = data[:-2] if data.endswith(b"==") else data[:-1] if data.endswith(b"=") else data
    if len(data) % 4 == 1 or re.search(rb"[^A-Za-z0-9+/]", data):
        raise ImageError("invalid_base64")
    return base64.b64decode(data + b"=" * (-len(data) % 4))


def media_name(name: str) -> str:
    m = name.split(";", 1)[0].strip().lower()
    return "image/jpeg" if m == "image/jpg" else m


def parse_data_url(url: str, most: int = MAX_BYTES) -> tuple[str, bytes]:
    """(media type, bytes); type and estimated size are checked before anything is decoded."""
    url = re.sub(r"[\t\n\r]", "", url.lstrip("".join(map(chr, range(33)))))  # as URLs are read
    if url[:5].lower() != "data:" or "," not in url:
        raise ImageError("invalid_data_url")
    head, body = url[5:].split("#", 1)[0].split(",", 1)
    kind = media_name(head)
    if kind not in MEDIA_TYPES:
        raise ImageError("unsupported_media_type", kind)
    is_base64 = bool(re.search(r";\s*base64\s*\Z", head, re.I))
    if (len(body) * 3 // 4 if is_base64 else len(body) // 3) > most:
        raise ImageError("too_large")
    raw = unquote_to_bytes(body)
    data = forgiving_base64(raw) if is_base64 else raw
    if len(data) > most:
        raise ImageError("too_large")
    return kind, data


def dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, JPEG or WebP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def reject(url: str) -> bytes:
    """The default fetcher: this engine opens no connections of its own."""
    raise ImageError("fetch_disabled", url)


def fetched(url: str, fetch: Callable[[str], bytes], sleep: Callable[[float], None] = time.sleep) -> bytes:
    for delay in (*DELAYS, None):
        try:
            return fetch(url)
        except FetchError as e:
            if delay is None or not e.retry:
                raise
            sleep(delay)
    raise AssertionError


RESOLVED = "request bigint, idx bigint, media_type string, n_bytes bigint, width bigint, height bigint, data binary, error string"


def resolve(sources: DataFrame, fetch: Callable[[str], bytes] = reject) -> DataFrame:
    """Sources (request, idx, kind, data_url, url, data) to bytes and header figures, or an error kind; every one is tried."""

    def one(row: dict) -> tuple:
        try:
            if row["kind"] == "data_url":
                kind, data = parse_data_url(row["data_url"])
            else:
                kind, data = None, bytes(row["data"]) if row["kind"] == "bytes" else fetched(row["url"], fetch)
            if len(data) > MAX_BYTES:
                raise ImageError("too_large")
            size = dimensions(data) or (None, None)
            return row["request"], row["idx"], kind, len(data), *size, data, None
        except ImageError as e:
            return row["request"], row["idx"], None, None, None, None, None, e.kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESOLVED.split(", ")]
        for b in batches:
            yield pd.DataFrame([one(r) for r in b.to_dict("records")], columns=names).astype({c: "Int64" for c in ("n_bytes", "width", "height")})

    return sources.select("request", "idx", "kind", "data_url", "url", "data").mapInPandas(run, RESOLVED)
