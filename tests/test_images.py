"""Image quotas over calls, failures and their statuses, media types, image sources beside prompts, tool results at scale of a run."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import images
from parlance.functions import tokens as T
from parlance.operators import budgets, rendering

SOURCES = "request bigint, call bigint, idx bigint, n_bytes bigint"


def _calls(rows, most_images, most_bytes, most_total):
    out = {}
    for request in {r[0] for r in rows}:
        held = total = 0
        for call in sorted({r[1] for r in rows if r[0] == request}):
            sizes = sorted((r[2], r[3]) for r in rows if r[:2] == (request, call))
            kind = at = None
            run = total
            if held + len(sizes) > most_images:
                kind = "too_many_images"
            for idx, n in sizes if kind is None else ():
                run += n
                if n > most_bytes or run > most_total:
                    kind, at = ("image_too_large" if n > most_bytes else "total_size_too_large"), idx
                    break
            if kind is None:
                held, total = held + len(sizes), run
            out[request, call] = (kind, at, held, total)
    return out


def test_calls_that_fail_count_for_nothing(spark):
    rng = random.Random(5)
    rows = [(q, c, i, rng.choice([1, 5, 9, 30])) for q in range(12) for c in range(rng.choice([1, 3, 6])) for i in range(rng.choice([1, 2, 5]))]
    got = budgets.resolve_calls(spark.createDataFrame(rows, SOURCES).repartition(3), 6, 20, 18).collect()
    assert {(r["request"], r["call"]): (r["kind"], r["failed_at"], r["images"], r["bytes"]) for r in got} == _calls(rows, 6, 20, 18)
    assert {r["kind"] for r in got} == {None, "too_many_images", "image_too_large", "total_size_too_large"}
    assert budgets.resolve_calls(spark.createDataFrame([], SOURCES)).collect() == []


def test_equal_images_are_interchangeable(spark):
    """Repeated rows tie in every order: each counts, and the totals don't hang on how ties fall."""
    rng = random.Random(6)
    rows = [(q, c, i, rng.choice([1, 5, 9])) for q in range(6) for c in range(4) for i in range(2)] * 3
    for n in (1, 5):
        got = budgets.resolve_calls(spark.createDataFrame(rows, SOURCES).repartition(n), 30, 20, 60).collect()
        assert {(r["request"], r["call"]): (r["kind"], r["failed_at"], r["images"], r["bytes"]) for r in got} == _calls(rows, 30, 20, 60)


def test_failures(spark):
    rows = [("url_too_long", "9000", "8192"), ("too_many_images", "600", "601"), ("fetch_status", "http://x", "503"), ("empty_image", None, None), ("client", "no", None), ("token_budget", "over", None), ("invalid_base64", "x", None), ("fetch_disabled", "u", None), (None, None, None)]
    kind = budgets.kind_of(F.col("k"))
    got = spark.createDataFrame(rows, "k string, a string, b string").select(budgets.message(kind, F.col("a"), F.col("b")), budgets.status(kind), budgets.retryable(kind, F.col("b").try_cast("int"))).collect()
    assert [tuple(r)[:2] for r in got] == [
        ("external link length 9000 too long, max link length 8192", 400), ("too many images: max 600 images per request, got 601", 400), ("failed to fetch image from http://x: unexpected status 503", 400), ("input image data is empty", 400),
        ("failed to create the HTTP client: no", 500), ("over", 500), ("invalid data url: x", 400), ("unsupported image source: u", 400), (None, None),
    ]
    assert [r[2] for r in got][2] is True and len(budgets.MESSAGES) == 18


@pytest.mark.parametrize(("data", "kind"), [
    (b"\x89PNG\r\n\x1a\n..", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"GIF89a", "image/gif"), (b"RIFF....WEBPVP8 ", "image/webp"), (b"RIFF....WAVE", None), (b"BM..", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"\0\0\2\0", "image/vnd.microsoft.icon"), (b"qoif", "image/qoi"),
    (b"DDS ", "image/vnd-ms.dds"), (b"8BPS", "image/vnd.adobe.photoshop"), (b"farbfeld", "image/x-farbfeld"), (b"\x76\x2f\x31\x01", "image/x-exr"), (b"#?RGBE", "image/vnd.radiance"), (b"\xff\x0a", "image/jxl"), (b"....ftypavif", "image/avif"), (b"....ftypheic", "image/heif"), (b"....ftypisom", None), (b"x" * 30 + b"TRUEVISION-XFILE.\0", "image/x-tga"), (b"", None), (None, None),
])
def test_media_types(spark, data, kind):
    got = spark.createDataFrame([(data,)], "d binary").select(images.sniff_any(F.col("d")), images.sniff(F.col("d"))).first()
    assert tuple(got) == (kind, kind if kind in images.MEDIA_TYPES else None)


def test_valid_sizes(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 5, 1), (5000, 1, 1), (5000, 1, 15), (9000, 1, 1)], "w int, h int, n int")
    assert [r[0] for r in df.select(images.is_valid(F.col("w"), F.col("h"), F.col("n"))).collect()] == [True, False, True, False, False]


def test_images_beside_the_prompt(spark):
    image = lambda u: {"kind": "url", "url": u, "detail": "high"}
    rows = [
        (1, 0, "user", f"a {T.IMAGE}", None, None, [image("1")]), (1, 1, "user", f"{T.IMAGE}{T.IMAGE}", None, None, [image("2"), image("3")]), (1, 2, "assistant", "", ["x", "y"], None, [image("no")]),
        (1, 3, "tool", T.IMAGE, None, "y", [image("y")]), (1, 4, "tool", T.IMAGE, None, "x", [image("x")]), (1, 5, "user", "none", None, None, None), (2, 0, "user", "none", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, idx bigint, role string, content string, call_ids array<string>, tool_call_id string, images {rendering.COLUMNS['images']}")
    got = {r["conv_id"]: [i["url"] for i in r["images"]] for r in rendering.render(df).collect()}
    assert got == {1: ["1", "2", "3", "x", "y"], 2: []}
    assert rendering.render(df.drop("images")).columns == ["conv_id", "prompt"]


def test_long_runs_of_tool_results(spark):
    """Each result is held once: 20,000 in one run."""
    n = 20_000
    calls = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame([(1, 0, "assistant", "", calls, None)] + [(1, i + 1, "tool", str(n - 1 - i), None, f"c{n - 1 - i}") for i in range(n)], "conv_id bigint, idx bigint, role string, content string, call_ids array<string>, tool_call_id string")
    # ids rank by place: only the first few of so many calls are named, the others rank first
    got = rendering.order_tool_results(rendering.messages(df.withColumn("call_ids", F.slice("call_ids", 1, 3)))).filter("role = 'tool'").orderBy("idx").collect()
    assert [r["content"] for r in got[-2:]] == ["1", "2"] and [r["content"] for r in got[:2]] == [str(n - 1), str(n - 2)] and len(got) == n
