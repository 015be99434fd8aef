"""Image quotas over a request's calls, and what a failed image says: native.

A request resolves images in calls, one after the other. A call fails as a whole, and one that fails counts for nothing, so the
running totals are a fold over calls, not a window over images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images

#: The kinds of image failures and what they say; {} takes the figures in order.
MESSAGES = {
    "unsupported": "unsupported image source: {}", "url_too_long": "external link length {} too long, max link length {}", "invalid_url": 'invalid url: "{}"', "too_many_images": "too many images: max {} images per request, got {}",
    "image_too_large": "image size {} bytes exceeds the limit of {} bytes", "total_size_too_large": "total image size {} bytes exceeds the limit of {} bytes", "invalid_data_url": "invalid data url: {}", "empty_image": "input image data is empty",
    "unsupported_media_type": "unsupported image media type: {}", "image_dimensions_too_large": "image dimensions exceed the maximum allowed", "decode": "failed to decode image: {}", "resize": "failed to resize image: {}", "encode": "failed to encode image: {}",
    "encode_failed": "failed to encode image", "token_budget": "{}", "fetch": "failed to fetch image from {}: {}", "fetch_status": "failed to fetch image from {}: unexpected status {}", "client": "failed to create the HTTP client: {}",
}
SERVER_SIDE = ("client", "token_budget")
#: Kinds of sources.image_sources that go by a wider name here.
WIDER = {"invalid_base64": "invalid_data_url", "too_large": "image_too_large", "fetch_disabled": "unsupported"}


def kind_of(error: Column) -> Column:
    """The kind that an error of image_sources.resolve belongs to."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in WIDER.items() for x in kv))[error], error)


def message(kind: Column, *figures: Column) -> Column:
    """What a failure of a kind says, its figures put in; null for none."""
    out = None
    for k, template in MESSAGES.items():
        parts = template.split("{}")
        text = [F.lit(parts[0])]
        for part, figure in zip(parts[1:], figures, strict=False):
            text += [F.coalesce(figure.cast("string"), F.lit("")), F.lit(part)]
        out = F.when(kind == k, F.concat(*text)) if out is None else out.when(kind == k, F.concat(*text))
    return out


def status(kind: Column) -> Column:
    """The HTTP status of a failure: the service's own are 500, all others the request's."""
    return F.when(kind.isin(*SERVER_SIDE), 500).when(kind.isNotNull(), 400)


def retryable(kind: Column, http_status: Column) -> Column:
    return (kind == "fetch") | ((kind == "fetch_status") & F.coalesce(http_status >= 500, F.lit(False)))


def resolve_calls(sources: DataFrame, most_images: int = images.MAX_IMAGES, most_bytes: int = images.MAX_BYTES, most_total: int = images.MAX_TOTAL) -> DataFrame:
    """Sources (request, call, idx, n_bytes) to a row for each call: (request, call, kind, failed_at, error, status, images, bytes).

    A call of too many images fails before any is looked at; else its first image, by idx, that is too large by itself or with
    all before it. `images` and `bytes` are the request's totals after the call. One exchange by request; a request's sizes meet in one task."""
    sizes = F.array_sort(F.collect_list(F.struct("idx", "n_bytes")))
    calls = sources.groupBy("request", "call").agg(sizes.alias("sizes")).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("call", "sizes"))).alias("calls"))
    done = "struct<call:bigint,kind:string,failed_at:bigint,figure:bigint,most:bigint,images:bigint,bytes:bigint>"
    state = f"struct<images:bigint,bytes:bigint,done:array<{done}>>"
    run = "struct<bytes:bigint,kind:string,at:bigint,figure:bigint>"

    def image(r: Column, s: Column) -> Column:
        total = r["bytes"] + s["n_bytes"]
        kind = F.when(r["kind"].isNotNull(), r["kind"]).when(s["n_bytes"] > most_bytes, "image_too_large").when(total > most_total, "total_size_too_large")
        new = r["kind"].isNull() & kind.isNotNull()
        figure = F.when(s["n_bytes"] > most_bytes, s["n_bytes"]).otherwise(total)
        return F.struct(total.alias("bytes"), kind.alias("kind"), F.when(new, s["idx"]).otherwise(r["at"]).alias("at"), F.when(new, figure).otherwise(r["figure"]).alias("figure")).cast(run)

    def call(s: Column, c: Column) -> Column:
        count = s["images"] + F.size(c["sizes"])
        many = count > most_images
        none = F.lit(None)
        begin = F.struct(s["bytes"].alias("bytes"), F.when(many, "too_many_images").alias("kind"), none.alias("at"), F.when(many, count).alias("figure")).cast(run)

        def after(r: Column) -> Column:
            fine = r["kind"].isNull()
            held, total = F.when(fine, count).otherwise(s["images"]), F.when(fine, r["bytes"]).otherwise(s["bytes"])
            most = F.when(r["kind"] == "too_many_images", most_images).when(r["kind"] == "image_too_large", most_bytes).when(~fine, most_total)
            row = F.struct(c["call"].alias("call"), r["kind"].alias("kind"), r["at"].alias("failed_at"), r["figure"].alias("figure"), most.alias("most"), held.alias("images"), total.alias("bytes")).cast(done)
            return F.struct(held.alias("images"), total.alias("bytes"), F.array_append(s["done"], row).alias("done")).cast(state)

        return F.transform(F.array(F.aggregate(c["sizes"], begin, image)), after)[0]

    start = F.struct(F.lit(0).alias("images"), F.lit(0).alias("bytes"), F.array().cast(f"array<{done}>").alias("done")).cast(state)
    rows = calls.select("request", F.explode(F.aggregate("calls", start, call, lambda s: s["done"])).alias("c")).select("request", "c.*")
    many = F.col("kind") == "too_many_images"
    said = message(F.col("kind"), F.when(many, F.col("most")).otherwise(F.col("figure")), F.when(many, F.col("figure")).otherwise(F.col("most")))
    return rows.select("request", "call", "kind", "failed_at", said.alias("error"), status(F.col("kind")).cast("int").alias("status"), "images", "bytes")
