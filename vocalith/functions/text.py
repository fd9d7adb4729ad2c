"""Scalar functions on columns, all built of Spark's own: they stay in the JVM and in code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SITE_HOST = r"cnn\.com"
REGION = "us-east-1"
TTL_SECONDS = 500
URL_LIFETIME_SECONDS = 3600
#: In this order; the ampersand comes after the quote, so a quote ends as `&amp;quot;`.
ESCAPES = (('"', "&quot;"), ("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"))
#: What trimming takes for white space.
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def present(key: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(key != "", F.lit(False))


def known(key: Column) -> Column:
    """The key, or null where it is empty."""
    return F.nullif(key, F.lit(""))


def escape_ssml(text: Column, strict_xml: bool = False) -> Column:
    """Escapes for SSML; strict_xml escapes the ampersand first."""
    for sign, name in sorted(ESCAPES, key=lambda x: x[0] != "&") if strict_xml else ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def ssml_title(title: Column, byline: Column) -> Column:
    return F.concat(F.lit("<speak>"), escape_ssml(title), F.lit("<p>"), escape_ssml(byline), F.lit("</p></speak>"))


def paragraphs(text: Column) -> Column:
    """An array with each line as a paragraph; bodies aren't escaped, empty lines stay."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def group_paragraphs(text: Column, limit: int = 2900) -> Column:
    """An array of SSML groups: paragraphs packed greedily, in order.

    A paragraph joins the group while the group's length (without the space about to be added
    and without the wrapper) and its own are within the limit; a longer one gets its own group.
    """
    sized = F.transform(paragraphs(text), lambda p: F.struct(p.alias("p"), utf16_length(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("group"), F.lit(0).alias("size"), F.lit(False).alias("open"))

    def closed(s: Column) -> Column:
        return F.when(s["open"], F.concat(s["done"], F.array(F.concat(F.lit("<speak>"), s["group"], F.lit("</speak>"))))).otherwise(s["done"])

    def admit(s: Column, p: Column) -> Column:
        joined = F.when(s["open"], F.concat_ws(" ", s["group"], p["p"])).otherwise(p["p"])
        size = F.when(s["open"], s["size"] + 1 + p["n"]).otherwise(p["n"])
        fits = s["size"] + p["n"] <= limit
        return F.struct(
            F.when(fits, s["done"]).otherwise(closed(s)).alias("done"), F.when(fits, joined).otherwise(p["p"]).alias("group"), F.when(fits, size).otherwise(p["n"]).alias("size"), F.lit(True).alias("open")
        )

    return F.aggregate(sized, start, admit, closed)


def content_path(url: Column, host: str = SITE_HOST) -> Column:
    """What follows the host, with a leading slash; null for another host or an empty path. One subdomain label is allowed."""
    rest = F.regexp_extract(url, rf"^https?://(?:[a-zA-Z0-9_-]+\.)?(?:{host})/([^\n\r\u2028\u2029]*)", 1)
    return F.when(rest != "", F.concat(F.lit("/"), rest))


def parse_object_url(url: Column, strict: bool = False) -> Column:
    """bucket and decoded key of an object's URL; null for any other URL, or an error if strict."""
    pattern = r"https://s3\.[^\n\r\u2028\u2029]+\.amazonaws\.com/([^/]+)/([^\n\r\u2028\u2029]+)"
    key = F.try_url_decode(F.replace(F.regexp_extract(url, pattern, 2), F.lit("+"), F.lit("%2B")))
    found = F.struct(F.regexp_extract(url, pattern, 1).alias("bucket"), key.alias("key"))
    other = F.raise_error(F.lit("Invalid S3 URL")).cast("struct<bucket: string, key: string>") if strict else F.lit(None)
    return F.when(F.regexp_like(url, F.lit(pattern)), found).otherwise(other)


def object_url(bucket: Column, key: Column, region: str = REGION) -> Column:
    """The key isn't encoded."""
    return F.concat(F.lit(f"https://s3.{region}.amazonaws.com/"), bucket, F.lit("/"), key)


def object_key(url: Column, bucket: str, region: str = REGION) -> Column:
    """The URL without the bucket's prefix."""
    prefix = f"https://s3.{region}.amazonaws.com/{bucket}/"
    return F.when(F.startswith(url, F.lit(prefix)), F.substring(url, F.lit(len(prefix) + 1), F.length(url))).otherwise(url)


def merged_key(uuid: Column, language: Column) -> Column:
    return F.concat(F.lit("full/"), uuid, F.lit("-"), language, F.lit(".mp3"))


def execution_name(uuid: Column, code: Column) -> Column:
    return F.concat(uuid, F.lit("-"), code)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trim(text: Column) -> Column:
    """Without white space at both ends, all of Unicode's."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def iso_time(at: Column) -> Column:
    """UTC with milliseconds; the session's zone is taken for UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ttl(at: Column, seconds: int = TTL_SECONDS) -> Column:
    return F.unix_timestamp(at) + seconds


def all_languages(outputs: Column, codes: tuple[str, ...]) -> Column:
    """Whether every code is a key of the map; a null map has none."""
    return missing_languages(outputs, codes) == 0


def missing_languages(outputs: Column, codes: tuple[str, ...]) -> Column:
    have = F.coalesce(F.map_keys(outputs), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*map(F.lit, codes)), have))


def languages_present(outputs: Column, language: Column, codes: tuple[str, ...]) -> Column:
    """For a language whether it has an entry that isn't null, else all codes. Codes are opaque, so `en` isn't `en-US`."""
    own = F.try_element_at(outputs, F.coalesce(language, F.lit(""))).isNotNull()
    return F.when(present(language), own).otherwise(all_languages(outputs, codes))


def content_id(url: Column) -> Column:
    """A new item's id, derived from its URL so that reruns agree."""
    h = F.sha2(url, 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


#: Gives the signed URL of a bucket, a key and the second at which it expires.
Signer = Callable[[Column, Column, Column], Column]


def signed(url: Column, now: Column, lifetime: int = URL_LIFETIME_SECONDS, signer: Signer | None = None) -> Column:
    """An object's URL, signed by the caller's signer (without one, as it is), and when it expires."""
    expires, at = F.unix_timestamp(now) + lifetime, parse_object_url(url)
    return F.struct((url if signer is None else signer(at["bucket"], at["key"], expires)).alias("url"), expires.alias("expires_at"))
