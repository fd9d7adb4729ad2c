"""HMAC-SHA256 and pre-signed URLs as column expressions, which stay in the JVM.

Signatures are those of the object store's public Signature Version 4, in the query string, with
an unsigned payload. A secret that is a literal shows in plans and event logs; where these are
kept, have `spark.sql.redaction.string.regex` hide it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import REGION, URL_LIFETIME_SECONDS, Signer

# Bytes of a block of SHA-256, and what they are combined with.
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C
_ALGORITHM, _PAYLOAD = "AWS4-HMAC-SHA256", "UNSIGNED-PAYLOAD"
_LATIN, _ZERO = "ISO-8859-1", "\u0100"


def _combined(block: Column, byte: int) -> Column:
    """A block with each byte combined: a character a byte, translated. `translate` drops what becomes U+0000, so that comes after it."""
    to = "".join(chr(k ^ byte) if k ^ byte else _ZERO for k in range(256))
    text = F.translate(F.decode(block, _LATIN), "".join(map(chr, range(256))), to)
    return F.encode(F.replace(text, F.lit(_ZERO), F.lit("\0")), _LATIN)


def _padded(key: Column) -> Column:
    """A key of up to a block, with zeros to its end."""
    return F.unhex(F.rpad(F.hex(key), 2 * _BLOCK, "0"))


def _hmac(block: Column, message: Column) -> Column:
    """The HMAC under a padded key. No lambda stands between: of a constant key the optimizer makes two constant blocks."""
    inner = F.unhex(F.sha2(F.concat(_combined(block, _INNER), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(_combined(block, _OUTER), inner), 256))


def hmac_sha256(key: Column, message: Column) -> Column:
    """The bytes of the HMAC of a message under a key, both bytes or strings in UTF-8; null if either is."""
    key = key.cast("binary")
    return _hmac(_padded(F.when(F.octet_length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)), message)


def signing_key(secret: Column, day: Column, region: Column, service: Column) -> Column:
    """The key of a day (yyyyMMdd), region and service, by the chain of HMACs."""
    key = hmac_sha256(F.concat(F.lit("AWS4"), secret), day)
    for part in (region, service, F.lit("aws4_request")):
        key = _hmac(_padded(key), part)
    return key


def uri_encoded(text: Column, slashes: bool = False) -> Column:
    """Percent-encoded but for letters, digits and -._~; slashes: these stay too."""
    out = F.url_encode(text)
    for was, is_ in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if slashes else ())):
        out = F.replace(out, F.lit(was), F.lit(is_))
    return out


def presigned(bucket: Column, key: Column, at: Column, lifetime: int, access_key: Column, secret: Column, region: str = REGION, host: Column | None = None) -> Column:
    """The URL that gets an object without other credentials for so many seconds from `at`, a timestamp (the session's zone is taken for UTC).

    host: by default the bucket's own.
    """
    host = F.concat(bucket, F.lit(f".s3.{region}.amazonaws.com")) if host is None else host
    day, time = F.date_format(at, "yyyyMMdd"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    scope = F.concat_ws("/", day, F.lit(region), F.lit("s3"), F.lit("aws4_request"))
    path = F.concat(F.lit("/"), uri_encoded(key, slashes=True))
    query = F.concat(
        F.lit(f"X-Amz-Algorithm={_ALGORITHM}&X-Amz-Credential="), uri_encoded(F.concat_ws("/", access_key, scope)), F.lit("&X-Amz-Date="), time, F.lit(f"&X-Amz-Expires={lifetime}&X-Amz-SignedHeaders=host")
    )
    request = F.concat(F.lit("GET\n"), path, F.lit("\n"), query, F.lit("\nhost:"), host, F.lit(f"\n\nhost\n{_PAYLOAD}"))
    to_sign = F.concat(F.lit(f"{_ALGORITHM}\n"), time, F.lit("\n"), scope, F.lit("\n"), F.sha2(request, 256))
    signature = F.lower(F.hex(_hmac(_padded(signing_key(secret, day, F.lit(region), F.lit("s3"))), to_sign)))
    return F.concat(F.lit("https://"), host, path, F.lit("?"), query, F.lit("&X-Amz-Signature="), signature)


def presigner(access_key: str, secret: str, lifetime: int = URL_LIFETIME_SECONDS, region: str = REGION) -> Signer:
    """A signer for `text.signed` and `catalog.respond`."""

    def sign(bucket: Column, key: Column, expires: Column) -> Column:
        return presigned(bucket, key, F.timestamp_seconds(expires - lifetime), lifetime, F.lit(access_key), F.lit(secret), region)

    return sign
