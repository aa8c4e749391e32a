"""Body compression: gzip, carried as Base64 text."""

from __future__ import annotations

import base64
import binascii
import gzip
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberlog.schemas import MIN_COMPRESS_CHARS

# The two gzip magic bytes 1f 8b read "H4" plus one of s, t, u, v in Base64.
BASE64_GZIP = r"\AH4[stuv][A-Za-z0-9+/]*={0,2}\z"


def utf16_length(content: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("int")


def is_compressed(content: Column) -> Column:
    """True for Base64 text whose first decoded bytes are the gzip magic; never null."""
    size = F.length(content)
    whole_quanta = F.when(content.endswith("="), size % 4 == 0).otherwise(size % 4 != 1)
    return F.coalesce(content.startswith("H4") & content.rlike(BASE64_GZIP) & whole_quanta,
                      F.lit(False))


def should_compress(content: Column, min_chars: int = MIN_COMPRESS_CHARS,
                    enabled: bool = True) -> Column:
    """Longer than ``min_chars`` and not compressed already; never null."""
    if not enabled:
        return F.lit(False)
    # Characters <= UTF-16 units <= bytes, so the exact unit count is needed only in between.
    long_enough = (F.when(F.length(content) > min_chars, F.lit(True))
                   .when(F.octet_length(content) <= min_chars, F.lit(False))
                   .otherwise(utf16_length(content) > min_chars))
    return F.coalesce(long_enough & ~is_compressed(content), F.lit(False))


def _pack(text: str | None) -> str | None:
    if text is None:
        return None
    return base64.b64encode(gzip.compress(text.encode("utf-8"), 6, mtime=0)).decode("ascii")


def _unpack(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        padded = text + "=" * (-len(text) % 4)
        unpacked = gzip.decompress(base64.b64decode(padded, validate=True))
        return unpacked.decode("utf-8", errors="replace")
    except (OSError, EOFError, zlib.error, binascii.Error):
        return text


#: Bodies that are Python texts at a time; the rest of a batch stays in Arrow's buffers.
TEXTS_AT_ONCE = 100


def _each(change: Callable[[str | None], str | None], texts: pa.Array) -> pa.Array:
    parts = [pa.array([change(text.as_py()) for text in texts[at:at + TEXTS_AT_ONCE]], pa.string())
             for at in range(0, len(texts), TEXTS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _pack_all(texts: pa.Array) -> pa.Array:
    return _each(_pack, texts)


@F.arrow_udf(StringType())
def _unpack_all(texts: pa.Array) -> pa.Array:
    return _each(_unpack, texts)


def compress(content: Column, eligible: Column) -> Column:
    """Compressed text where ``eligible``, else the text itself. Only eligible texts reach Python."""
    return F.coalesce(_pack_all(F.when(eligible, content)), content)


def decompress(content: Column, compressed: Column | None = None) -> Column:
    """Original text; text that is not compressed or does not unpack is returned unchanged."""
    packed = is_compressed(content)
    if compressed is not None:
        packed = compressed & packed
    return F.coalesce(_unpack_all(F.when(packed, content)), content)
