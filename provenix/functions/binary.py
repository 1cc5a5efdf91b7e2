"""Raw bytes of picture files: quantisation tables, entropy and appended data, as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The luminance table of the JPEG standard for quality 50, and the marks of kinds of data in an appended tail.
STANDARD = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
            18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
SIGNATURES = {"archive": (b"PK\x03\x04",), "program": (b"MZ", b"\x7fELF"), "png": (b"PNG",), "jpeg": (b"\xff\xd8", b"JFIF")}
#: Bytes from which a tail counts (more than), and from which it is large.
SLACK, LARGE = 16, 100 * 1024
# End of fixed values.

BLOCK = 4096


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of the segments of a JPEG file from its start to the first scan or its end."""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 1 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:  # no payload
            at += 2
        elif marker in (0xD9, 0xDA):
            return
        else:
            size = int.from_bytes(data[at + 2:at + 4], "big")
            yield marker, data[at + 4:at + 2 + size]
            at += 2 + max(2, size)


def _tables(data: bytes | None) -> dict[int, list[int]]:
    """Quantisation tables before the first scan, by their id; 16-bit tables keep their 128 bytes."""
    out: dict[int, list[int]] = {}
    for marker, rest in _segments(data or b""):
        while marker == 0xDB and rest:
            size = 64 << (rest[0] >> 4 > 0)
            if len(rest) > size:
                out[rest[0] % 16] = list(rest[1:1 + size])
            rest = rest[1 + size:]
    return out


@F.pandas_udf(T.MapType(T.IntegerType(), T.ArrayType(T.IntegerType())))
def quantisation_tables(content: pd.Series) -> pd.Series:
    return content.map(_tables)


def jpeg_quality(table: Column) -> Column:
    """Quality from the median ratio to the standard table, rounded half even, within 1 and 100; null below 64 entries."""
    ratios = F.array_sort(F.zip_with(F.slice(table, 1, 64), F.array(*map(F.lit, STANDARD)), lambda t, s: t * 100.0 / s))
    m = (F.element_at(ratios, 32) + F.element_at(ratios, 33)) / 2
    q = F.when(m <= 100, (200 - m) / 2).otherwise(F.try_divide(F.lit(5000.0), m))
    return F.when(F.size(table) >= 64, F.greatest(F.lit(1), F.least(F.lit(100), F.bround(q, 0).cast("int"))))


def entropy(data: bytes | None) -> float:
    """Shannon entropy of the bytes in bits; 0 without bytes."""
    if not data:
        return 0.0
    p = np.bincount(np.frombuffer(data, "u1"), minlength=256) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() + 0.0)


def _block_entropy(data: bytes | None) -> float:
    """Mean entropy of the first, middle and last block."""
    if not data:
        return 0.0
    mid = max(0, len(data) // 2 - BLOCK // 2)
    return (entropy(data[:BLOCK]) + entropy(data[mid:mid + BLOCK]) + entropy(data[-BLOCK:])) / 3


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    return content.map(entropy)


@F.pandas_udf(T.DoubleType())
def block_entropy(content: pd.Series) -> pd.Series:
    return content.map(_block_entropy)


#: What a decoder shows at the end of a file of a kind, and how many bytes of the mark and after it still belong to it.
_ENDS = {"jpg": (b"\xff\xd9", 2), "jpeg": (b"\xff\xd9", 2), "png": (b"IEND", 8)}

_TAIL = T.StructType([T.StructField("tail_bytes", T.IntegerType()), *(T.StructField(k, T.BooleanType()) for k in SIGNATURES), T.StructField("entropy", T.DoubleType())])


def _tail(data: bytes | None, extension: str | None) -> tuple:
    data = data or b""
    mark, own = _ENDS.get((extension or "").lower().lstrip("."), (None, 0))
    last = data.rfind(mark) if mark else -1
    rest = data[last + own:] if last >= 0 else b""
    rest = rest if len(rest) > SLACK else b""
    return (len(rest), *(any(m in rest for m in marks) for marks in SIGNATURES.values()), _block_entropy(data))


@F.pandas_udf(_TAIL)
def appended(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
    """Bytes after the end mark of a JPEG or PNG (0 up to SLACK), which kinds of data they hold, and the mean block entropy of the file."""
    return pd.DataFrame([_tail(d, e) for d, e in zip(content, extension)], columns=_TAIL.fieldNames())


def appended_suspicion(tail: Column, trusted: Column, entropy_: Column | None = None, bit_entropy: Column | None = None) -> Column:
    """Points for appended data, at most 99; from 50 on something is hidden.

    ``trusted``: the tags name a camera and are trusted at 90 or more; a tail that is not LARGE then costs nothing of its
    own and a JPEG in it is a thumbnail. Pictures in a tail count where it is LARGE or holds several kinds. ``entropy_``
    replaces that of the file; ``bit_entropy`` is that of the lowest bits of a PNG's samples, where they are known.
    """
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    size, e = tail["tail_bytes"], tail["entropy"] if entropy_ is None else entropy_
    excused = yes(trusted) * (size < LARGE).cast("int")
    picture = yes(tail["jpeg"]) * (1 - excused)
    odd = ((size >= LARGE) | (yes(tail["archive"]) + yes(tail["program"]) + yes(tail["png"]) + picture >= 2)).cast("int")
    points = (size > 0).cast("int") * 40 * (1 - excused) + yes(tail["archive"]) * 25 + yes(tail["program"]) * 25 + (picture + yes(tail["png"])) * odd * 20
    points = points + F.when(e > 7.92, 30).when(e > 7.5, 10).otherwise(0) + (0 if bit_entropy is None else yes(bit_entropy > 0.98) * 25)
    return F.least(F.lit(99), points).cast("int")
