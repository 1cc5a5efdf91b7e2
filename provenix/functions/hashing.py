"""64-bit perceptual hashes as Column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a hash; also the distance of a missing or malformed one.
BITS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usable(h: Column | str) -> Column:
    """Whether a hash is 16 hexadecimal digits, surrounding blanks aside; null is not."""
    return F.coalesce(F.trim(_col(h)).rlike("^[0-9A-Fa-f]{16}$"), F.lit(False))


def code(h: Column | str) -> Column:
    """The bits of a usable hash as bigint, else null. Two halves, because a full-width number overflows bigint."""
    t = F.trim(_col(h))
    half = lambda at: F.conv(F.substring(t, at, 8), 16, 10).cast("bigint")
    return F.when(usable(h), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming64(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two hashes; 64 if either is missing or malformed."""
    return F.coalesce(F.bit_count(code(a).bitwiseXOR(code(b))).cast("int"), F.lit(BITS))


def visual_similarity(p1, p2, d1, d2, a1, a2) -> Column:
    """0.5, 0.3 and 0.2 times the agreement of phash, dhash and ahash; 0 without both phashes."""
    agree = lambda x, y: 1 - hamming64(x, y) / 64.0
    return F.when(usable(p1) & usable(p2), agree(p1, p2) * 0.5 + agree(d1, d2) * 0.3 + agree(a1, a2) * 0.2).otherwise(0.0)


def differing_bits(a: Column | str, b: Column | str) -> Column:
    """array<int> of the positions, most significant first, in which two usable hashes differ; null otherwise."""
    x = code(a).bitwiseXOR(code(b))
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", x, F.lit(63) - i) == 1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; an expression named twice would be worked out twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median64(v: Column | str) -> Column:
    """Exact median of 64 values: the mean of the middle two."""
    return _let(F.array_sort(_col(v)), lambda s: (F.element_at(s, 32).cast("double") + F.element_at(s, 33).cast("double")) / 2)


def bits_to_hex(bits: Column) -> Column:
    """16 hex digits of 64 booleans, most significant first."""
    text = F.array_join(F.transform(bits, lambda b: F.when(b, "1").otherwise("0")), "")
    half = lambda t, at: F.lpad(F.lower(F.conv(F.substring(t, at, 32), 2, 16)), 8, "0")
    return _let(text, lambda t: F.concat(half(t, 1), half(t, 33)))


def hash_of_grid(v: Column | str, kind: str) -> Column:
    """Hash of an 8 x 8 grid (64 values): ``p`` above the median, ``a`` above the mean, ``d`` above the next value, cyclically.

    Null unless the array has exactly 64 non-null values.
    """
    c = _col(v)

    def bits(x: Column) -> Column:
        if kind == "p":
            return _let(median64(x), lambda m: F.transform(x, lambda e: e > m))
        if kind == "a":
            return _let(F.aggregate(x, F.lit(0.0), lambda s, e: s + e) / 64, lambda m: F.transform(x, lambda e: e > m))
        return F.zip_with(x, F.concat(F.slice(x, 2, 63), F.slice(x, 1, 1)), lambda a, b: a > b)

    if kind not in ("p", "a", "d"):
        raise ValueError(kind)
    whole = (F.size(c) == 64) & ~F.exists(c, lambda e: e.isNull())
    return F.when(whole, _let(F.transform(c, lambda e: e.cast("double")), lambda x: bits_to_hex(bits(x))))


def match_band(distance: Column) -> Column:
    """Band of a hash distance: up to 4 bits, up to 12, more."""
    return F.when(distance <= 4, "near-identical").when(distance <= 12, "similar").otherwise("different")


def md5_mod(text: Column, n: int) -> Column:
    """The MD5 of a text as one number, modulo ``n``; null counts as the empty text."""
    digits = F.md5(F.coalesce(text, F.lit("")))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda r, x: F.pmod(r * 65536 + x, F.lit(n))).cast("int")
